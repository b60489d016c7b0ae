"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all preceding turns are the context, only its reply is trainable.
`format_turns` gives each turn its formatted segment and its place in the conversation; `expand` writes the examples
out. A context is cut into parts of whole segments, so that no row grows with the conversation; together the parts
are as long as the turns before the target, and the examples of a conversation grow with the square of its turns.
Turns after the last reply belong to no example and are kept as the rest of their conversation.

`read_back` takes everything from the written examples: it holds every context against the conversation up to its
target, and an example that is not exactly that prefix is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import save

# Template: <s>[INST]role[/INST] text</s>
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, BETWEEN, CLOSE = "<s>[INST]", "[/INST] ", "</s>"
SEGMENT = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BETWEEN) + "(.*?)" + re.escape(CLOSE), re.DOTALL)
PART_CHARS = 1 << 16  # a part of a context begins within so many code points
TARGETS_AT_ONCE = 1 << 12  # places of targets that meet a part in one task
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    """Backslashes are doubled, and a backslash breaks every control string after its first character."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    match = SEGMENT.fullmatch(segment)
    if match is None:
        raise ValueError("not a formatted turn")
    return unescape(match[1]), unescape(match[2])


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place (from 0), role, segment, start, loss_start, loss_end.

    start is the segment's first code point in the conversation's text; loss_start and loss_end bound the trainable
    reply there and are null but for role 'assistant'. Turns are ordered by turn (null first), then role, then
    text, so ties and repeated rows have one defined order and all of them stay. Null roles and texts are empty;
    rows with null conv_id make one conversation. Other columns are dropped.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("segment", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BETWEEN), escape(F.col("text")), F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "role", "segment",
                         (before - F.length("segment")).cast("long").alias("start"))
    reply = F.col("role") == "assistant"
    head = F.lit(len(OPEN) + len(BETWEEN)) + F.length(escape(F.col("role")))
    return turns.withColumns({
        "loss_start": F.when(reply, F.col("start") + head),
        "loss_end": F.when(reply, F.col("start") + F.length("segment") - len(CLOSE)),
    })


def expand(formatted: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows of examples: conv_id, place of the target, kind, part, text, loss_start, loss_end.

    kind 'context': the turns before the target, in parts of whole segments that begin within the same `part_chars`
    code points; 'target': the segment of the target, whose trainable span loss_start and loss_end bound; 'rest': one
    segment after the last target (place is null, part its place). Parts meet the targets of a conversation in blocks,
    so no task has to write all examples of a long conversation.
    """
    same = lambda left, right: F.col(left).eqNullSafe(F.col(right))
    lasts = formatted.groupBy("conv_id").agg(F.max("place").alias("end"), F.max(F.when(F.col("loss_start").isNotNull(), F.col("place"))).alias("last"))
    lasts = lasts.select(F.col("conv_id").alias("c"), "end", "last")
    piece = F.floor(F.col("start") / part_chars)
    segments = F.array_sort(F.collect_list(F.struct("place", "segment")))
    parts = formatted.groupBy(F.col("conv_id").alias("p"), piece.alias("part")).agg(
        F.array_join(F.transform(segments, lambda x: x["segment"]), "").alias("text"), F.min("start").alias("begin"), F.min("place").alias("first"))
    block = lambda place: F.floor(F.col(place) / TARGETS_AT_ONCE)
    parts = parts.join(lasts.where("last is not null"), same("p", "c")).where("first < last").select(
        "p", "part", "text", "begin", F.explode(F.sequence(block("first"), block("last"))).alias("block"))
    targets = formatted.where("loss_start is not null")
    each = targets.select("conv_id", "place", "start", F.explode(F.sequence(F.lit(0).cast("long"), piece)).alias("number"), block("place").alias("targets"))
    met = each.join(parts, same("conv_id", "p") & (F.col("number") == F.col("part")) & (F.col("targets") == F.col("block"))).where("begin < start")
    none = F.lit(None).cast("long")
    context = met.select("conv_id", "place", F.lit("context").alias("kind"), "part",
                         F.substring("text", F.lit(1), (F.col("start") - F.col("begin")).cast("int")).alias("text"), none.alias("loss_start"), none.alias("loss_end"))
    target = targets.select("conv_id", "place", F.lit("target"), none, "segment", F.col("loss_start") - F.col("start"), F.col("loss_end") - F.col("start"))
    rest = formatted.join(lasts, same("conv_id", "c")).where("last is null or place > last").select(
        "conv_id", none, F.lit("rest"), "place", "segment", none, none)
    return context.union(target).union(rest)


def examples(expanded: DataFrame) -> DataFrame:
    """Whole texts of examples: conv_id, place, text (context and target), loss_start, loss_end."""
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "context", F.struct("part", "text"))))
    of_target = lambda c: F.max(F.when(F.col("kind") == "target", F.col(c)))
    rows = expanded.where("kind <> 'rest'").groupBy("conv_id", "place").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("context"), of_target("text").alias("target"),
        of_target("loss_start").alias("a"), of_target("loss_end").alias("b"))
    size = F.length("context")
    return rows.select("conv_id", "place", F.concat("context", "target").alias("text"), (size + F.col("a")).alias("loss_start"), (size + F.col("b")).alias("loss_end"))


def _streamed(rows: DataFrame, keys: list[str], order: list, work, schema: str) -> DataFrame:
    """``work(key, rows)`` over the rows of each key in order, one after another; it yields rows of the result."""
    from pyspark.sql import types as T

    names = rows.columns
    shape = T.StructType.fromDDL(schema)

    def run(batches: Iterator) -> Iterator:
        import itertools

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        flat = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
        made = (out for key, own in itertools.groupby(flat, lambda r: r[:len(keys)]) for out in work(key, own))
        while some := list(itertools.islice(made, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).select(*names).mapInArrow(run, shape)


def read_back(expanded: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the examples alone.

    Turns come from the last example of a conversation and its rest, replies from the targets. Rows are streamed in
    order, so a conversation of any length needs no more memory than its longest segment or part.
    """
    import hashlib

    sha = hashlib.sha256
    kept = ["conv_id", "place", "kind", "part", "text", "loss_start", "loss_end"]
    targets = expanded.where("kind = 'target'").select(*kept)

    def contexts(key, rows):
        digest = sha()
        for row in rows:
            digest.update(row[2].encode())
        yield (*key, digest.hexdigest())

    context_rows = expanded.where("kind = 'context'").select("conv_id", "place", "text", "part")
    found = _streamed(context_rows, ["conv_id", "place"], ["part"], contexts, "conv_id long, place long, found string")

    def turns(key, rows):
        whole, prefix, size, count = sha(), sha(), 0, 0
        for _, _, text in rows:
            at = 0
            while at < len(text):
                match = SEGMENT.match(text, at)
                if match is None:
                    raise ValueError("not formatted turns")
                role, said = unescape(match[1]), unescape(match[2])
                if role == "assistant":
                    yield (*key, count, prefix.hexdigest(), None, None)
                whole.update(f"{role}\n{said}\n".encode())
                prefix.update(match[0].encode())
                count, size, at = count + 1, size + len(match[0]), match.end()
        yield (*key, None, whole.hexdigest(), count, size)

    last = targets.groupBy("conv_id").agg(F.max("place").alias("last")).withColumnRenamed("conv_id", "c")
    stage = F.when(F.col("kind") == "context", 0).when(F.col("kind") == "target", 1).otherwise(2).alias("stage")
    linear = (expanded.join(last, F.col("conv_id").eqNullSafe(F.col("c")), "left").where("kind = 'rest' or place = last")
              .select("conv_id", (stage * F.lit(1 << 60) + F.coalesce("part", F.lit(0))).alias("at"), "text"))
    read = _streamed(linear, ["conv_id"], ["at"], turns, "conv_id long, place long, digest string, n_turns long, chars long")
    read = save(read, "chat-read")

    def replies(key, rows):
        digest, chars, count = sha(), 0, 0
        for _, _, text, start, end in rows:
            reply = unescape(text[start:end])
            digest.update(reply.encode())
            chars, count = chars + len(reply), count + 1
        yield (*key, chars, digest.hexdigest(), count)

    loss = _streamed(targets.select("conv_id", "place", "text", "loss_start", "loss_end"), ["conv_id"], ["place"], replies,
                     "conv_id long, loss_chars long, loss_sha256 string, n_examples long")
    # Every reply of the conversation has an example, and every example the exact prefix.
    empty = sha().hexdigest()
    prefixes = read.where("place is not null").select(F.col("conv_id").alias("c"), F.col("place").alias("p"), "digest")
    own = targets.select("conv_id", "place").join(found.select(F.col("conv_id").alias("fc"), F.col("place").alias("fp"), "found"),
                                                  F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("place") == F.col("fp")), "left")
    both = own.join(prefixes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "full")
    wrong = F.col("digest").isNull() | F.col("place").isNull() | (F.coalesce("found", F.lit(empty)) != F.col("digest"))
    checked = both.groupBy(F.when(F.col("place").isNull(), F.col("c")).otherwise(F.col("conv_id")).alias("k")).agg(F.count_if(wrong).alias("wrong"))
    total = read.where("place is null").select("conv_id", "n_turns", F.col("digest").alias("turns_sha256"), F.col("chars").alias("formatted_chars"))
    loss = loss.withColumnRenamed("conv_id", "lc")
    result = (total.join(loss, F.col("conv_id").eqNullSafe(F.col("lc")), "left").join(checked, F.col("conv_id").eqNullSafe(F.col("k")), "left"))
    exact = F.when(F.col("wrong") > 0, F.raise_error(F.lit("an example is not the prefix of its conversation")).cast("long"))
    return result.select(
        "conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0)).alias("loss_chars"),
        F.coalesce("loss_sha256", F.lit(empty)).alias("loss_sha256"), "formatted_chars",
        F.coalesce(exact, F.col("n_examples"), F.lit(0)).alias("n_examples"))
