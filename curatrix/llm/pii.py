"""Personal data: base identifiers by rule, and further ones by bootstrapped contextual extraction.

1. `scan` finds the base spans of every whole text (email, ip, card, phone) and every other identifier-like token
   (it holds a digit or @; digit groups between single spaces are one token), each with lexical patterns: the two words
   before it, the word on either side, one word on one side, its shape after a word, its shape between word classes.
2. `bootstrap` scores a bipartite graph of patterns and instances. Base identifiers are the seeds, with score one
   for their kind. In each round a pattern's confidence for a kind is the summed score of its distinct instances
   over the number of all its distinct instances and PRIOR, which keeps small counts down; patterns with enough positive instances and a confidence of
   `threshold` or more score the unknown instances they hold, which count in the next round.
3. `extract` adds, as spans of that kind, the tokens that a high-confidence pattern stands around.

Counts and scores are aggregations of distinct (pattern, instance) edges, combined before the shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import FILE, LOCATOR, ROW, located, lookup, save, wide

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the first digit of a run of digits, so that long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9@]")
TRIM = "\"'`.,;:!?()[]{}<>|"
GROUPS = re.compile(r"[+(]*[0-9][0-9().+/-]*")  # a token that can be part of a number written with spaces
NUMBER_DIGITS = 19  # of the longest card; tokens of more digits together are not one number
NAME_CHARS = 64  # longer instances go by their digest
CONTEXT_CHARS = 96  # looked at on either side for words
ROUNDS, THRESHOLD, MIN_SEEDS, PRIOR = 3, 0.9, 5, 0.5

SCAN = (f"doc_id long, {FILE} string, {ROW} long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, "
        "found array<struct<kind:string,start:long,end:long,instance:string,before:string,around:string,coarse:array<string>>>")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (match := DOMAIN.match(text, at + 1)):
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip('0') or '0') <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _word(text: str) -> str:
    return re.sub(r"[0-9]", "0", text.strip(TRIM).lower())[-32:]


def contexts(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before a span, and the word on either side; '' where the text begins or ends."""
    left = text[max(0, start - CONTEXT_CHARS):start].split()
    right = text[end:end + CONTEXT_CHARS].split()
    w2, w1 = ([""] * 2 + [_word(w) for w in left[-2:]])[-2:]
    after = next((w for w in map(_word, right[:2]) if w), "")
    return f"2|{w2} {w1}", f"1|{w1} _ {after}"


def _class(word: str) -> str:
    return "" if not word else "0" if re.search("[0-9]", word) else "a" if word.isalpha() else "."


def shape(text: str) -> str:
    """Digits as 0, runs of letters as a, long runs cut short; other characters as they are."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "0", text[:256]))[:48]


def coarse(before: str, around: str, token: str) -> list[str]:
    """One word on one side, the shape after a word, the shape between word classes."""
    left, right = around[2:].split(" _ ", 1)
    form = shape(token)
    return [f"l|{left}", f"r|{right}", f"s|{left} {form}", f"c|{_class(left)} {form} {_class(right)}"]


def instance(token: str) -> str:
    token = token.lower()
    return token if len(token) <= NAME_CHARS else hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Less punctuation at the ends; a bracket stays where its partner is within."""
    while start < end and text[start] in TRIM and not (text[start] == "(" and ")" in text[start:end][:32]):
        start += 1
    while end > start and text[end - 1] in TRIM and not (text[end - 1] == ")" and "(" in text[start:end][-32:]):
        end -= 1
    return start, end


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens less punctuation at the ends, of any length, that hold a digit or @ and meet no taken span.

    Tokens end at white space; digit groups with a single space between them are one token if they have at most
    NUMBER_DIGITS digits together.
    """
    taken = sorted(taken)
    at, k = 0, 0
    run: list[tuple[int, int]] = []

    def finish() -> Iterator[tuple[int, int]]:
        whole = [(run[0][0], run[-1][1])] if run and len(_digits(text[run[0][0]:run[-1][1]])) <= NUMBER_DIGITS else run
        for start, end in whole:
            start, end = _trimmed(text, start, end)
            if start < end:
                yield start, end

    while match := DIGIT.search(text, at):
        start = end = match.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        low, high = _trimmed(text, start, end)
        free = low < high and not (k < len(taken) and taken[k][0] < high)
        if k < len(taken) and taken[k][1] <= low:  # a span that ends in the punctuation before the token
            free = low < high and not any(s < high and e > low for s, e in taken[k:k + 8])
        groups = free and GROUPS.match(text, start, end)
        stop = groups.end() if groups else start
        whole = groups and all(c in TRIM for c in text[stop:end])
        if run and not (whole and start == run[-1][1] + 1 and text[start - 1] == " "):
            yield from finish()
            run = []
        if whole:
            run.append((start, end))
            if stop < end:  # a full stop or comma ends a number
                yield from finish()
                run = []
        elif free:
            yield low, high
    if run:
        yield from finish()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and identifier-like tokens of each row of located(docs). Null texts are empty."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()),
                                    ("before", pa.string()), ("around", pa.string()), ("coarse", pa.list_(pa.string()))]))
        for batch in batches:
            counts, spans, found = [], [], []
            for value in batch.column(3):
                text = value.as_py() or ""
                base = base_spans(text)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                spans.append(joined(base))
                tokens = [(None, *c) for c in candidates(text, [(s, e) for _, s, e in base])]
                rows = []
                for kind, s, e in [*base, *tokens]:
                    before, around = contexts(text, s, e)
                    rows.append({"kind": kind, "start": s, "end": e, "instance": instance(text[s:e]), "before": before,
                                 "around": around, "coarse": coarse(before, around, text[s:e])})
                found.append(rows)
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *numbers, pa.array(spans, pa.string()), pa.array(found, kinds)],
                                             names=["doc_id", FILE, ROW, *[f"n_{k}" for k in KINDS], "base_spans", "found"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), *LOCATOR, F.col(text_col).alias("text"))
    return wide(columns).mapInArrow(run, SCAN)


def _patterns(occurrences: DataFrame):
    pair = F.array("before", "around")
    return F.explode(F.concat(pair, "coarse") if "coarse" in occurrences.columns else pair).alias("pattern")


def _holding(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """rows with kind and confidence of their pattern; the few patterns that hold many rows are broadcast."""
    kinds = patterns.groupBy("pattern").agg(F.collect_list(F.struct("kind", "confidence")).alias("kinds"), F.max("n").alias("n"))
    return lookup(rows, kinds, "pattern", "n").withColumn("k", F.explode("kinds")).select(*rows.columns, "k.*")


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, kind, confidence, positives, n) of high-confidence patterns.

    occurrences: kind (null: unknown), instance, before, around and, where known, coarse patterns. An instance seen as a base identifier of several
    kinds is a seed of each.
    """
    seeds = occurrences.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    seeds = save(seeds, "pii-seeds")
    edges = occurrences.select("instance", _patterns(occurrences)).distinct()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_seeds)
    edges = save(lookup(edges, sizes, "pattern", "n"), "pii-edges")
    scores = seeds
    for number in range(rounds):
        patterns = (edges.join(scores, "instance").groupBy("pattern", "kind")
                    .agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("positives"), F.first("n").alias("n"))
                    .withColumn("confidence", F.col("sum") / (F.col("n") + PRIOR))
                    .where((F.col("positives") >= min_seeds) & (F.col("confidence") >= threshold)))
        patterns = save(patterns.select("pattern", "kind", "confidence", "positives", "n"), "pii-patterns")
        if number + 1 == rounds:
            break
        unseen = edges.join(seeds.select("instance").distinct(), "instance", "left_anti").select("instance", "pattern")
        found = (_holding(unseen, patterns).groupBy("instance", "kind")
                 .agg((1 - F.exp(F.sum(F.log(1 - 0.99 * F.col("confidence"))))).alias("score")))
        scores = save(seeds.unionByName(found), "pii-scores")
    return patterns


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
            threshold: float = THRESHOLD, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans, n_found.

    spans are base and found ones, `kind:start:end` in code points, by kind as listed, then start, comma-joined; a
    found span meets no base span of its text. Null texts have no spans, null ids stay null, repeated rows are
    rows of their own but one instance. An empty table gives an empty result.
    """
    rows = save(scan(located(docs), id_col, text_col), "pii-scan")
    each = rows.select(*LOCATOR, F.explode("found").alias("f")).select(*LOCATOR, "f.*")
    patterns = bootstrap(each, rounds, threshold, min_seeds)
    tokens = each.where("kind is null").select(*LOCATOR, "start", "end", _patterns(each))
    rank = F.struct(-F.col("confidence"), F.array_position(F.lit(list(KINDS)), F.col("kind")), "kind")
    found = (_holding(tokens, patterns).groupBy(*LOCATOR, "start", "end").agg(F.min_by("kind", rank).alias("kind"))
             .groupBy(*LOCATOR).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))
    base = F.filter("found", lambda s: s["kind"].isNotNull())
    base = F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    placed = lambda s: F.struct(F.array_position(F.lit(list(KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    ordered = F.array_sort(F.transform(F.concat(base, F.coalesce("added", F.array())), placed))
    spans = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.join(found, LOCATOR, "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_spans", spans.alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"))
