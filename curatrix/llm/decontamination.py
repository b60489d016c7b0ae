"""Benchmark decontamination with a distributed positional inverted index.

`build_index` stores, per shard of about SHARD_WORDS words, the sorted positions of every test term in the
shard's documents. The index is partitioned by document, so building and searching it needs no shuffle, and a
document is never cut. `search` takes each test window's terms from the rarest posting list of the shard upwards
and intersects the lists after subtracting the term's offset; what is left at the end are exact occurrences.
Proximity matches hold all terms of a window, in any order, within a stretch of a few more words.

Only terms of the test set are stored. A test set beyond BLOCK_BYTES of text is worked off in blocks of items,
each with its own index over all documents; results of blocks are merged per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import LOCATOR, LOWER, drop_rows, located, save, text_bytes, wide

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # after lower-casing A-Z, on UTF-8 bytes
SHARD_WORDS = 500_000
BLOCK_BYTES = 32 << 20
SLOP = 5


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))


class TestSet:
    """Vocabulary and distinct windows of one block of items. Items without words have no window."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            terms = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            for at in range(max(1, len(terms) - width + 1)) if terms else ():
                windows.setdefault(tuple(terms[at:at + width]), set()).add(name)
        self.windows = list(windows)
        self.items = [sorted(names) for names in windows.values()]

    __test__ = False


def build_index(docs: DataFrame, test: TestSet, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its documents (id, carried columns, first position, words) and the posting lists.

    Positions of a shard count on over its documents with one left free between two, so that no phrase runs
    from one document into the next.
    """
    carry = carry or []
    broadcast = docs.sparkSession.sparkContext.broadcast(test.ids)
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in columns.schema}
    schema = ", ".join(f"`{c}` array<{kinds[c]}>" for c in ["doc_id", *carry])
    schema += ", start array<long>, n_words array<long>, term array<int>, ends array<long>, position array<int>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        vocabulary = broadcast.value
        get, absent = vocabulary.get, len(vocabulary)

        def shard(held, start, count, found, places):
            term, place = np.concatenate(found), np.concatenate(places)
            order = np.argsort(term, kind="stable")
            names, sizes = np.unique(term, return_counts=True)
            one = lambda v, kind: pa.array([v], pa.list_(kind))
            ids = [pa.array([[v.as_py() for col in held for v in col[k]]], pa.list_(held[0][k].type)) for k in range(len(held[0]))]
            return pa.RecordBatch.from_arrays(
                [*ids, one(start, pa.int64()), one(count, pa.int64()), one(names.astype(np.int32), pa.int32()),
                 one(np.cumsum(sizes), pa.int64()), one(place[order].astype(np.int32), pa.int32())],
                names=["doc_id", *carry, "start", "n_words", "term", "ends", "position"])

        held, start, count, found, places, at = [], [], [], [], [], 0
        for batch in batches:
            cut = 0
            for row, text in enumerate(text_bytes(batch.column(batch.num_columns - 1))):
                tokens = words(text)
                ids = np.fromiter((get(w, absent) for w in tokens), np.int32, len(tokens))
                known = np.flatnonzero(ids != absent)
                start.append(at)
                count.append(len(tokens))
                found.append(ids[known])
                places.append(known + at)
                at += len(tokens) + 1
                if at >= shard_words:
                    held.append([c.slice(cut, row + 1 - cut) for c in batch.columns[:-1]])
                    yield shard(held, start, count, found, places)
                    held, start, count, found, places, at, cut = [], [], [], [], [], 0, row + 1
            if cut < batch.num_rows:
                held.append([c.slice(cut) for c in batch.columns[:-1]])
        if start:
            yield shard(held, start, count, found, places)

    return wide(columns).mapInArrow(run, schema)


class Shard:
    """Posting lists of one shard, by term."""

    def __init__(self, term, ends, position, n_terms: int):
        import numpy as np

        self.size = np.zeros(n_terms + 1, np.int64)
        self.first = np.zeros(n_terms + 1, np.int64)
        self.size[term] = np.diff(ends, prepend=0)
        self.first[term] = ends - self.size[term]
        self.position = position

    def list(self, term: int):
        return self.position[self.first[term]:self.first[term] + self.size[term]]

    def phrase(self, window):
        """Start positions of exact occurrences."""
        import numpy as np

        order = sorted(range(len(window)), key=lambda o: self.size[window[o]])
        starts = self.list(window[order[0]]) - order[0]
        for offset in order[1:]:
            if not len(starts):
                break
            held = self.list(window[offset])
            at = np.searchsorted(held, starts + offset)
            at[at == len(held)] = 0
            starts = starts[held[at] == starts + offset]
        return starts

    def near(self, window, stretch: int):
        """Start positions of stretches of `stretch` words that hold all words of the window, repeats included."""
        import numpy as np

        need: dict[int, int] = {}
        for t in window:
            need[t] = need.get(t, 0) + 1
        terms = sorted(need, key=lambda t: self.size[t])
        if any(self.size[t] < n for t, n in need.items()):
            return np.empty(0, np.int64)
        anchor = self.list(terms[0])
        for t in terms[1:]:  # drop anchors that are far from the next terms before all starts are laid out
            held = self.list(t)
            anchor = anchor[np.searchsorted(held, anchor + stretch) > np.searchsorted(held, anchor - stretch, "right")]
            if not len(anchor):
                return anchor
        starts = np.unique((anchor[:, None] - np.arange(stretch)[None, :]).ravel())
        for t in terms:
            held = self.list(t)
            starts = starts[np.searchsorted(held, starts + stretch) - np.searchsorted(held, starts) >= need[t]]
        return starts


def search(index: DataFrame, test: TestSet, carry: list[str] | None = None, slop: int | None = SLOP) -> DataFrame:
    """Per document: n_words, hits (merged word spans, end exclusive, of exact phrases), items, near_items."""
    import numpy as np

    carry = carry or []
    n_terms = len(test.ids)
    width = max((len(w) for w in test.windows), default=1)
    table = np.full((len(test.windows), width), n_terms, np.int32)
    for i, w in enumerate(test.windows):
        table[i, :len(w)] = w
    broadcast = index.sparkSession.sparkContext.broadcast((table, test.windows, test.items))
    elements = {f.name: f.dataType.elementType.simpleString() for f in index.schema}
    schema = ", ".join(f"`{c}` {elements[c]}" for c in ["doc_id", *carry])
    schema += ", n_words long, hits array<struct<start:long,end:long>>, items array<string>, near_items array<string>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, windows, items = broadcast.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for row in range(batch.num_rows):
                value = {n: batch.column(n)[row].values for n in batch.schema.names}
                array = {n: value[n].to_numpy(zero_copy_only=False) for n in ("start", "n_words", "term", "ends", "position")}
                shard = Shard(array["term"], array["ends"], array["position"].astype(np.int64), n_terms)
                shard.size[n_terms] = 1 << 60  # padding of short windows
                alive = np.flatnonzero(shard.size[table].min(1) > 0)
                shard.size[n_terms] = 0
                start, count = array["start"], array["n_words"]
                mark = np.zeros(int(start[-1] + count[-1]) + 2, np.int32)
                exact: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                for w in alive.tolist():
                    window = windows[w]
                    hit = shard.phrase(window)
                    if len(hit):
                        mark[hit] += 1
                        mark[hit + len(window)] -= 1
                        for doc in np.unique(np.searchsorted(start, hit, "right") - 1).tolist():
                            exact.setdefault(doc, set()).update(items[w])
                    if slop is not None:
                        hit = shard.near(window, len(window) + slop)
                        inside = np.maximum(hit, 0)
                        doc = np.searchsorted(start, inside, "right") - 1
                        doc2 = np.searchsorted(start, hit + len(window) + slop - 1, "right") - 1
                        for d in np.unique(doc[doc == doc2]).tolist():
                            near.setdefault(d, set()).update(items[w])
                        for s, d, e in zip(hit[doc != doc2].tolist(), doc[doc != doc2].tolist(), doc2[doc != doc2].tolist()):
                            for k in range(d, e + 1):  # a stretch over a border counts if one document alone holds it
                                if _holds(shard, window, max(s, int(start[k])), min(s + len(window) + slop, int(start[k] + count[k]))):
                                    near.setdefault(k, set()).update(items[w])
                covered = np.cumsum(mark) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                hits: dict[int, list] = {}
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    doc = int(np.searchsorted(start, s, "right")) - 1
                    hits.setdefault(doc, []).append({"start": s - int(start[doc]), "end": e - int(start[doc])})
                docs = range(len(start))
                yield pa.RecordBatch.from_arrays(
                    [*[value[n] for n in ["doc_id", *carry]], pa.array(count),
                     pa.array([hits.get(d, []) for d in docs], span),
                     *[pa.array([sorted(m.get(d, ())) for d in docs], pa.list_(pa.string())) for m in (exact, near)]],
                    names=["doc_id", *carry, "n_words", "hits", "items", "near_items"])

    return index.mapInArrow(run, schema)


def _holds(shard: Shard, window, lo: int, hi: int) -> bool:
    import numpy as np

    return all(np.searchsorted(shard.list(t), hi) - np.searchsorted(shard.list(t), lo) >= window.count(t) for t in set(window))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int | None = SLOP, id_col: str = "doc_id",
            text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: list[str] | None = None,
            block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Exact phrase and proximity matches of test windows, one row per row of docs.

    Columns: doc_id, carried ones, n_words, hits (array of word spans), items and near_items (item ids as sorted
    strings). Windows are `width` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null texts have no words; a null item id is written ''; repeated items count once. Without items no
    document has a match; without documents the result is empty.
    """
    carry = carry or []
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    wanted = ["doc_id", *carry]
    if blocks > 1:  # rows are told apart by their locators
        docs, carry = located(docs), list(dict.fromkeys([*carry, *LOCATOR]))
    results = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        test = TestSet([(r[0], (r[1] or "").encode()) for r in part.collect()], width)
        index = save(build_index(docs, test, id_col, text_col, carry, shard_words), "positional-index")
        results.append(search(index, test, carry, slop))
    if blocks == 1:
        return results[0]
    merged = results[0]
    for other in results[1:]:
        merged = merged.unionByName(other)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return (merged.groupBy("doc_id", *carry).agg(F.max("n_words").alias("n_words"), flat("hits").alias("hits"),
                                      flat("items").alias("items"), flat("near_items").alias("near_items"))
            .select(*wanted, "n_words", _merge_spans("hits").alias("hits"), "items", "near_items"))


def _merge_spans(column: str):
    """Sorted overlapping or touching spans as disjoint ones."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.expr(f"""aggregate({column}, cast(array() as {kind}), (acc, s) ->
        case when size(acc) > 0 and element_at(acc, -1).end >= s.start
        then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start,
             'end', greatest(element_at(acc, -1).end, s.end)))) else concat(acc, array(s)) end)""")


def n_hit(column: str = "hits"):
    return F.aggregate(column, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without the rows in which a test window occurs; columns unchanged."""
    docs = located(docs)
    found = matches(docs, benchmark, width, slop=None, carry=LOCATOR)
    return drop_rows(docs, save(found.where("size(hits) > 0").select(*LOCATOR), "contaminated"))
