"""Cross-tokenizer alignment by interval coalescing.

Both tokenizers cut the same bytes (a space and the text). All tokens of either side are sorted by their first byte;
the running maximum of their ends tells where a group breaks: at a token that starts where all earlier ones have
ended. Within a group the overlapping token pairs are expanded as ranges, since tokens of one side never overlap.

Counts of id pairs over the whole corpus go back to the documents by pieces: a task aligns a few megabytes of text,
keeps each link as a number in the piece's list of distinct id pairs, and only that list, with counts, is shuffled.
Texts are encoded once; no task or driver holds a list that grows with the corpus.

Rows: null and empty texts, and texts that one tokenizer does not give back byte by byte, have no tokens. Ids may be
null or repeated, every row counts as a document of its own. Texts are encoded in units that end where no token of
either tokenizer can cross, so a very long text is never encoded as one; common units are encoded once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import save, wide

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"

PIECE_BYTES = 8 << 20  # text of one piece
ENCODE_CHARS = 1 << 19  # characters aligned at a time
UNIT_CHARS, UNITS = 64, 1 << 17  # units up to this length are remembered, twice so many at most
RUN_CHARS = 1 << 16  # new units are encoded in runs of about this length
BLANK = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
SAFE = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")  # no token of either side crosses the place before such a space
EDGES = re.compile(f"[^{BLANK}](.*[^{BLANK}])?", re.DOTALL)  # units that may stand next to others
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
SPACE_MARK = "▁"
SEPARATORS = (",", "|", ";", "")


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, others for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Two tokenizers with the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE_MARK, " ").encode() for p in pieces]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Units are exact only if no piece holds a space after something else.
        self.splits = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.words = [f"{k}{s}" for k in range(most) for s in SEPARATORS]

    def units(self, text: str) -> list[str]:
        """text cut at single spaces between words: with a space before it, each unit encodes as it does within text."""
        if not text:
            return []
        return SAFE.split(text) if self.splits else [text]

    def _run(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides of each unit, encoded as one text; None where a side does not give the bytes back."""
        import numpy as np

        text = " ".join(units)
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int32)
        b = np.array(self.b.encode(text), np.int32)
        want = (" " + text).encode()
        if any(b"".join(map(table.__getitem__, ids.tolist())) != want for ids, table in ((a, self.bytes_a), (b, self.bytes_b))):
            if len(units) == 1:
                return [None]
            half = len(units) // 2
            return self._run(units[:half]) + self._run(units[half:])
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        sides = []
        for ids, size in ((a, self.size_a), (b, self.size_b)):
            cuts = [0, *(np.searchsorted(np.cumsum(size[ids]), ends) + 1).tolist()]
            raw = ids.tobytes()
            sides.append([raw[4 * i:4 * j] for i, j in zip(cuts, cuts[1:])])
        return list(zip(*sides))

    def _encode_units(self, units: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes] | None]]:
        run, size = [], 0
        for unit in units:
            if not EDGES.fullmatch(unit):
                yield unit, self._run([unit])[0]
                continue
            if run and size + len(unit) > RUN_CHARS:
                yield from zip(run, self._run(run))
                run, size = [], 0
            run.append(unit)
            size += len(unit) + 1
        if run:
            yield from zip(run, self._run(run))

    def encode(self, texts: list[str]) -> list[tuple]:
        """Ids of both sides for each text as arrays; empty where a side does not give the bytes back."""
        import numpy as np

        of_text = [self.units(text) for text in texts]
        if len(self.young) > UNITS:
            self.young, self.old = {}, self.young
        here, young, old = {}, self.young, self.old
        new = []
        for unit in set().union(*of_text):
            if unit in young:
                here[unit] = young[unit]
            elif unit in old:
                here[unit] = young[unit] = old[unit]
            else:
                new.append(unit)
        for unit, ids in self._encode_units(new):
            here[unit] = ids
            if len(unit) <= UNIT_CHARS:
                young[unit] = ids
        found = []
        for units in of_text:
            ids = [here[unit] for unit in units]
            if None in ids:
                ids = []
            found.append(tuple(np.frombuffer(b"".join([x[side] for x in ids]), np.int32) for side in (0, 1)))
        return found


@functools.lru_cache(maxsize=4)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def coalesce(start, end):
    """Group numbers, in sorted order, of intervals; also the order. A group breaks where a start reaches the running
    maximum of the ends before it."""
    import numpy as np

    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.empty(len(order), np.int64)
    breaks[:1] = 0
    breaks[1:] = start[order][1:] >= reach[:-1]
    return np.cumsum(breaks), order


class Aligned:
    """Groups and links of the documents of a batch; documents lie one after another in one range of bytes."""

    def __init__(self, pair: Pair, coded: list[tuple]):
        import numpy as np

        self.pair, docs = pair, len(coded)
        self.n_a = np.array([len(a) for a, _ in coded], np.int64)
        self.n_b = np.array([len(b) for _, b in coded], np.int64)
        self.a, self.b = (np.concatenate([c[side] for c in coded]).astype(np.int64) for side in (0, 1))
        self.end_a, self.end_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        self.start_a, self.start_b = self.end_a - pair.size_a[self.a], self.end_b - pair.size_b[self.b]
        self.doc_a, self.doc_b = np.repeat(np.arange(docs), self.n_a), np.repeat(np.arange(docs), self.n_b)
        start, end = np.concatenate([self.start_a, self.start_b]), np.concatenate([self.end_a, self.end_b])
        group, order = coalesce(start, end)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = group
        self.group_a, self.group_b = self.group[:len(self.a)], self.group[len(self.a):]
        # Every group holds a token of A, the first of which begins the group.
        first = np.ones(len(self.a), bool)
        first[1:] = self.group_a[1:] != self.group_a[:-1]
        self.n_groups = np.bincount(self.doc_a[first], minlength=docs)
        # Tokens of B that overlap a token of A follow one another.
        low = np.searchsorted(self.end_b, self.start_a, "right")
        many = np.searchsorted(self.start_b, self.end_a, "left") - low
        before = np.cumsum(many) - many
        self.link_a = np.repeat(np.arange(len(self.a)), many)
        self.link_b = np.arange(int(many.sum())) + np.repeat(low - before, many)
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=docs)

    def codes(self):
        """A number for the id pair of each link, links in document order."""
        return (self.a[self.link_a] << 32) | self.b[self.link_b]

    def texts(self) -> Iterator[str]:
        """`a1,a2|b1;a3|b2,b3` for each document, empty without tokens."""
        import numpy as np

        doc = np.concatenate([self.doc_a, self.doc_b])
        side = np.repeat(np.array([0, 1]), [len(self.a), len(self.b)])
        order = np.lexsort((side, self.group))  # stable: tokens of a side stay in order
        group, side, doc, ids = self.group[order], side[order], doc[order], np.concatenate([self.a, self.b])[order]
        mark = np.full(len(ids), 3)
        mark[:-1] = np.where(doc[1:] != doc[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
        words = self.pair.words
        at = (ids * len(SEPARATORS) + mark).tolist()
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        for i, j in zip([0, *stops], stops):
            yield "".join(map(words.__getitem__, at[i:j]))


def _aligned(texts, pair: Pair) -> Iterator[Aligned]:
    """Whole documents in batches of bounded size; one long document may be a batch."""
    some, chars = [], 0
    for text in texts:
        some.append(text or "")
        chars += len(some[-1])
        if chars >= ENCODE_CHARS:
            yield Aligned(pair, pair.encode(some))
            some, chars = [], 0
    if some:
        yield Aligned(pair, pair.encode(some))


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = TOKENIZER_A,
               path_b: str = TOKENIZER_B) -> DataFrame:
    """(doc_id, groups) with groups as array of (start, end, a, b): byte range in space + text and the ids of both sides."""
    kind = "array<struct<start: long, end: long, a: array<int>, b: array<int>>>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pair = pair_of(path_a, path_b)
        for batch in batches:
            at = 0
            for found in _aligned(batch.column(1).to_pylist(), pair):
                docs_here, rows = len(found.n_a), [[] for _ in found.n_a]
                cut_a = np.flatnonzero(np.diff(found.group_a, prepend=-1))
                cut_b = np.flatnonzero(np.diff(found.group_b, prepend=-1))
                base = np.cumsum(np.bincount(found.doc_a, pair.size_a[found.a], docs_here)).astype(np.int64)
                for i, j, k, m in zip(cut_a, [*cut_a[1:], len(found.a)], cut_b, [*cut_b[1:], len(found.b)]):
                    doc = found.doc_a[i]
                    zero = base[doc - 1] if doc else 0
                    rows[doc].append({"start": int(found.start_a[i] - zero), "end": int(found.end_a[j - 1] - zero),
                                      "a": found.a[i:j].tolist(), "b": found.b[k:m].tolist()})
                fields = [("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, docs_here), pa.array(rows, pa.list_(pa.struct(fields)))],
                                                 names=["doc_id", "groups"])
                at += docs_here

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wide(rows).mapInArrow(run, f"doc_id long, groups {kind}")


PIECES = ("piece long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "digest array<string>, links binary, codes array<long>, counts array<long>")


def pieces(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """Rows of a few megabytes of text each: documents, their links as places in the piece's distinct id pairs, counts."""
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        pair = pair_of(path_a, path_b)
        number = TaskContext.get().partitionId() << 33
        kept: list[list] = [[], [], [], [], [], []]
        codes: list = []
        size = 0

        def row():
            nonlocal number
            distinct, place, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            links = zstandard.ZstdCompressor(level=1).compress(place.astype(np.uint32).tobytes())
            arrays = [pa.array([number], pa.int64())]
            arrays += [pa.array([x], pa.list_(pa.int64())) for x in kept[:5]] + [pa.array([kept[5]], pa.list_(pa.string()))]
            arrays += [pa.array([links], pa.binary()), pa.array([distinct], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
            number += 1
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            at = 0
            for found in _aligned((v.as_py() for v in batch.column(1)), pair):
                here = len(found.n_a)
                kept[0] += batch.column(0).slice(at, here).to_pylist()
                at += here
                for column, values in zip(kept[1:5], (found.n_a, found.n_b, found.n_groups, found.n_links)):
                    column += values.tolist()
                kept[5] += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.texts()]
                codes.append(found.codes())
                size += int(found.end_a[-1]) if len(found.end_a) else 0
                if size >= PIECE_BYTES or len(kept[0]) >= PIECE_BYTES >> 6:
                    yield row()
                    kept, codes, size = [[], [], [], [], [], []], [], 0
        if kept[0]:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wide(rows).mapInArrow(run, PIECES)


def pair_counts(found: DataFrame) -> DataFrame:
    """(code, total, best): links of each id pair over all pieces, and whether no pair of its B id has more."""
    totals = save(found.select(F.explode(F.arrays_zip("codes", "counts")).alias("p"))
                  .groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("total")), "align-totals")
    b = F.col("code").bitwiseAND((1 << 32) - 1)
    # One row for each id of B: bounded by its vocabulary.
    most = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return totals.withColumn("b", b).join(F.broadcast(most), "b").select("code", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = TOKENIZER_A,
          path_b: str = TOKENIZER_B) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is how many links of all documents join its two ids; n_best counts the links whose count is the
    highest of their B id, count_sum adds the counts up.
    """
    found = save(pieces(docs, id_col, text_col, path_a, path_b), "align-pieces")
    listed = found.select("piece", F.posexplode("codes").alias("place", "code"))
    back = (listed.join(pair_counts(found), "code").groupBy("piece")
            .agg(F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("pairs")))
    back = back.select("piece", F.col("pairs.total").alias("totals"), F.col("pairs.best").alias("bests"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "digest"]
    joined = found.select("piece", *columns, "links").join(back, "piece", "left").select(*columns, "links", "totals", "bests")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_a, n_b, n_groups, n_links, digest = (batch.column(c)[k].values for c in range(6))
                many = n_links.to_numpy()
                stops = np.concatenate([[0], np.cumsum(many)])
                sums = np.zeros((2, int(stops[-1]) + 1), np.int64)
                if stops[-1]:
                    links = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(6)[k].as_py()), np.uint32)
                    np.cumsum(batch.column(8)[k].values.to_numpy(zero_copy_only=False)[links], out=sums[0, 1:])
                    np.cumsum(batch.column(7)[k].values.to_numpy()[links], out=sums[1, 1:])
                best, total = (pa.array(s[stops[1:]] - s[stops[:-1]]) for s in sums)
                yield pa.RecordBatch.from_arrays([ids, n_a, n_b, n_groups, n_links, best, total, digest], names=[
                    "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                                  "groups_sha256 string")
