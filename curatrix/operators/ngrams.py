"""Character n-grams, vocabulary and TF-IDF weights.

Text is expanded whole and counted inside the row, so no shuffle is needed to count terms per
record; document frequencies combine before their shuffle. Texts meet a vocabulary of any size
in the same way: rows are packed into slices of bounded size, the distinct terms of each slice
are joined with the vocabulary, and what is known of them goes back to the slice, which is then
weighed piece by piece. What is shuffled are distinct terms per slice, not windows; slices are
far larger than the pieces that are counted at a time, because distinct terms grow slower than text.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions.text import as_col
from curatrix.lineage import cut_lineage, saved, spread
from curatrix.operators.ordered import global_position

ROWS_PER_PIECE = 500  # texts that are counted at a time
CHARS_PER_PIECE = 500_000
CHARS_PER_SLICE = 4_000_000  # texts that meet the vocabulary together
TERMS_HELD = 1_000_000  # lines that are added up at a time
CODE_POINTS = 0x110000


def ngram_text(value: Column | str) -> Column:
    """Lower case; runs of two or more blanks become one space."""
    return F.regexp_replace(F.lower(F.coalesce(as_col(value), F.lit(""))), r"(?U)\s{2,}", " ")


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(key, ngram_text(text).alias("_text")))


def _runs(texts: pa.Array, chars: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of bounded length; a longer text is a run of its own."""
    ends, lo = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chars, "right"))
        hi = max(lo + 1, min(hi, lo + (rows or len(ends))))
        yield lo, hi
        lo = hi


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) pieces of bounded length."""
    for lo, hi in _runs(texts, CHARS_PER_PIECE, ROWS_PER_PIECE):
        yield lo, texts.slice(lo, hi - lo).to_pylist()


def _numbered(texts: list[str], lo: int, hi: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Per length: (n, base, alphabet, row, window) of every window; None where numbers would not fit.

    A window is a number in base "distinct characters of the piece", so counting is a sort.
    """
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    seen = np.zeros(CODE_POINTS, dtype=bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    base = len(alphabet)
    codes = (np.cumsum(seen) - 1)[points]
    owners, ends = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
    for n in range(lo, hi + 1):
        if len(points) < n:
            continue
        if base ** n * len(texts) >= 2 ** 63 or alphabet[0] == 0:
            yield n, base, alphabet, None, None
            continue
        key = _window_keys(codes, base, n)
        inside = np.arange(len(key)) + n <= ends[:len(key)]
        yield n, base, alphabet, owners[:len(key)][inside], key[inside]


def count_windows(texts: list[str], lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(row, count, term) of every distinct window per text."""
    for n, base, alphabet, owners, key in _numbered(texts, lo, hi):
        if key is None:
            yield from _count_plain(texts, n)
        else:
            both, counts = np.unique(owners * base ** n + key, return_counts=True)
            rows, key = np.divmod(both, base ** n)
            distinct = _distinct(key)
            yield rows, counts, _spell(distinct, base, n, alphabet).take(pa.array(np.searchsorted(distinct, key)))


def sum_windows(texts: list[str], lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(texts with it, occurrences, term) of every distinct window of the piece."""
    for n, base, alphabet, owners, key in _numbered(texts, lo, hi):
        if key is None:
            for _, counts, terms in _count_plain(texts, n):
                yield np.ones(len(counts), dtype=np.int64), counts, terms
        elif len(key):
            distinct, total = np.unique(key, return_counts=True)
            _, rows = np.unique(_distinct(owners * base ** n + key) % base ** n, return_counts=True)
            yield rows, total, _spell(distinct, base, n, alphabet)


def distinct_windows(texts: list[str], lo: int, hi: int) -> Iterator[pa.Array]:
    """The distinct windows of the piece, by length."""
    for n, base, alphabet, _, key in _numbered(texts, lo, hi):
        if key is None:
            yield from (terms for _, _, terms in _count_plain(texts, n))
        else:
            yield _spell(_distinct(key), base, n, alphabet)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; a sort is faster here than the hash table of np.unique."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _window_keys(codes: np.ndarray, base: int, n: int) -> np.ndarray:
    size = len(codes) - n + 1
    key = codes[:size].astype(np.int64)
    for j in range(1, n):
        key = key * base + codes[j:size + j]
    return key


def _spell(distinct: np.ndarray, base: int, n: int, alphabet: np.ndarray) -> pa.Array:
    """Numbers back to text."""
    letters = np.empty((len(distinct), n), dtype=np.uint32)
    for j in range(n - 1, -1, -1):
        distinct, digit = np.divmod(distinct, base)
        letters[:, j] = alphabet[digit]
    return pa.array(letters.view(f"<U{n}").ravel().tolist(), pa.string())


def _count_plain(texts: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    for row, text in enumerate(texts):
        counted = Counter(text[i:i + n] for i in range(len(text) - n + 1))
        if counted:
            yield (np.full(len(counted), row), np.fromiter(counted.values(), np.int64, len(counted)),
                   pa.array(list(counted), pa.string()))


def char_ngrams(df: DataFrame, key: str, text: str, lo: int = 3, hi: int = 5) -> DataFrame:
    """(key, term, tf) for every distinct window of every row."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(batch.column(1)):
                for rows, counts, terms in count_windows(texts, lo, hi):
                    owners = batch.column(0).take(pa.array(rows + start))
                    yield pa.RecordBatch.from_arrays([owners, terms, pa.array(counts, pa.int32())], names=[key, "term", "tf"])

    return _texts(df, key, text).mapInArrow(expand, f"{key} {_kind(df, key)}, term string, tf int")


def summarise_ngrams(ngrams: DataFrame, key: str) -> DataFrame:
    """(key, terms, windows, most, first_term) of the rows of ``char_ngrams``.

    Lines of a batch are added up first: Spark would sort all of them, because a least text is no fixed number of bytes.
    """
    sums = [("terms", "count"), ("windows", "sum"), ("most", "max"), ("first_term", "min")]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.table([batch.column(0), batch.column(1), batch.column(2), batch.column(2), batch.column(1)], names=[key, *[c for c, _ in sums]])
                made = rows.group_by(key, use_threads=False).aggregate([(c, how) for c, how in sums])
                made = made.select([key, *[f"{c}_{how}" for c, how in sums]]).rename_columns([key, *[c for c, _ in sums]])
                yield from made.cast(pa.schema([made.schema.field(0), ("terms", pa.int64()), ("windows", pa.int64()), ("most", pa.int64()),
                                                ("first_term", pa.string())])).to_batches()

    parts = ngrams.select(key, "term", "tf").mapInArrow(
        add_up, f"{key} {_kind(ngrams, key)}, terms long, windows long, most long, first_term string")
    return parts.groupBy(key).agg(*[{"min": F.min, "max": F.max}.get(how, F.sum)(c).alias(c) for c, how in sums])


def _keep_terms(vocab: DataFrame, min_df: int, max_terms: int | None) -> DataFrame:
    """Terms in min_df rows or more; with max_terms only the most frequent, ties by term."""
    vocab = vocab.filter(F.col("df") >= min_df)
    if not max_terms:
        return vocab
    placed = global_position(vocab, [F.col("total").desc(), "term"], "_p")
    return placed.filter(F.col("_p") <= max_terms).drop("_p")


def fit_vocab(ngrams: DataFrame, min_df: int = 2, max_terms: int | None = None) -> DataFrame:
    """(term, df, total) of terms in at least min_df rows; optionally the most frequent ones."""
    return _keep_terms(ngrams.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), min_df, max_terms)


def _slice_terms(texts: pa.Array, lo: int, hi: int, most_lines: int = TERMS_HELD) -> Iterator[pa.Table]:
    """(term, df, total) of a slice of texts; several tables, whose lines add up, beyond ``most_lines`` distinct terms."""
    names = ["term", "df", "total"]

    def added(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
        return sums.select(["term", "df_sum", "total_sum"]).rename_columns(names)

    held, most = [], most_lines
    for _, piece in pieces(texts):
        held += [pa.table([terms, pa.array(rows, pa.int64()), pa.array(total, pa.int64())], names=names)
                 for rows, total, terms in sum_windows(piece, lo, hi)]
        if sum(h.num_rows for h in held) > most:
            held = [added(held)]
            most = max(most_lines, 2 * held[0].num_rows)
            if held[0].num_rows > most_lines:
                yield held[0]
                held, most = [], most_lines
    if held:
        yield added(held)


def text_vocab(
    df: DataFrame, text: str, min_df: int = 2, max_terms: int | None = None, lo: int = 3, hi: int = 5
) -> DataFrame:
    """The same vocabulary straight from text.

    Each slice of text is added up first and hands on one line per term, so far fewer rows
    leave Python than there are windows; beyond TERMS_HELD distinct terms it hands on
    what it has and goes on, so that the lines held do not grow with the variety of the text.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in _runs(batch.column(0), CHARS_PER_SLICE):
                for lines in _slice_terms(batch.column(0).slice(first, end - first), lo, hi):
                    yield from lines.to_batches()

    parts = spread(df.select(ngram_text(text).alias("_text"))).mapInArrow(add_up, "term string, df long, total long")
    return _keep_terms(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), min_df, max_terms)


def idf(df: Column, rows: int) -> Column:
    """Smooth inverse document frequency: ln((1 + n) / (1 + df)) + 1."""
    return F.log((1.0 + rows) / (1.0 + df)) + 1.0


def number_terms(vocab: DataFrame, rows: int) -> DataFrame:
    """(term, ix, idf): dense index in term order."""
    placed = global_position(vocab.select("term", "df"), ["term"], "_p")
    return placed.select("term", (F.col("_p") - 1).cast("int").alias("ix"), idf(F.col("df"), rows).alias("idf"))


def pack(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """(slice, rows, texts): slices of bounded size; rows holds the columns ``keep`` (all), texts the normal form of ``text``."""
    whole = spread(df.select(F.struct(*(df.columns if keep is None else keep)).alias("row"), ngram_text(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _runs(batch.column(1), CHARS_PER_SLICE):
                ends = pa.array([0, hi - lo], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([random.getrandbits(63)]), pa.ListArray.from_arrays(ends, batch.column(0).slice(lo, hi - lo)),
                    pa.ListArray.from_arrays(ends, batch.column(1).slice(lo, hi - lo))], names=["slice", "rows", "texts"])

    shape = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("rows", T.ArrayType(whole.schema["row"].dataType)),
        T.StructField("texts", T.ArrayType(T.StringType()))])
    return saved(whole.mapInArrow(run, shape), "packed")


def meet_terms(packed: DataFrame, terms: DataFrame, lo: int = 3, hi: int = 5) -> DataFrame:
    """packed with ``known``: what ``terms`` (term, ix, and further columns) says of the terms of each slice."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = [found for _, texts in pieces(batch.column(1)[row].values) for found in distinct_windows(texts, lo, hi)]
                found = pc.unique(pa.chunked_array(held, pa.string()))
                name = pa.array(np.full(len(found), batch.column(0)[row].as_py(), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([name, found], names=["slice", "term"])

    needed = packed.select("slice", "texts").mapInArrow(distinct, "slice long, term string")
    known = needed.join(terms, "term").groupBy("slice").agg(F.collect_list(F.struct(*terms.columns)).alias("known"))
    return packed.join(known, "slice", "left")


def weigh(
    df: DataFrame, text: str, terms: DataFrame, make: Callable, fields: list[tuple[str, T.DataType]], lo: int = 3, hi: int = 5,
    keep: list[str] | None = None, again: bool = False,
) -> DataFrame:
    """The columns ``keep`` of df (all) and the columns that ``make`` gives for every row.

    ``make(n, rows, ix, counts, known)`` sees one piece of n rows: parallel arrays of row, term index and
    count in row and index order, and ``known(column)`` gives what a column of ``terms`` says of each entry's term.
    It returns one Arrow array of n values per field. ``again``: the slices are written with what is known of
    them, for a result that is gone through more than once.
    """
    met = meet_terms(pack(df, text, keep), terms, lo, hi).select("rows", "texts", "known")
    if again:
        met = saved(met, "met")
    kept = [df.schema[c] for c in (df.columns if keep is None else keep)]
    names_out = [*[f.name for f in kept], *[n for n, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = batch.column(2)[row].values
                columns = {} if held is None else {held.type.field(i).name: held.field(i) for i in range(held.type.num_fields)}
                numbers = columns["ix"].to_numpy() if columns else np.zeros(0, dtype=np.int64)
                order = np.argsort(numbers, kind="stable")
                numbers = numbers[order]
                columns = {c: v.take(pa.array(order)) for c, v in columns.items()}
                table = TermTable(columns["term"].to_pylist() if columns else [])
                parts = batch.column(0)[row].values
                fixed = [parts.field(i) for i in range(parts.type.num_fields)]
                for start, texts in pieces(batch.column(1)[row].values):
                    rows, at, counts = table.count(texts, lo, hi)

                    def known(column: str, at: np.ndarray = at, columns: dict = columns) -> pa.Array:
                        return columns[column].take(pa.array(at)) if columns else pa.array([])

                    made = make(len(texts), rows, numbers[at], counts, known)
                    yield pa.RecordBatch.from_arrays([*[f.slice(start, len(texts)) for f in fixed], *made], names=names_out)

    return met.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, k) for n, k in fields]]))


def unit_weights(n: int, rows: np.ndarray, counts: np.ndarray, idfs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """TF-IDF weights of unit length per row, and where each row's entries begin."""
    weights = counts * idfs
    norms = np.sqrt(np.bincount(rows, weights * weights, n)) if n else np.zeros(0)
    return weights / norms[rows], pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())


def _weights(n: int, rows: np.ndarray, counts: np.ndarray, known: Callable) -> tuple[np.ndarray, pa.Array]:
    return unit_weights(n, rows, counts, known("idf").to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0))


def tfidf_rows(df: DataFrame, key: str, text: str, terms: DataFrame, lo: int = 3, hi: int = 5, again: bool = False) -> DataFrame:
    """(key, ix, w): one sparse unit vector per row, indices ascending; ``terms`` comes from ``number_terms``.

    Vectors hold more bytes than twenty times their text; those that are needed ``again`` are made again from slices
    that are written once.
    """

    def vectors(n, rows, ix, counts, known):
        weights, offsets = _weights(n, rows, counts, known)
        return [pa.ListArray.from_arrays(offsets, pa.array(ix, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(weights, pa.float64()))]

    fields = [("ix", T.ArrayType(T.IntegerType())), ("w", T.ArrayType(T.DoubleType()))]
    return weigh(df, text, terms.select("term", "ix", "idf"), vectors, fields, lo, hi, [key], again)


def tfidf(df: DataFrame, key: str, text: str, vocab: DataFrame, rows: int) -> DataFrame:
    """(key, term, weight) with unit length per row; terms outside the vocabulary drop out.

    A slice knows the terms it holds, so entries get their term where they are weighed.
    """

    def entries(n, rows, ix, counts, known):
        weights, offsets = _weights(n, rows, counts, known)
        return [pa.ListArray.from_arrays(offsets, known("term").cast(pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(weights, pa.float64()))]

    fields = [("_terms", T.ArrayType(T.StringType())), ("_weights", T.ArrayType(T.DoubleType()))]
    found = weigh(df, text, cut_lineage(number_terms(vocab, rows)), entries, fields, keep=[key])
    cells = found.select(key, F.explode(F.arrays_zip("_terms", "_weights")).alias("_c"))
    return cells.select(key, F.col("_c._terms").alias("term"), F.col("_c._weights").alias("weight"))


class TermTable:
    """Vocabulary as sorted numbers per window length; unknown characters have the code 0."""

    def __init__(self, terms: list[str]):
        points = np.frombuffer("".join(terms).encode("utf-32-le"), dtype=np.uint32)
        self.size = len(terms)
        self.alphabet = np.unique(points)
        self.base = len(self.alphabet) + 1
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        self.codes = np.zeros(CODE_POINTS, dtype=np.int64)
        self.codes[self.alphabet] = np.arange(len(self.alphabet)) + 1
        codes = self.codes[points]
        self.plain = {t: i for i, t in enumerate(terms)} if self.base ** int(sizes.max(initial=1)) >= 2 ** 63 else None
        self.by_length = {}
        for n in np.unique(sizes).tolist() if self.plain is None else []:
            which = np.flatnonzero(sizes == n)
            keys = np.zeros(len(which), dtype=np.int64)
            for j in range(n):
                keys = keys * self.base + codes[starts[which] + j]
            order = np.argsort(keys)
            self.by_length[n] = (keys[order], which[order])

    def count(self, texts: list[str], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term index, count) of known windows, in row and index order."""
        if self.plain is not None:
            return self._count_plain(texts, lo, hi)
        sizes = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        codes = self.codes[points]
        owners, ends = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
        found, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n in range(lo, hi + 1):
            if n not in self.by_length or len(points) < n:
                continue
            keys, ix = self.by_length[n]
            key = _window_keys(codes, self.base, n)
            inside = np.arange(len(key)) + n <= ends[:len(key)]
            key, rows, span = key[inside], owners[:len(key)][inside], self.base ** n
            if span * len(texts) < 2 ** 63:  # equal windows of a text are added up before they are looked up
                both, counts = np.unique(rows * span + key, return_counts=True)
                rows, key = np.divmod(both, span)
            else:
                counts = np.ones(len(key), dtype=np.int64)
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[spot] == key
            found.append((rows * self.size + ix[spot])[hit])
            times.append(counts[hit])
        both, counts = np.concatenate(found), np.concatenate(times)
        order = np.argsort(both, kind="stable")
        both, starts = np.unique(both[order], return_index=True)
        counts = np.add.reduceat(counts[order], starts) if len(starts) else counts
        rows, ix = np.divmod(both, max(self.size, 1))
        return rows, ix, counts

    def _count_plain(self, texts: list[str], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells = [
            (row, self.plain[term], n)
            for row, text in enumerate(texts)
            for term, n in Counter(text[i:i + w] for w in range(lo, hi + 1) for i in range(len(text) - w + 1)).items()
            if term in self.plain
        ]
        table = np.array(sorted(cells), dtype=np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]


def fit_tfidf_rows(
    df: DataFrame, key: str, text: str, min_df: int = 2, max_terms: int | None = None, again: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary over all rows of df and their vectors."""
    terms = cut_lineage(number_terms(text_vocab(df, text, min_df, max_terms), df.count()))
    return tfidf_rows(df, key, text, terms, again=again), terms
