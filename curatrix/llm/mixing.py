"""Mixing by soft membership: domain posteriors, then nonnegative rates per document that meet token targets.

A multinomial naive Bayes over byte pairs, learnt from a labelled table, gives every document a posterior over
domains. A document with w words and posterior p adds rate * w * p to the domains' expected tokens. The rates
minimise the squared misses of the targets over rate >= lower, by accelerated projected gradient steps in the
metric that weighs documents by their words, starting from one rate for all.

A step needs from the data only the domains' totals at the present point, K sums. A document's rate follows from
its posterior and the list of the past steps' K-vectors, so no per-document state is kept between passes: each
pass replays the steps on the narrow posterior table and returns K sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import save, text_bytes, wide

PAIRS = 1 << 16
FIT_ROWS = 20_000
TEMPERATURE_WORDS = 50  # evidence of a longer text counts as of so many words, which keeps memberships soft


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    log_prior: tuple[float, ...]
    log_pair: object  # float32 array, one row per domain

    def posterior(self, text: bytes):
        import numpy as np

        logit = np.array(self.log_prior)
        if len(text) > 1:
            octets = np.frombuffer(text, np.uint8).astype(np.int32)
            seen = np.bincount((octets[:-1] << 8) | octets[1:], minlength=PAIRS) if len(text) > 20_000 else None
            if seen is None:
                evidence = self.log_pair[:, (octets[:-1] << 8) | octets[1:]].mean(1, dtype=np.float64)
            else:
                evidence = (self.log_pair @ seen.astype(np.float32)).astype(np.float64) / (len(text) - 1)
            logit = logit + evidence * min(len(text) - 1, TEMPERATURE_WORDS)
        p = np.exp(logit - logit.max())
        return p / p.sum()


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                domain_col: str = "domain", fit_rows: int = FIT_ROWS) -> DomainModel:
    """Naive Bayes over byte pairs from at most `fit_rows` labelled ids, chosen by hash of the id.

    Rows with null id, domain or text teach nothing. An id with several domains counts for each. Without labelled
    rows there is the one domain ''.
    """
    import numpy as np

    known = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where(
        "id is not null and domain is not null").distinct()
    chosen = known.orderBy(F.xxhash64("id", F.lit("domain-fit")), "id", "domain").limit(fit_rows)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for text, domain in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                rows[domain] = rows.get(domain, 0) + 1
                octets = np.frombuffer(text, np.uint8).astype(np.int32)
                if len(octets) > 1:
                    total.setdefault(domain, np.zeros(PAIRS, np.int64))
                    total[domain] += np.bincount((octets[:-1] << 8) | octets[1:], minlength=PAIRS)
        for domain, n in rows.items():
            held = total.get(domain, np.zeros(PAIRS, np.int64))
            pair = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([domain] * (len(pair) + 1), pa.string()), pa.array(np.r_[-1, pair]), pa.array(np.r_[n, held[pair]])],
                names=["domain", "pair", "n"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(
        F.broadcast(chosen), "id").select("text", "domain")
    counts = (texts.mapInArrow(count, "domain string, pair long, n long").groupBy("domain", "pair")
              .agg(F.sum("n").alias("n")).toPandas())
    domains = sorted(set(counts["domain"])) or [""]
    table = np.full((len(domains), PAIRS), 0.5)
    prior = np.ones(len(domains))
    for k, domain in enumerate(domains):
        own = counts[counts["domain"] == domain]
        pairs = own[own["pair"] >= 0]
        table[k, pairs["pair"].to_numpy(int)] += pairs["n"].to_numpy(float)
        prior[k] += own[own["pair"] < 0]["n"].sum()
    log_pair = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
    return DomainModel(tuple(domains), tuple(np.log(prior / prior.sum()).tolist()), log_pair)


def memberships(docs: DataFrame, model: DomainModel, text_col: str = "text", mixed: Mix | None = None) -> DataFrame:
    """docs with tokens (white-space words of the whole text), posterior (over model.domains) and, if mixed, rate."""
    broadcast = docs.sparkSession.sparkContext.broadcast((model, mixed))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model, mixed = broadcast.value
        for batch in batches:
            texts = list(text_bytes(batch.column(text_col)))
            p = np.array([model.posterior(t) for t in texts]).reshape(len(texts), len(model.domains))
            tokens = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
            offsets = np.arange(0, p.size + 1, len(model.domains), dtype=np.int32)
            new = [pa.array(tokens), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel()))]
            new += [pa.array(mixed.rates(p))] if mixed else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *new],
                                             names=[*batch.schema.names, "tokens", "posterior", "rate"][: batch.num_columns + len(new)])

    schema = [*docs.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]
    schema += [T.StructField("rate", T.DoubleType())] if mixed else []
    return wide(docs).mapInArrow(run, T.StructType(schema))


@dataclass(frozen=True)
class Mix:
    """Solved rates: the steps to replay, the targets, and the expected tokens reached."""

    domains: tuple[str, ...]
    targets: tuple[float, ...]
    expected: tuple[float, ...]
    steps: tuple[tuple[float, ...], ...]
    start: float
    lower: float

    def rates(self, posterior, ahead: bool = False):
        """Each step moves a point by its inner product with the posterior and cuts it at lower; the next point lies
        ahead in the direction of the last move. ahead: that next point, at which the next step is measured."""
        import numpy as np

        rate = point = np.full(len(posterior), self.start)
        momentum = 1.0
        for step in self.steps:
            last, rate = rate, np.maximum(self.lower, point - posterior @ np.array(step))
            momentum, before = (1 + (1 + 4 * momentum**2) ** 0.5) / 2, momentum
            point = rate + (before - 1) / momentum * (rate - last)
        return point if ahead else rate


def _totals(members: DataFrame, mixed: Mix, ahead: bool = False):
    """Expected tokens per domain under the rates of mixed: one row of sums per task, added up."""
    import numpy as np

    k = len(mixed.domains)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(k)
        for batch in batches:
            tokens = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), k)
            total += (tokens * mixed.rates(p, ahead)) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], names=["k", "s"])

    rows = members.select("tokens", "posterior").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    now = np.zeros(k)
    for row in rows:
        now[row["k"]] = row["s"]
    return now


def fit_rates(members: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float], lower: float = 0.0,
              total: float | None = None, max_steps: int = 40, tolerance: float = 1e-3) -> Mix:
    """Nonnegative least squares for the targets weights / sum(weights) * total; misses weigh 1 / present tokens.

    total None: the least total at which no domain has to shrink, so that rates stay at or above one wherever
    memberships allow. Domains that weights do not name get target zero; named domains unknown to the model, or
    without a token, cannot be filled and are left out of the shares. Stops when every miss is within tolerance
    of the total, when the totals stand still, or after max_steps.
    """
    import numpy as np

    k = len(domains)
    part = lambda i: F.col("tokens") * F.col("posterior")[i]
    sums = [F.sum(part(i)).alias(f"c{i}") for i in range(k)]
    cross = [F.sum(part(i) * F.col("posterior")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
    first = [float(v or 0) for v in members.agg(*sums, *cross).first()]
    present, gram = np.array(first[:k]), np.array(first[k:]).reshape(k, k)
    want = np.array([max(0.0, float(weights.get(d, 0.0))) if present[i] > 0 else 0.0 for i, d in enumerate(domains)])
    start = max(lower, 1.0)
    if want.sum() == 0:
        return Mix(domains, tuple(present.tolist()), tuple((present * start).tolist()), (), start, lower)
    want = want / want.sum()
    filled = want > 0
    total = float((present[filled] / want[filled]).max()) if total is None else total
    target = want * total
    weight = 1 / np.maximum(present, 1.0)  # of a squared miss
    root = np.sqrt(weight)
    size = 1 / max(1e-300, float(np.linalg.eigvalsh(root[:, None] * gram * root[None, :]).max()))
    mixed = Mix(domains, tuple(target.tolist()), (), (), start, lower)
    now, still = present * start, 0
    while len(mixed.steps) < max_steps and np.abs(now - target).max() > tolerance * total and still < 3:
        steps = (*mixed.steps, tuple((size * weight * (now - target)).tolist()))
        mixed = Mix(domains, mixed.targets, (), steps, start, lower)
        before, now = now, _totals(members, mixed, ahead=True)
        still = still + 1 if np.abs(now - before).max() <= 0.03 * tolerance * total else 0
    expected = _totals(members, mixed) if mixed.steps else now
    return Mix(domains, mixed.targets, tuple(expected.tolist()), mixed.steps, start, lower)


def copies(id_col: str = "doc_id", rate_col: str = "rate") -> Column:
    """Whole number of copies whose mean is the rate: the fraction is decided by a hash of the id."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col(rate_col) + u).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], lower: float = 0.0,
        total: float | None = None) -> DataFrame:
    """docs with tokens, posterior (array over domains), domains, rate and copies.

    Null and empty texts have no tokens and get the prior as posterior; their rate is solved like any other and
    moves no total. Repeated rows have equal rates. An empty table gives an empty result. Columns of docs named
    like a new column are replaced.
    """
    docs = docs.drop("tokens", "posterior", "domains", "rate", "copies")
    model = fit_domains(docs, labelled)
    narrow = save(memberships(docs.select("text"), model).select("tokens", "posterior"), "memberships")
    solved = fit_rates(narrow, model.domains, weights, lower, total)
    return (memberships(docs, model, mixed=solved).withColumn("copies", copies())
            .withColumn("domains", F.array(*[F.lit(d) for d in model.domains])))
