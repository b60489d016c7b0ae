"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A term counts where neither neighbour in the lower-cased url is an ASCII letter or digit. A weight of one or more
makes a term strict, a smaller one soft. One strict hit rejects; so do `soft_needed` distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curatrix.llm.common import A_TO_Z

# Rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Example vocabulary: term to weight.
VOCABULARY = {
    "adult": 1.0, "casino": 1.0, "pills": 1.0, "porn": 1.0, "xxx": 1.0, "malware": 1.0,
    "ads": 0.5, "bets": 0.5, "bonus": 0.5, "cheap": 0.5, "click": 0.5, "farm": 0.5, "free": 0.5, "spam": 0.5,
    "track": 0.5, "win": 0.5,
}
SOFT_NEEDED = 2
LOWER = str.maketrans(A_TO_Z, A_TO_Z.lower())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host follows the first :// up to / ? # or the end, the path goes on up to ? # or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = min((rest.partition(c)[0] for c in "?#"), key=len)
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def longest_rule(host: str, path: str, rules: Iterable[tuple[str, str, str]]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule for the host or a domain above it whose path starts the url's path."""
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), r), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


class Counter:
    """Automaton over the vocabulary; pickled to the tasks with its terms only."""

    def __init__(self, vocabulary: Mapping[str, float]):
        self.vocabulary = {t.translate(LOWER): float(w) for t, w in vocabulary.items() if t}
        self._automaton = None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "_automaton": None}

    def count(self, url: str) -> dict[str, int]:
        """Occurrences by term, overlapping ones included, with a boundary on both sides."""
        if not self.vocabulary:
            return {}
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term in self.vocabulary:
                self._automaton.add_word(term, term)
            self._automaton.make_automaton()
        text = url.translate(LOWER)
        inside = lambda at: 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()
        found: dict[str, int] = {}
        for end, term in self._automaton.iter(text):
            if not inside(end + 1) and not inside(end - len(term)):
                found[term] = found.get(term, 0) + 1
        return found


def judge(pages: DataFrame, url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES,
          vocabulary: Mapping[str, float] | None = None, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """pages with host, path, rule, verdict, strict_hits, soft_terms and weight.

    strict_hits counts occurrences of strict terms, soft_terms distinct soft ones; weight adds up the weights of all
    occurrences. The verdict (allow or block) is the longest rule's, else the vocabulary's. A null url, or one
    without ://, has an empty host and path, which no rule fits; its text is still held against the vocabulary.
    Rows, repeated ones too, are judged one by one; columns of pages named like a new one are replaced.
    """
    new = ["host", "path", "rule", "verdict", "strict_hits", "soft_terms", "weight"]
    pages = pages.drop(*[c for c in new if c != url_col])
    rules, counter = list(rules), Counter(VOCABULARY if vocabulary is None else vocabulary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for url in batch.column(url_col).to_pylist():
                host, path = split_url(url)
                rule, verdict = longest_rule(host, path, rules)
                hits = counter.count(url or "")
                weight = {t: counter.vocabulary[t] for t in hits}
                strict = sum(n for t, n in hits.items() if weight[t] >= 1)
                soft = sum(w < 1 for w in weight.values())
                own = "block" if strict or soft >= soft_needed else "allow"
                rows.append((host, path, rule, verdict or own, strict, soft, float(sum(weight[t] * n for t, n in hits.items()))))
            kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()]
            columns = list(zip(*rows)) if rows else [()] * len(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=[*batch.schema.names, *new])

    kinds = [T.StringType()] * 4 + [T.LongType()] * 2 + [T.DoubleType()]
    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, *[T.StructField(n, k) for n, k in zip(new, kinds)]]))
