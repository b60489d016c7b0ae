import hashlib
from collections import Counter

import pytest

from curatrix.llm import alignment

TEXTS = [
    None, "", " ", "\n\n  two  spaces\tand tabs ", "a", "Plain words, with punctuation: 12345 and 3.14!",
    "<|endoftext|> inside </s> text <s> [INST]", "Grüße aus Köln, l'été à Málaga", "日本語のテキスト と 絵文字 🙂🙃",
    "null \x00 byte", "mark ▁ inside", "the the the the the", "the the the the the", "x" * 5000, "word " * 3000,
]


def brute(texts):
    """Counts by walking the byte cuts of both sides, one text at a time."""
    pair = alignment.pair_of(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    docs = []
    for text in texts:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(pair.bytes_a[t] for t in a) != want or b"".join(pair.bytes_b[t] for t in b) != want:
            a = b = []
        spans = []
        for ids, sizes in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, own = 0, []
            for t in ids:
                own.append((at, at + len(sizes[t]), t))
                at += len(sizes[t])
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[t for s, e, t in side if lo <= s and e <= hi] for side in spans] for lo, hi in zip([0, *cuts], cuts)]
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        first, links = 0, []
        for s, e, t in spans[0]:
            while first < len(spans[1]) and spans[1][first][1] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((t, spans[1][k][2]))
                k += 1
        docs.append((len(a), len(b), len(cuts), links, hashlib.sha256(written.encode()).hexdigest() if a else ""))
    total = Counter(x for d in docs for x in d[3])
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [(na, nb, ng, len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links), digest)
            for na, nb, ng, links, digest in docs]


def rows_of(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in names)) for r in df.collect())


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(k, "clash", t) for k, t in enumerate(TEXTS)], "doc_id long, n_a string, text string")
    want = sorted((True, k, *row) for k, row in enumerate(brute(TEXTS)))
    assert rows_of(alignment.align(docs)) == want


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((True, k, *row) for (k, _), row in zip(kept, brute([t for _, t in kept])))
    assert rows_of(alignment.align(docs)) == want


def test_null_and_repeated_ids_and_no_rows(spark):
    texts = ["same text", "same text", "other"]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2])], "doc_id long, text string")
    assert rows_of(alignment.align(docs)) == sorted((k is not None, k or 0, *row) for k, row in zip([None, None, 7], brute(texts)))
    assert alignment.align(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(alignment.align(nothing)) == [(True, k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_groups_cover_the_bytes(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    pair = alignment.pair_of(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    for r in alignment.alignments(docs).collect():
        text, at = TEXTS[r["doc_id"]], 0
        whole = (" " + (text or "")).encode()
        for g in r["groups"]:
            assert g["start"] == at and g["end"] > at
            at = g["end"]
            assert b"".join(pair.bytes_a[t] for t in g["a"]) == b"".join(pair.bytes_b[t] for t in g["b"]) == whole[g["start"]:g["end"]]
        assert at in (0, len(whole)) and (at or not text or r["doc_id"] in (9, 10))


@pytest.mark.parametrize("run", [1, 40, 1 << 16])
def test_units_encode_as_the_whole(monkeypatch, run):
    pair = alignment.Pair(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    text = " ".join(t for t in TEXTS if t and "\x00" not in t and "▁" not in t) + " don't we'll  end   of 1st line\n\nnext"
    monkeypatch.setattr(alignment, "RUN_CHARS", run)
    assert len(pair.units(text)) > 3000 and " ".join(pair.units(text)) == text
    for _ in range(2):
        [(a, b), (none, _), (c, d)] = pair.encode([text, "mark ▁ inside", text])
        assert a.tolist() == c.tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == d.tolist() == pair.b.encode(text) and not len(none)


def test_units_forgotten_and_met_again(monkeypatch):
    pair = alignment.Pair(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    monkeypatch.setattr(alignment, "UNITS", 5)
    texts = [" ".join(f"word{i % 11}x{j}" for j in range(4)) for i in range(60)]
    for text in texts:
        [(a, b)] = pair.encode([text])
        assert a.tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == pair.b.encode(text)
    assert len(pair.young) + len(pair.old) < 30
