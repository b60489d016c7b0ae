"""Base spans against the plain expressions, and what bootstrapping adds."""

import random
import re

import pytest

from curatrix.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 8 <= len(digits(m[0])) <= 15]
    return out


@pytest.mark.parametrize("alphabet", ["a@.-_ é", "0129. +-", "0123456789 -", "+(1) 2-3.", "a1@.+- "])
def test_base_spans(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text


def test_known_spans():
    text = "é a.b@c.d. 1.2.3.4, 4111 1111 1111 1111, 256.1.1.1 +1 (736) 555-2678, 4111111111111112 5 4111 1111 1111 1111"
    assert [(k, text[s:e]) for k, s, e in pii.base_spans(text)] == [
        ("email", "a.b@c.d"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (736) 555-2678")]


@pytest.mark.parametrize("text", ["9" * 200_000, "a" * 200_000 + "@", "1.1." * 50_000, "+1 (" * 50_000, "a@" * 50_000, "x1" * 100_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)
    list(pii.candidates(text, []))


SCHEMA = "doc_id long, text string, kind string, spans string, start long"


def rows():
    rng = random.Random(2)
    out = []
    for i in range(40):
        out.append((i, f"please call our desk +1 {rng.randint(200, 999)} 555 {i:04d} today"))
        out.append((100 + i, f"mail w{i} or u{i}@example.com then w{i}"))
    out += [(200, "please call our desk 555-0134 today"), (201, "the part number x-99177 is new"), (202, None), (203, ""),
            (None, "please call our desk 555-0199 today"), (204, "please call our desk 555-0134 today"), (204, "please call our desk 555-0134 today"),
            (205, "word " * 50_000 + "a@b.c")]
    return out


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows()], SCHEMA).repartition(3)
    got = pii.extract(docs).collect()
    assert len(got) == len(rows())
    text_of = dict(rows())
    for r in got:
        base = brute(text_of[r["doc_id"]] or "")
        assert r["base_spans"] == pii.joined(base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(","))
    found = [r["spans"] for r in got if r["n_found"]]
    assert found == ["phone:21:29"] * 4
    assert {r["doc_id"] for r in got if r["n_found"]} == {200, 204, None}


def test_no_patterns_without_enough_seeds(spark):
    docs = spark.createDataFrame([(1, "call +1 736 555 2678 now", "x", "y", 1), (2, "call 555-0134 now", "x", "y", 1)], SCHEMA)
    assert sum(r["n_found"] for r in pii.extract(docs).collect()) == 0


def test_second_round_uses_found_instances(spark):
    """Seeds raise the first context; instances found there raise a second one that has too few seeds itself."""
    known = [("phone", f"+{i}", "2|call us", f"1|us _ {i}") for i in range(60)]
    fresh = [(None, f"555-{i}", "2|call us", f"1|us _ f{i}") for i in range(5)]
    again = [(None, f"555-{i}", "2|ring me", f"1|me _ f{i}") for i in range(5)] + [("phone", f"+{i}", "2|ring me", f"1|me _ {i}") for i in range(8)]
    frame = spark.createDataFrame(known + fresh + again, "kind string, instance string, before string, around string")
    one = {r["pattern"] for r in pii.bootstrap(frame, rounds=1, threshold=0.85).collect()}
    two = {r["pattern"] for r in pii.bootstrap(frame, rounds=2, threshold=0.85).collect()}
    assert one == {"2|call us"} and two == {"2|call us", "2|ring me"}


def test_empty_table(spark):
    assert pii.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_candidates_hold_single_spaces_and_brackets():
    text = "ring (717) 555-0202 or 030 1234 5678. no 2353820953013749 4550997810720808 (12) " + "k9" * 50
    got = [text[s:e] for s, e in pii.candidates(text, [])]
    assert got == ["(717) 555-0202", "030 1234 5678", "2353820953013749", "4550997810720808", "(12)", "k9" * 50]


def test_one_word_on_one_side_finds_numbers_with_spaces(spark):
    """Neither the two words before nor the words on both sides repeat; the word before does, six times."""
    data = [(i, f"{w} dial +1 {200 + i} 555 {i:04d} {w}", "x", "y", 1) for i, w in enumerate(("one", "two", "red", "blue", "green", "sky"))]
    data += [(100, "odd dial (717) 555-0202 so", "x", "y", 1), (101, "odd part 030 1234 5678 so", "x", "y", 1)]
    got = {r["doc_id"]: r["spans"] for r in pii.extract(spark.createDataFrame(data, SCHEMA), threshold=0.75).collect() if r["n_found"]}
    assert got == {100: "phone:9:23"}


def test_ip_of_thousands_of_zeros():
    text = "0" * 5000 + "1.2.3.4"
    assert pii.base_spans(text)[0] == ("ip", 0, len(text))
