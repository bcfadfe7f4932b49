"""Phrase collocations against brute force."""

import random

import pytest

from rowrelay.llm import phrases
from tests.llm import brute
from tests.llm.data import no_docs, odd_docs, odd_rows

SCHEMA = "lang string, text string, doc_id bigint, slice int, n int, w1 string, phrase string, f string, size string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def found(spark, rows):
    got = phrases.collocations(spark.createDataFrame([(*r, None, 1, None, "w1", None, "f", "size") for r in rows], SCHEMA))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def texts(rnd: random.Random, n: int, words: int) -> list[str]:
    vocabulary = [f"W{i}x" for i in range(40)] + ["é", "日本", "A", "a\x00b", " ", "x y"]
    fixed = ["New York City hall", "of the", "In Spite Of the", "b c b c b c"]
    out = []
    for _ in range(n):
        own = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(rnd.randrange(words))]
        out.append("".join(w + rnd.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", "\x0b;"]) for w in own))
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 2_000)  # many slices
    rnd = random.Random(2)
    rows = [(rnd.choice(["en", "de", None, "und", ""]), t) for t in texts(rnd, 700, 30)]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " \t "), ("fr", "..!?\n"), ("es", "one"), (None, "a b")]
    rows += [("de", "Very common line. very common pair")] * 500 + [("it", "same same same same same")] * 20
    got = found(spark, rows)
    assert got == brute.collocations(rows)
    assert {r[0] for r in got} == {"en", "de", "und", "", "it"} and len(got) >= 30


def test_long_text_and_ties(spark):
    rnd = random.Random(3)
    rows = [("en", " ".join(rnd.choice(["a", "b", "c", "d"]) for _ in range(200_000))), ("de", " ".join(f"{x} {x}q" for x in range(200) for _ in range(30)))]
    rows += [("fr", " ".join(f"{x}l {x}m," * 30 for x in range(2100)))]  # more equal scores than are kept
    got = found(spark, rows)
    assert got == brute.collocations(rows)
    assert sum(r[0] == "fr" for r in got) == phrases.KEPT


def test_odd_and_empty_input(spark):
    got = phrases.collocations(odd_docs(spark).drop("n_chars"))
    assert sorted(map(tuple, got.collect())) == brute.collocations([(r[2], r[1]) for r in odd_rows()])
    none = phrases.collocations(no_docs(spark))
    assert none.columns == COLUMNS and none.count() == 0


@pytest.mark.parametrize("factor", [1, 3_000_000])
def test_large_counts(spark, monkeypatch, factor):
    """Products of scores pass 64 bits."""
    rows = [("en", "a b c", 31 * factor * 10**6), ("en", "a b", 40 * factor * 10**6), ("en", "b", 7)]
    counted = []
    for text, n in [(r[1], r[2]) for r in rows]:
        own = text.split()
        counted += [(tuple(own[i : i + size]), n) for size in range(1, 5) for i in range(len(own) - size + 1)]
    f: dict[tuple, int] = {}
    for p, n in counted:
        f[p] = f.get(p, 0) + n
    table = [("en", len(p), " ".join(p), n) for p, n in f.items()] + [("en", 0, "", sum(n for p, n in f.items() if len(p) == 1))]
    monkeypatch.setattr(phrases, "counts", lambda docs: spark.createDataFrame(table, "lang string, size int, phrase string, f bigint"))
    got = {r["phrase"]: r for r in phrases.collocations(spark.range(1)).collect()}
    assert got["a b"]["score"] == 2_000_000 * f["a", "b"] // (f["a",] + f["b",])
    assert got["a b c"]["score"] == min(2_000_000 * f["a", "b", "c"] // (f["a", "b"] + f["c",]), 2_000_000 * f["a", "b", "c"] // (f["a",] + f["b", "c"]))


def test_texts_are_dealt_once(spark):
    made = phrases.windows(spark.createDataFrame([("en", "a b " * 50)], "lang string, text string"))
    assert sum(r["n"] for r in made.collect()) == 100
    assert "ReusedExchange" in made._jdf.queryExecution().executedPlan().toString()
