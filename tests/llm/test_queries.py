"""Registered queries against their SQL, and all others against brute force, on the smallest driver tables."""

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from check_oracles import TABLES, compare
from rowrelay.llm import bpe, licenses
from rowrelay.llm.queries import ORACLES, PATTERN, QUERIES, RANKS
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    line = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert line.startswith("ok"), line


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_near_duplicates(spark, docs):
    got = {r[0]: tuple(r) for r in QUERIES["op4_minhash"](spark, SF_DIR).collect()}
    assert got == brute.near_duplicates([d[:2] for d in docs])


def test_languages(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op5_languages"](spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in docs)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in docs if got[i]["held_out"] and lang]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nearest(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got: dict[int, list] = {}
    for r in QUERIES["op6_nearest"](spark, SF_DIR).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, min(20, len(ids) - 1) + 1))
        scores = x @ x[list(ids).index(q)]
        best = {i for _, i in sorted((-s, i) for i, s in zip(ids.tolist(), scores.tolist()) if i != q)[:20]}
        hits, total = hits + len(best & {r["vec_id"] for r in found}), total + len(best)
        assert all(abs(r["score"] - scores[list(ids).index(r["vec_id"])]) < 1e-12 for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
    assert hits >= 0.9 * total


def test_licenses(spark, docs):
    got = {(r["doc_id"], r["license_id"]) for r in QUERIES["op7_licenses"](spark, SF_DIR).collect()}
    assert got == {(i, name) for i, text, _ in docs for name in brute.licenses(text, licenses.TEMPLATES)}


def test_token_counts_and_bpe(spark, docs):
    coder = brute.tiktoken_encoding(RANKS, PATTERN)
    want = {i: coder.encode_ordinary(t or "") for i, t, _ in docs}
    assert dict(QUERIES["op8_token_counts"](spark, SF_DIR).collect()) == {i: len(x) for i, x in want.items()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op10_byte_bpe"](spark, SF_DIR).collect()}
    assert got == {i: (len(x), *brute.digests(x, docs_text)) for (i, docs_text, _), x in zip(docs, want.values(), strict=True)}


def test_pipeline(spark, docs, duck):
    """Each stage against brute force on what the stage before has kept."""
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in table.collect()}
        table = stage(spark, table, SF_DIR).checkpoint()
        after = {r["doc_id"]: r for r in table.collect()}
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "line_dedup":
            want = brute.line_dedup([(i, r["text"]) for i, r in before.items()])
            assert {i: r["text"] for i, r in after.items()} == want
        else:
            assert all(before[i] == r for i, r in after.items())
        if name == "near_dedup":
            kept = brute.near_duplicates([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i, r in kept.items() if r[3]}
        if name == "decontamination":
            leaked = {i for i, _ in brute.leaks([(i, r["text"]) for i, r in before.items()], bench)}
            assert set(after) == set(before) - leaked
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF_DIR).collect()
    coder = brute.tiktoken_encoding(RANKS, PATTERN)
    assert {r["doc_id"]: r["n_tokens"] for r in last} == {i: len(coder.encode_ordinary(r["text"] or "")) for i, r in after.items()}
    assert bpe.encoder(RANKS, PATTERN).decode(b"") == b""
