"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowrelay.llm import ann, bpe, decontaminate, langid, licenses, lines, minhash, shards, substrings, tokenfiles
from rowrelay.llm.common import mixed
from rowrelay.llm.queries import PATTERN, RANKS, VOCABULARY
from tests.llm import brute
from tests.llm.data import no_docs, odd_docs, odd_rows, sentence

ROWS = [r[:2] for r in odd_rows()]
NAMED = [r for r in ROWS if r[0] is not None]


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_line_dedup(spark, docs):
    got = lines.deduplicated(docs)
    assert got.columns == docs.columns
    have = Counter((r["doc_id"], r["text"]) for r in got.collect())
    want = brute.line_dedup(list(dict.fromkeys(NAMED)))
    assert have == Counter((i, want[i]) for i, _ in NAMED) + Counter(r for r in ROWS if r[0] is None)
    assert want[14] != dict(NAMED)[14] and want[19] != dict(NAMED)[19]  # something was repeated
    assert lines.deduplicated(no_docs(spark)).count() == 0


def test_decontamination(spark, docs):
    texts = dict(NAMED)
    passage, base = texts[20], texts[1].split()
    items = [
        (1, passage), (2, None), (3, ""), (4, "one two three"), (5, " ".join(base[20:60])), (6, "never seen in any text here"),
        (None, passage), (7, passage.upper()), (8, " ".join([*base[30:70], "extra"])),
    ]
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(docs, bench(spark, items)).collect()}
    assert found == brute.leaks(NAMED, [x for x in items if x[0] is not None])
    assert {(11, 1), (12, 1), (20, 7), (9, 4), (10, 4), (1, 5), (2, 8)} <= set(found)
    clean = decontaminate.clean(docs, bench(spark, items))
    assert clean.columns == docs.columns
    dirty = {i for i, _ in found}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, _ in ROWS if i not in dirty)
    assert decontaminate.clean(docs, bench(spark, [])).count() == len(ROWS)
    assert decontaminate.leaks(no_docs(spark), bench(spark, items)).count() == 0


def test_simhash_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            b ^= 1 << int(bit)
        blocks = [((a >> 8 * i) & 255) ^ ((b >> 8 * i) & 255) for i in range(decontaminate.BLOCKS)]
        assert any(x.bit_count() <= 1 for x in blocks)


def test_decontamination_of_edited_items(spark):
    """Items whose beginning or end is changed, as far as the similarity allows: their SimHash may be far."""
    rnd = random.Random(11)
    rows, items = [], []
    for i in range(400):
        own = sentence(rnd, 20 + i % 40).split()
        items.append((i, " ".join(own)))
        changed = (len(own) - 4) // 7  # of s shingles c change: (s - c) / (s + c) >= 0.75
        other = sentence(rnd, changed, "stuvwxyz").split()
        near = own[:-changed] + other if i % 2 else other + own[changed:]
        rows.append((i, " ".join([sentence(rnd, 10, "ijklmn"), *near, sentence(rnd, 10, "ijklmn")])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(docs, bench(spark, items)).collect()}
    want = {}
    for (i, text), (_, own) in zip(rows, items, strict=True):
        want |= {(i, i): score for score in brute.leaks([(i, text)], [(i, own)]).values()}
    assert len(want) == 400 and found == want


def test_decontamination_of_every_window(spark):
    """Words put in, left out and changed: the best window may start where no shingle of the item points to."""
    rnd = random.Random(12)
    rows, items = [], []
    for i in range(300):
        own = sentence(rnd, 20 + i % 40).split()
        near, middle = list(own), len(own) // 2
        if i % 3 == 0:
            near[0], near[-1] = "xx", "yy"
        if i % 4 == 0:
            near[middle:middle] = ["uu", "vv"][: 1 + i % 2]
        elif i % 4 == 1:
            del near[middle : middle + 1 + i % 2]
        elif i % 4 == 2:
            near = near[: middle + 3] + near[middle:]
        items.append((i, " ".join(own)))
        rows.append((i, " ".join(near if i % 5 == 0 else [sentence(rnd, i % 9, "ijklmn"), *near, sentence(rnd, i % 7, "ijklmn")])))
    # Two items that overlap in one document, and one whose first and last word are changed and that has two more in the middle.
    own = [f"w{i}" for i in range(46)]
    items += [(1000, " ".join(own)), (1001, " ".join(own[5:40]))]
    rows.append((1000, " ".join(["a b c", "x", *own[1:23], "y", "z", *own[23:45], "x", "d e f"])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def found(some):
        return {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(docs, bench(spark, some)).collect()}

    want = {}
    for i, text in rows:
        want |= brute.leaks([(i, text)], [x for x in items if x[0] // 1000 == i // 1000 and (i >= 1000 or x[0] == i)])
    got = found(items)
    assert got == want and len(want) > 150
    assert (1000, 1000) in got and found(items[-2:-1]) == {(1000, 1000): got[1000, 1000]}


def test_decontamination_moves_only_what_it_compares(spark, docs, monkeypatch):
    """Texts without a window that may be similar stay where they are, whole documents do in any case."""
    items = [(1, dict(NAMED)[20]), (4, "one two three"), (4, "one two three"), (9, "aa bb cc dd aa bb cc dd aa bb cc dd")]
    more = docs.unionByName(spark.createDataFrame([(900, "xx aa bb cc dd aa bb cc dd aa bb cc dd yy")], "doc_id bigint, text string"), allowMissingColumns=True)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def found():
        return sorted(decontaminate.leaks(more, bench(spark, items)).collect())

    got = found()
    assert {(r["doc_id"], r["item_id"], r["n_common"], r["n_union"]) for r in got} >= {(900, 9, 8, 8), (9, 4, 2, 2), (10, 4, 2, 2)}
    assert "LeftSemi" in plan(decontaminate.leaks(more, bench(spark, items)))
    clean = plan(decontaminate.clean(more, bench(spark, items)))
    assert "BroadcastHashJoin" in clean and "LeftAnti" in clean and "Exchange hashpartitioning" not in clean.split("LeftAnti")[0]
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert found() == got


def test_shards(spark, docs):
    got = shards.assignment(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, 1 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in ROWS
    )
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert shards.assignment(no_docs(spark)).count() == 0
    few = shards.assignment(docs.limit(3)).collect()
    assert len({r["shard"] for r in few}) == 3 and all(r["slot"] == 0 for r in few)


def test_shards_have_the_mixture(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"))
    got = shards.interleaved(rows).groupBy("source", "shard").count().collect()
    totals = Counter()
    for r in got:
        totals[r["source"]] += r["count"]
    assert all(abs(r["count"] - totals[r["source"]] / 8) <= 2 + 0.05 * totals[r["source"]] / 8 for r in got)


def test_near_duplicates(spark, docs):
    got = minhash.near_duplicates(docs).collect()
    want = brute.near_duplicates(NAMED)
    assert Counter(tuple(r) for r in got if r["doc_id"] is not None) == Counter(want[i] for i, _ in NAMED)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert want[3][2] == -5 and want[8][2] == 7  # near copies and short texts are linked
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in ROWS if i is None or want[i][3])
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_chain_of_near_copies(spark):
    """Neighbours are similar, ends are not: one component without any common centre."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[6 * i : 6 * i + 120])) for i in range(25)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(r) for r in got} == set(brute.near_duplicates(rows).values())
    assert {r["component_id"] for r in got} == {0}


def test_estimate_corrects_for_chance():
    a, b = np.arange(3000, dtype=np.uint64), np.arange(1000, 4000, dtype=np.uint64)
    x, y = minhash.minima(mixed(a)), minhash.minima(mixed(b))
    low = (1 << minhash.BITS) - 1
    agree = ((x & low) == (y & low)).mean()
    assert abs((agree - minhash.CHANCE) / (1 - minhash.CHANCE) - 0.5) < 0.15

def test_languages(spark, docs):
    got = langid.languages(docs).collect()
    assert len(got) == len(ROWS)
    blank = {4, 5, 6, 18}
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in blank or (r["doc_id"] is None and r["score"] == 0))
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert langid.accepted(docs).columns == docs.columns
    assert langid.languages(no_docs(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.languages(unlabelled).collect()} == {"und"}


def test_all_languages_are_learned(spark):
    """More labels than the 64 most frequent, one of them on a single document."""
    rnd = random.Random(4)
    rows = []
    for n in range(80):
        letters = "".join(chr(0x4E00 + 3 * n + i) for i in range(3))
        rows += [(len(rows) + i, sentence(rnd, 30, letters), f"l{n:02}") for i in range(1 if n == 79 else 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.languages == tuple(sorted({r[2] for r in rows}))
    found = {r["row"]["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert {lang for i, _, lang in rows if found[i] == lang} == set(model.languages)
    assert sum(found[i] == lang for i, _, lang in rows) >= 0.95 * len(rows)
    with pytest.raises(ValueError, match="more than 79"):
        langid.fit(docs, F.lit(True), most_languages=79)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=12) * (1 + i % 5)]) for i in range(200)]
    rows += [(200 + i, rows[40][1]) for i in range(120)]  # one common vector
    rows += [(400, None), (420, []), (440, [0.0] * 12), (460, [float("nan")] * 12), (480, [float("inf")] + [1.0] * 11), (500, [None] + [1.0] * 11), (None, [1.0] * 12), (520, [1.0, 2.0]), (520, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("x")).withColumn("class", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    live = dict(r for r in rows if r[0] is not None and (r[0] < 400 or r[0] == 520))
    full = {i: np.array(v + [0.0] * (12 - len(v))) for i, v in live.items()}
    answers: dict[int, list] = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        answers.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(answers) == {i for i in live if i % 20 == 0}
    hits = total = 0
    for q, found in answers.items():
        order = sorted((-float((full[q] * full[i]).sum()), i) for i in full if i != q)
        assert len(found) == 20 and len({i for i, _ in found}) == 20
        hits, total = hits + len({i for _, i in order[:20]} & {i for i, _ in found}), total + 20
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * total
    same = sorted(i for i in full if (full[i] == full[40]).all())
    for q, found in answers.items():  # of equal vectors, the smallest ids
        taken = [i for i, _ in found if i in same]
        assert taken == [i for i in same if i != q][: len(taken)]
    few = ann.nearest(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(0, i) for i in range(1, 5)}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["one long", "two lengths", "mixed", "256 dimensions", "768 dimensions"])
def test_nearest_for_norms_and_dimensions(spark, kind):
    """Recall does not fall with the spread of norms or with the dimension."""
    rng = np.random.default_rng(7)
    dim, n = {"256 dimensions": 256, "768 dimensions": 768}.get(kind, 64), 2400
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[7] *= 10
    if kind == "two lengths":
        x[1::2] *= 5
    if kind == "mixed":
        x *= rng.lognormal(0, 0.5, (n, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got: dict[int, set] = {}
    for r in ann.nearest(df, F.col("vec_id") % 60 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(range(0, n, 60))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(found & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got), hits / (20 * len(got))


def test_nearest_of_equal_scores(spark):
    """One-hot vectors: nearly all products are 0, and the smallest ids of them are the answer."""
    rows = [(i, [float(j == i) for j in range(120)]) for i in reversed(range(120))]
    got: dict[int, list] = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i in range(21) if i != q][:20] for q in range(0, 120, 20)}


def test_licenses(spark, docs):
    own = [("A", "one two three"), ("B", dict(NAMED)[20]), ("C", ""), ("D", "word")]
    got = Counter((r["doc_id"], r["license_id"]) for r in licenses.matches(docs, own).collect())
    assert got == Counter((i, name) for i, t in ROWS for name in brute.licenses(t, [x for x in own if x[1]]))
    text = licenses.TEMPLATES[1][1]
    lost = text.replace("may not use", "may never use")
    around = " ".join(f"filler{i}" for i in range(500))
    rows = [(1, f"{around} {lost} {around}"), (2, text[: len(text) // 2]), (3, f"# {text.upper()}")]
    found = licenses.matches(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("template = 1").collect()
    assert {r["doc_id"] for r in found} == {1, 3}
    assert licenses.matches(no_docs(spark)).count() == 0
    assert all(licenses.retrieval_probability(t) > 0.999 for t in licenses.prepared(licenses.TEMPLATES))


def test_token_files(spark, docs, tmp_path):
    coder = brute.tiktoken_encoding(RANKS, PATTERN)
    want = Counter((i, len(coder.encode_ordinary(t or ""))) for i, t in ROWS)
    tokenfiles.write(docs.coalesce(2), str(tmp_path / "t"), RANKS, PATTERN, VOCABULARY)
    for block in (3, 1000, tokenfiles.BLOCK):  # boundaries cut documents and their ids
        found = tokenfiles.scan(spark, str(tmp_path / "t"), VOCABULARY, block).collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == want
        for name in {r["file"] for r in found}:
            assert sorted(r["number"] for r in found if r["file"] == name) == list(range(sum(r["file"] == name for r in found)))
    assert tokenfiles.token_counts(no_docs(spark), RANKS, PATTERN, VOCABULARY).count() == 0


def test_plain_token_file(spark, tmp_path):
    """A file from elsewhere: no ids of documents, and no separator at its end."""
    ids = np.array([5, 6, VOCABULARY, VOCABULARY, 7, VOCABULARY, 8, 9, 10], "<u2")
    (tmp_path / "part-x").write_bytes(ids.tobytes())
    got = sorted(tuple(r)[1:] for r in tokenfiles.scan(spark, str(tmp_path), VOCABULARY, 2).collect())
    assert got == [(0, 0, 2, None), (1, 3, 0, None), (2, 4, 1, None), (3, 6, 3, None)]


def test_token_files_of_any_name(spark, tmp_path):
    """All but hidden files are read."""
    for name in ("tokens.bin", "part-0", "0001", "_SUCCESS", ".tokens.bin.crc"):
        (tmp_path / name).write_bytes(np.array([5, 6, VOCABULARY], "<u2").tobytes())
    got = {(r["file"].rsplit("/", 1)[1], r["n_tokens"]) for r in tokenfiles.scan(spark, str(tmp_path), VOCABULARY).collect()}
    assert got == {("tokens.bin", 2), ("part-0", 2), ("0001", 2)}


def test_substrings(spark, docs):
    got = substrings.without_repeats(docs).collect()
    want = brute.substrings(list(dict.fromkeys(NAMED)))
    none = [(len(brute.words(t)), 0, " ".join(brute.words(t))) for i, t in ROWS if i is None]
    have = Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in got)
    assert have == Counter((i, *want[i]) for i, _ in NAMED) + Counter((None, *x) for x in none)
    assert want[2][1] and want[12][1] and want[1][1]
    assert substrings.without_repeats(no_docs(spark)).count() == 0


def test_hot_passage_is_spread(spark, monkeypatch):
    """With a small bound the runs of one passage go to several salts, each with the passage."""
    rows = [(i, f"a{i} b{i} " + " ".join(f"p{n}" for n in range(40)) + f" c{i}") for i in range(300)]
    monkeypatch.setattr(substrings, "PER_SALT", 8)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substrings.without_repeats(df).collect()}
    assert got == brute.substrings(rows)


def test_bpe(spark, docs):
    coder = brute.tiktoken_encoding(RANKS, PATTERN)
    both = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    got = both.select("doc_id", "text", "token_ids", "decoded", "score").collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == coder.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.digests(no_docs(spark), RANKS, PATTERN).count() == 0


def test_pipeline_stages_on_odd_and_empty_input(spark, docs, tmp_path):
    bench(spark, [(1, dict(NAMED)[20])]).write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, no_docs(spark)):
        table = start
        for name, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, str(tmp_path)).checkpoint()
            if name != "byte_bpe":
                assert table.columns == docs.columns
        assert table.columns[0] == "doc_id"
