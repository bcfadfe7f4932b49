"""Status bitmaps against the logs they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from rowrelay import Exchange, Layout
from rowrelay.operators import bitmaps as BM, fetch as FE
from rowrelay.schema import INDEX, KEY, STEP

LOG = f"{STEP} bigint, {INDEX} bigint, field string, put_seq bigint"
TAKEN = f"task_name string, {STEP} bigint, {INDEX} bigint, claim_seq bigint"


def logs(spark, seed=1, puts=50):
    """Many puts over blocks that are far apart, with repeats, and claims of two tasks."""
    rnd = random.Random(seed)
    places = [(step, base + i) for step in (0, 3, -2) for base in (0, 32_760, 5 * 10**12, -40_000) for i in range(12)]
    cells = [(*rnd.choice(places), rnd.choice(["a", "b", "c"]), put) for put in range(puts) for _ in range(12)]
    taken = [(rnd.choice(["train", "score"]), *rnd.choice(places), n) for n in range(60)]
    return spark.createDataFrame(cells, LOG), spark.createDataFrame(taken, TAKEN)


def index_of(production, claims):
    return BM.production_bitmaps(production).unionByName(BM.claim_bitmaps(claims))


def pairs(df):
    return sorted(map(tuple, df.select(*KEY).collect()))


@pytest.mark.parametrize("fields", [["a"], ["a", "b"], ["c", "a", "b", "a"], ["a", "unknown"], []])
def test_ready_equals_the_log(spark, fields):
    production, claims = logs(spark)
    index = index_of(production, claims)
    for task in ("train", "nobody"):
        want = pairs(FE.scan_ready(production, claims, fields, task))
        assert pairs(BM.ready_rows(index, fields, task)) == want
        counted = {r[STEP]: r["available"] for r in BM.ready_count(index, fields, task).collect()}
        assert counted == {s: sum(1 for x in want if x[0] == s) for s in {x[0] for x in want}}
        groups = pairs(FE.scan_ready_groups(production, claims, fields, task, 4))
        assert pairs(BM.ready_group_rows(index, fields, task, 4)) == groups


def test_all_bits_of_a_block(spark):
    rows = spark.range(-70_000, 70_000, 7).select(F.lit(1).cast("bigint").alias(STEP), F.col("id").alias(INDEX), F.lit("a").alias("field"), F.lit(0).cast("bigint").alias("put_seq"))
    _, claims = logs(spark)
    ready = BM.ready_rows(index_of(rows, claims.filter("false")), ["a"], "t")
    assert pairs(ready) == [(1, i) for i in range(-70_000, 70_000, 7)]


def test_no_log_at_all(spark):
    production, claims = logs(spark)
    index = index_of(production.filter("false"), claims.filter("false"))
    assert BM.ready_rows(index, ["a"], "t").count() == 0 and BM.ready_count(index, ["a"], "t").count() == 0


def test_exchange_polls_bitmaps(spark, folder):
    """Polls, clears, rebuilt and purged bitmaps: as the logs have it, which a poll does not read."""
    ex = Exchange(spark, folder, Layout(prompts=8, samples=2, slots=2))
    rows = spark.range(16).select(F.lit(0).cast("bigint").alias(STEP), F.col("id").alias(INDEX), F.col("id").alias("x"))
    for part in (rows.filter("x < 5"), rows.filter("x BETWEEN 3 AND 9"), rows.filter("x = 12")):
        ex.put_rows(part)
    assert BM.ready_count(ex.status_index(0), ["x"], "t").first()["available"] == 11
    assert ex.get_meta(["x"], 4, 0, task_name="t").count() == 4
    assert pairs(BM.ready_rows(ex.status_index(0), ["x"], "t")) == pairs(FE.scan_ready(ex.production(0), ex.claims("t", 0), ["x"], "t"))
    plan = BM.ready_count(ex.status_index(0), ["x"], "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "put_seq" not in plan and "claim_seq" not in plan
    assert ex._available(["x"], 0, "force_fetch", False, "t") == 12
    with pytest.raises(TimeoutError):
        ex.get_meta(["x"], 8, 0, task_name="t")
    ex.clear(0)
    assert BM.ready_count(ex.status_index(0), ["x"], "t").count() == 0
    ex.put_rows(rows.filter("x < 3"))
    before = pairs(BM.ready_rows(ex.status_index(0), ["x"], "t"))
    ex.purge(0)
    assert before == pairs(BM.ready_rows(ex.status_index(0), ["x"], "t")) == [(0, 0), (0, 1), (0, 2)]
    ex.tables.replace("bitmaps", 0, ex.tables.read("bitmaps").limit(0))  # a writer lost before its bitmaps
    assert ex._available(["x"], 0, "fetch", False, "t") == 0
    assert ex.get_meta(["x"], 3, 0, task_name="t").count() == 3
    assert BM.check_consumption(ex.status_index(0), ex._steps(0), ex.layout, ["t"]).first()["consumed"] == 3


def test_small_steps_take_little_memory(spark):
    """Buffers of a fixed small size in hash tables: no 4 KB for each step, field and put."""
    log = spark.range(3_000).select((F.col("id") % 300).alias(STEP), (F.col("id") % 300 % 8 * 10 + F.floor(F.col("id") / 300)).alias(INDEX), F.lit("a").alias("field"), F.lit(1).cast("bigint").alias("put_seq"))
    index = BM.production_bitmaps(log)
    for made in (index, BM.produced_count(index, ["a"]), BM.ready_count(index, ["a"], "t")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert index.count() <= 2 * 300 and dict(index.dtypes)["bits"] == "bigint"
    assert {r["produced"] for r in BM.produced_count(index, ["a"]).collect()} == {10}
    assert BM.ready_rows(index, ["a"], "t").count() == 3_000
