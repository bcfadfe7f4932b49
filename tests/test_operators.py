"""Operators against brute force on small inputs, at block sizes that force many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from rowrelay import Layout
from rowrelay.functions import blocks as BL
from rowrelay.functions import fieldmaps as FM
from rowrelay.operators import batch as BA, fetch as FE, ingest as IN, layout as LA, read as RD, status as ST
from rowrelay.schema import CLAIMS, FIELD_MAP, INDEX, KEY, PRODUCTION, STEP

LOG = f"{STEP} bigint, {INDEX} bigint, field string"


def cells(spark, triples):
    df = spark.createDataFrame(triples, LOG)
    return df.select(
        *KEY, "field", F.lit(0).alias("field_pos"), F.lit("int").alias("dtype"),
        F.array().cast("array<int>").alias("shape"), F.lit(1).cast("bigint").alias("put_seq"),
    )


def claimed(spark, pairs, task="t"):
    rows = [(task, s, i, 1, None) for s, i in pairs]
    return spark.createDataFrame(rows, CLAIMS)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or KEY)).collect())


@pytest.fixture(scope="module")
def random_log():
    rng = random.Random(7)
    names = [f"f{i}" for i in range(4)]
    triples = [(s, i, f) for s in range(3) for i in range(48) for f in names if rng.random() < 0.8]
    taken = {(s, i) for s in range(3) for i in range(48) if rng.random() < 0.2}
    return names, triples, taken


def brute_ready(triples, taken, fields):
    have = set(triples)
    return sorted({(s, i) for s, i, _ in triples if all((s, i, f) in have for f in fields) and (s, i) not in taken})


def brute_groups(ready, n):
    good = set(ready)
    return [(s, i) for s, i in ready if all((s, i // n * n + o) in good for o in range(n))]


@pytest.mark.parametrize("fields", [["f0"], ["f0", "f1"], ["f3", "f1", "f1", "f0", "f2"]])
def test_scan_ready(spark, random_log, fields):
    _, triples, taken = random_log
    log, claims = cells(spark, triples * 2), claimed(spark, taken)
    want = brute_ready(triples, taken, fields)
    assert pairs(FE.scan_ready(log, claims, fields, "t")) == want
    assert pairs(FE.scan_ready(log, claims, fields, "other")) == brute_ready(triples, set(), fields)
    for n in (1, 2, 4):
        assert pairs(FE.scan_ready_groups(log, claims, fields, "t", n)) == brute_groups(want, n)


def test_wide_groups_take_the_two_step_way(spark, random_log, monkeypatch):
    _, triples, taken = random_log
    log, claims = cells(spark, triples), claimed(spark, taken)
    want = brute_groups(brute_ready(triples, taken, ["f0", "f1"]), 2)
    monkeypatch.setattr(FE, "GROUP_BITS", 1)
    assert pairs(FE.scan_ready_groups(log, claims, ["f0", "f1"], "t", 2)) == want


def test_more_fields_than_bits_in_a_word(spark):
    names = [f"c{i}" for i in range(130)]
    triples = [(0, i, f) for i in range(3) for f in names if not (i == 1 and f == "c129")]
    assert pairs(FE.scan_ready(cells(spark, triples), claimed(spark, []), names, "t")) == [(0, 0), (0, 2)]


def test_scan_many_tasks_equals_one_by_one(spark, random_log):
    _, triples, taken = random_log
    log, claims = cells(spark, triples), claimed(spark, taken, "a")
    tasks = {"a": ["f0", "f1"], "b": ["f2"], "c": ["f1", "missing"], "d": []}
    got = pairs(FE.scan_ready_tasks(log, claims, tasks), "task_name", *KEY)
    want = [("a", *p) for p in brute_ready(triples, taken, ["f0", "f1"])]
    want += [("b", *p) for p in brute_ready(triples, set(), ["f2"])]
    assert got == sorted(want)


def test_nothing_asked_or_unknown_is_nothing(spark, random_log):
    _, triples, _ = random_log
    log, none = cells(spark, triples), claimed(spark, [])
    assert FE.scan_ready(log, none, [], "t").count() == 0
    assert FE.scan_ready(log, none, ["f0", "nobody"], "t").count() == 0
    layout = Layout(prompts=48, slots=3)
    steps = spark.createDataFrame([(0,)], f"{STEP} bigint")
    rows, columns = ST.status_mask(log, none, steps, layout, ["f0", "nobody"], "t")
    assert rows.count() == 0 and columns.count() == 0
    rows, columns = ST.status_mask(log, none, steps, layout, ["f0"], "t")
    assert rows.count() == 48 and columns.count() == 1


@pytest.mark.parametrize("limit", [None, 1, 17, 100])
def test_rank_by_block(spark, limit):
    rng = random.Random(3)
    data = [(g, i) for g in range(3) for i in rng.sample(range(500), 20 + 60 * g)]
    df = spark.createDataFrame(data, "g bigint, i bigint")
    got = pairs(BL.rank_by_block(df, ["g"], "i", "r", size="n", limit=limit, width=16), "g", "i", "r", "n")
    want = []
    for g in range(3):
        ordered = sorted(i for h, i in data if h == g)
        want += [(g, i, r, len(ordered)) for r, i in enumerate(ordered) if limit is None or r < limit]
    assert got == sorted(want)


@pytest.mark.parametrize("exact", [False, True])
def test_lowest_of_groups(spark, exact):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), "id").filter("NOT (g = 2 AND id > 50)")
    assert len(pairs(BL.lowest(df, ["g"], "id", 40, "r", exact), "g", "id", "r")) == (80 if exact else 97)


@pytest.mark.parametrize("k", [1, 5, 2000])
@pytest.mark.parametrize("broken", ["g", "id"])
def test_rows_without_place_fail(spark, k, broken):
    df = spark.range(3).select(F.lit(0).cast("bigint").alias("g"), "id")
    df = df.withColumn(broken, F.when(F.col("id") > 0, F.col(broken)))
    with pytest.raises(Exception, match="cannot be placed"):
        BL.lowest(df, ["g"], "id", k, "r").collect()


def test_distinct_per_group_counts_repeats_once(spark):
    df = spark.range(100_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"))
    got = pairs(BL.distinct_per_group(df.unionByName(df), ["g"], "i", "n"), "g", "n")
    assert got == [(0, 50_000), (1, 50_000)]


def test_dense_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id").repartition(7)
    got = pairs(BL.dense_position(df, ["k"], "p"), "p", "k")
    assert got == [(i, i) for i in range(1000)]


def test_row_space_in_blocks(spark):
    layout = Layout(prompts=25, samples=4, slots=3)
    steps = spark.createDataFrame([(1,), (5,)], f"{STEP} bigint")
    got = pairs(RD.row_space(steps, layout, width=16))
    assert got == [(s, i) for s in (1, 5) for i in range(*layout.step_range(s))]


def test_live_rows(spark):
    log = spark.createDataFrame([(0, 1, 5), (0, 2, 9), (1, 1, 5), (1, 2, 9)], f"{STEP} bigint, {INDEX} bigint, put_seq bigint")
    clears = spark.createDataFrame([(0, 3), (0, 7), (2, 99)], f"{STEP} bigint, clear_seq bigint")
    assert pairs(RD.live_rows(log, clears, "put_seq"), STEP, "put_seq") == [(0, 9), (1, 5), (1, 9)]


def test_shards(spark):
    rows = spark.range(6).select(F.col("id").alias(INDEX))
    assert pairs(LA.shard_map(rows, 3), INDEX, "shard_id", "local_index") == [
        (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 0, 1), (4, 1, 1), (5, 2, 1)
    ]
    assert pairs(LA.shard_map(rows, 2).filter(f"{INDEX} = 3"), "local_index") == [(1,)]
    layout = Layout(prompts=6, shards=3)
    checked = LA.capacity_check(spark.range(9).select(F.col("id").alias(INDEX)), layout)
    assert pairs(checked, "shard_id", "rows", "outside", "capacity") == [(0, 3, 1, 2), (1, 3, 1, 2), (2, 3, 1, 2)]


def test_step_ranges(spark):
    layout = Layout(prompts=8, samples=2, slots=2)
    steps = spark.createDataFrame([(5,), (7,), (0,)], f"{STEP} bigint")
    assert pairs(LA.step_ranges(steps, layout).filter(f"{STEP} = 5"), "start_index", "end_index") == [(16, 32)]
    assert pairs(LA.slot_conflicts(steps, layout), "slot", "live_steps") == [(1, 2)]


@pytest.mark.parametrize("samples", [1, 2])
@pytest.mark.parametrize("k", [4, 20, 60])
def test_force_fetch_in_blocks(spark, samples, k):
    rng = random.Random(k)
    layout = Layout(prompts=60 // samples, samples=samples, slots=2)
    taken = {(s, layout.step_range(s)[0] + i) for s in (1, 4) for i in range(60) if rng.random() < 0.3}
    steps = spark.createDataFrame([(1,), (4,), (6,)], f"{STEP} bigint")
    got = FE.force_fetch_rows(steps, claimed(spark, taken | {(4, 999)}), layout, k, "t", samples > 1, width=8)
    want = []
    for s in (1, 4, 6):
        first, end = layout.step_range(s)
        free = [i for i in range(first, end) if (s, i) not in taken]
        free = [i for i in free if all((s, i // samples * samples + o) not in taken for o in range(samples))]
        if len(free) >= k:
            want += [(s, i, r) for r, i in enumerate(free[:k])]
    assert pairs(got, *KEY, "batch_index") == sorted(want)


# --- batches ---------------------------------------------------------------------


def meta_of(spark, n, status=1, batch=0, names=("a",)):
    fields = F.create_map(*[p for x in names for p in (F.lit(x), FM.field_meta(F.lit("int"), F.lit(None), F.lit(status)))])
    return spark.range(n).select(
        F.lit(batch).cast("bigint").alias("batch_id"), F.col("id").alias("batch_index"),
        F.lit(0).cast("bigint").alias(STEP), (F.col("id") + 100).alias(INDEX), fields.cast(FIELD_MAP).alias("fields"),
    )


@pytest.mark.parametrize("rows,chunks,want", [(10, 4, [3, 3, 2, 2]), (3, 5, [1, 1, 1, 0, 0]), (8, 2, [4, 4]), (5, 1, [5])])
def test_chunk_sizes(spark, rows, chunks, want):
    meta = meta_of(spark, rows)
    assert [n for _, n in pairs(BA.chunk_sizes(meta, chunks), "chunk_id", "size")] == want
    parts = BA.chunk(meta, chunks)
    for c, n in enumerate(want):
        assert pairs(parts.filter(F.col("chunk_id") == c), "batch_index") == [(i,) for i in range(n)]
    back = BA.concat_parts(parts, "chunk_id")
    assert pairs(back, "batch_index", INDEX) == pairs(meta, "batch_index", INDEX)


def test_concat_validates_names(spark):
    a, b = meta_of(spark, 2), meta_of(spark, 3, names=("b",))
    with pytest.raises(ValueError):
        BA.concat([a, b])
    assert pairs(BA.concat([a, b], validate=False), "batch_index") == [(i,) for i in range(5)]
    assert BA.concat([]) is None


def test_union(spark):
    left = meta_of(spark, 4, names=("a", "b"))
    right = meta_of(spark, 4, status=0, names=("b", "c")).withColumn("batch_index", 3 - F.col("batch_index"))
    both = BA.union(left, right)
    assert pairs(both, "batch_index", INDEX) == pairs(left, "batch_index", INDEX)
    assert both.select(FM.render_fields(F.col("fields"))).distinct().collect()[0][0] == "a:int:-:1,b:int:-:0,c:int:-:0"
    same = BA.union(left, left)
    assert pairs(same, "batch_index", FM.render_fields(F.col("fields"))) == pairs(left, "batch_index", FM.render_fields(F.col("fields")))
    with pytest.raises(ValueError):
        BA.union(left, right.filter("batch_index > 0"))
    loose = BA.union(left, right.filter("batch_index > 0"), validate=False)
    assert loose.filter(FM.has_field(F.col("fields"), "c")).count() == 3 and loose.count() == 4


def test_empty_batch_is_ready(spark):
    empty = BA.empty(spark)
    assert BA.batch_is_ready(empty).first()[0] is True
    assert BA.batch_is_ready(meta_of(spark, 2, status=0)).first()[0] is False
    assert meta_of(spark, 1).select(FM.is_row_ready(FM.empty_fields())).first()[0] is True
    assert BA.field_names(empty).count() == 0


def test_getitem(spark):
    meta = meta_of(spark, 4)
    assert pairs(BA.getitem(meta, 1), "batch_index", INDEX) == [(0, 101)]
    assert pairs(BA.getitem(meta, -1), "batch_index", INDEX) == [(0, 103)]
    for bad in (4, -5):
        with pytest.raises(Exception, match="out of range"):
            BA.getitem(meta, bad).collect()
    with pytest.raises(TypeError):
        BA.getitem(meta, slice(0, 2))


def test_reorder_subset_and_repeats(spark):
    got = pairs(BA.reorder_list(meta_of(spark, 4), 0, [3, 0, 0, -1]), "batch_index", INDEX)
    assert got == [(0, 103), (1, 100), (2, 100), (3, 103)]
    with pytest.raises(Exception, match="out of range"):
        BA.reorder_list(meta_of(spark, 4), 0, [4]).collect()


def test_add_fields_needs_equal_length(spark):
    data = spark.range(4).select(F.col("id").alias("batch_index"), F.array(F.lit(1.5)).alias("score"))
    got = BA.add_fields(meta_of(spark, 4), data, ["score"], set_all_ready=False)
    assert got.select(FM.render_fields(F.col("fields"))).first()[0] == "a:int:-:1,score:double:[1]:0"
    with pytest.raises(Exception, match="missing on one side"):
        BA.add_fields(meta_of(spark, 3), data, ["score"]).collect()


def test_extract_field_metas_of_every_kind(spark):
    data = spark.createDataFrame(
        [
            (0, 1, 2.0, [1, 2, 3], "text", ([2, 3], [1.0] * 6), ([3, 4, 4], b"x" * 48), ("a", 1)),
            (1, None, None, None, None, None, None, None),
        ],
        "batch_index bigint, n int, x float, ids array<bigint>, s string, m struct<shape:array<int>,data:array<float>>,"
        "img struct<shape:array<int>,data:binary>, obj struct<p:string,q:int>",
    )
    fields = [c for c in data.columns if c != "batch_index"]
    got = dict(pairs(BA.extract_field_metas(data, fields), "batch_index", FM.render_fields(F.col("fields"))))
    assert got[0] == "ids:bigint:[3]:1,img:uint8:[3x4x4]:1,m:float:[2x3]:1,n:int:[]:1,obj:-:-:1,s:-:-:1,x:float:[]:1"
    assert got[1] == "ids:-:-:1,img:-:-:1,m:-:-:1,n:-:-:1,obj:-:-:1,s:-:-:1,x:-:-:1"
    layouts = {r["field"]: r["layout"] for r in BA.layout_report(data.withColumn("batch_id", F.col("batch_index")), fields).filter("batch_id = 0").collect()}
    assert layouts == {"ids": "dense", "img": "dense", "m": "dense", "n": "dense", "obj": "non-tensor", "s": "non-tensor", "x": "dense"}


def test_extra_info_precedence(spark):
    df = spark.range(1).select(
        F.create_map(F.lit("k"), F.lit("first"), F.lit("x"), F.lit("1")).alias("a"),
        F.create_map(F.lit("k"), F.lit("second"), F.lit("y"), F.lit("2")).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    got = df.select(BA.concat_extra_info([a, b]).alias("c"), BA.union_extra_info(a, b).alias("u")).first()
    assert got["c"] == {"k": "first", "x": "1", "y": "2"}
    assert got["u"] == {"k": "second", "x": "1", "y": "2"}


def test_repeat_interleave(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "pos bigint, v string")
    assert pairs(IN.repeat_interleave(df, 3, "pos"), "batch_index", "v") == [
        (0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b")
    ]


def test_production_schema(spark):
    seg = IN.segment(spark.createDataFrame([(0, 0, "x", [1.0])], f"{STEP} bigint, {INDEX} bigint, s string, v array<float>"), ["s", "v"], 3)
    log = IN.production_rows(seg, ["s", "v"])
    assert [f.name for f in log.schema] == [f.name for f in PRODUCTION]
    assert [f.dataType for f in log.schema] == [f.dataType for f in PRODUCTION]


@pytest.mark.parametrize("positions", [[0, 1, 2], [0, 1, 2, 2], [0, 1, 2, 4], [-1, 0, 1, 2], [0, 1, 2, 3, 3], []])
def test_positions_must_be_whole(spark, positions):
    df = spark.createDataFrame([(4, p) for p in positions], f"{STEP} bigint, batch_index bigint")
    good = spark.range(4).select(F.lit(5).cast("bigint").alias(STEP), F.col("id").alias("batch_index"))
    layout = Layout(prompts=4, slots=8)
    assert pairs(IN.insert_positions(good, layout)) == [(5, 20), (5, 21), (5, 22), (5, 23)]
    if positions:
        with pytest.raises(Exception, match="a step needs 4 rows"):
            IN.insert_positions(good.unionByName(df), layout).collect()
    else:
        assert IN.insert_positions(df, layout).count() == 0


def test_live_rows_keeps_one_row_a_cleared_step(spark):
    """A broadcast of clears must not grow with the number of tasks (plan only: 500 partitions of 3 steps)."""
    log = spark.range(60).select((F.col("id") % 3).alias(STEP), F.col("id").alias(INDEX), F.col("id").alias("put_seq"))
    clears = spark.range(3).select(F.col("id").alias(STEP), F.lit(30).cast("bigint").alias("clear_seq"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        plan = RD.live_rows(log, clears, "put_seq")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "Generate" not in plan and "explode" not in plan
    assert pairs(RD.live_rows(log, clears, "put_seq"), "put_seq") == [(i,) for i in range(31, 60)]


@pytest.mark.parametrize("positions", [[0, 1, 2], [3, 1], [0, 1, 2, 3]])
def test_positions_of_a_part_of_a_step(spark, positions):
    df = spark.createDataFrame([(4, p) for p in positions], f"{STEP} bigint, batch_index bigint")
    layout = Layout(prompts=4, slots=8)
    assert pairs(IN.insert_positions(df, layout, whole=False)) == [(4, 16 + p) for p in sorted(positions)]


@pytest.mark.parametrize("positions", [[0, 2, 2], [0, 4], [-1, 0], [0, 1, 2, 3, 3]])
def test_positions_of_a_part_are_checked(spark, positions):
    df = spark.createDataFrame([(4, p) for p in positions], f"{STEP} bigint, batch_index bigint")
    with pytest.raises(Exception, match="a step needs at most 4 rows"):
        IN.insert_positions(df, Layout(prompts=4, slots=8), whole=False).collect()
