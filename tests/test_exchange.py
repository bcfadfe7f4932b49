"""The exchange end to end on small literal inputs."""

import os
import time

import pytest
from pyspark.sql import Window, functions as F

from rowrelay import Exchange, Layout
from rowrelay.functions.fieldmaps import render_fields
from rowrelay.operators import batch as BA
from rowrelay.plans.queries import QUERIES
from rowrelay.schema import INDEX, KEY, STEP

PROMPTS = [[1, 2], [3, 4], [5, 6], [7, 8], [10, 11], [100, 111]]


def rows(df, *columns, order="batch_index"):
    return [tuple(r) for r in df.orderBy(order).select(*columns).collect()]


def prompts(spark, samples, values=PROMPTS):
    from rowrelay.operators.ingest import repeat_interleave

    base = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "pos bigint, input_ids array<bigint>, attention_mask array<bigint>")
    return repeat_interleave(base, samples, "pos").drop("pos")


def address_rows(spark, step, values, schema):
    data = [(step, i, *v) for i, v in values]
    return spark.createDataFrame(data, f"{STEP} bigint, {INDEX} bigint, {schema}")


def test_status_of_a_fresh_exchange(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=8, samples=2, slots=2))
    status = ex.production_status(0, ["anything"])
    assert status.count() == 16 and status.agg(F.sum("anything")).first()[0] == 0
    consumed = ex.consumption_status(0, ["test_task1"])
    assert consumed.count() == 16 and consumed.agg(F.sum("consumed")).first()[0] == 0


def test_production_update(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=8, samples=2, slots=2))
    ex.put(spark.range(16).select(F.col("id").alias("batch_index"), F.lit("x").alias("test_prompts")), global_step=0)
    registry = ex.field_registry().collect()
    assert [(r["field"], r["column_number"]) for r in registry] == [("test_prompts", 0)]
    assert ex.production_status(0).agg(F.sum("test_prompts")).first()[0] == 16
    assert ex.production_status(1).agg(F.sum("test_prompts")).first()[0] == 0
    assert ex.check_production(["test_prompts"], 0) and not ex.check_production(["test_prompts"], 1)
    assert not ex.check_production(["test_prompts", "other"], 0)


def test_insert_meta_and_reorder(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=8, samples=2, slots=2))
    meta = ex.get_meta(["a"], 16, 5, mode="insert").withColumn("batch_id", F.lit(0).cast("bigint"))
    assert [r[0] for r in rows(meta, INDEX)] == list(range(16, 32))
    turned = BA.reorder_list(meta, 0, list(range(15, -1, -1)))
    assert [r[0] for r in rows(turned, INDEX)] == list(range(31, 15, -1))
    assert {r[0] for r in rows(meta, render_fields(F.col("fields")))} == {"a:-:-:0"}
    with pytest.raises(ValueError):
        ex.get_meta(["a"], 15, 5, mode="insert")


def test_round_trip_of_dense_ragged_and_text(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=3))
    data = spark.createDataFrame(
        [
            (0, [1.0, 2.0, 3.0], [-0.5, -1.2, -0.8], "Hello world!"),
            (1, [4.0, 5.0, 6.0], [-0.3, -1.5, -2.1, -0.9], "This is a longer sentence for testing"),
            (2, [7.0, 8.0, 9.0], [-1.1, -0.7], "Test case"),
        ],
        "batch_index bigint, log_probs array<float>, variable_length_sequences array<float>, prompt_text string",
    )
    ex.put(data, global_step=0)
    names = ["log_probs", "variable_length_sequences", "prompt_text"]
    meta = ex.get_meta(names, 3, 0, task_name="read")
    out = ex.get_data(meta, ordered=True)
    assert out.columns == ["batch_index", *KEY, *sorted(names)]
    got = rows(out, "prompt_text", F.size("variable_length_sequences"), "log_probs")
    assert got == [
        ("Hello world!", 3, [1.0, 2.0, 3.0]),
        ("This is a longer sentence for testing", 4, [4.0, 5.0, 6.0]),
        ("Test case", 2, [7.0, 8.0, 9.0]),
    ]
    fields = rows(meta, render_fields(F.col("fields")))
    assert fields[1][0] == "log_probs:float:[3]:1,prompt_text:-:-:1,variable_length_sequences:float:[4]:1"
    report = BA.layout_report(out.withColumn("batch_id", F.lit(0)), names)
    layouts = {r["field"]: r["layout"] for r in report.collect()}
    assert layouts == {"log_probs": "dense", "variable_length_sequences": "ragged", "prompt_text": "non-tensor"}
    with pytest.raises(ValueError):
        ex.get_data(meta, ["no_such_field"])
    assert ex.get_data(meta.limit(0)).count() == 0 and ex.get_data(meta.limit(0), names).count() == 0
    assert ex.get_data(meta, []).columns == ["batch_index", *KEY]


def test_overwrite_of_cells(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=32))
    schema = "log_probs array<bigint>, rewards array<bigint>"
    for client in range(3):
        values = [(10 * client + j, ([client + 3 * j + x for x in range(3)], [10 * client + 10 * j])) for j in range(3)]
        ex.put_rows(address_rows(spark, 0, values, schema))
    ex.put_rows(address_rows(spark, 0, [(0, ([999, 999, 999], [999]))], schema))
    meta = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], f"batch_index bigint, {STEP} bigint, {INDEX} bigint")
    got = rows(ex.get_data(meta, ["log_probs", "rewards"]), "log_probs", "rewards")
    assert got == [([999, 999, 999], [999]), ([3, 4, 5], [10])]
    with pytest.raises(TypeError):
        ex.put_rows(address_rows(spark, 0, [(0, ("text",))], "rewards string"))


def test_written_null_replaces_and_unwritten_stays(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=2))
    ex.put_rows(address_rows(spark, 0, [(0, (1, 2)), (1, (3, 4))], "a int, b int"))
    ex.put_rows(address_rows(spark, 0, [(0, (None,))], "a int"))
    meta = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], f"batch_index bigint, {STEP} bigint, {INDEX} bigint")
    assert rows(ex.get_data(meta, ["a", "b"]), "a", "b") == [(None, 2), (3, 4)]


def test_last_position_wins_within_a_put(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=2))
    meta = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 0, 0)], f"batch_index bigint, {STEP} bigint, {INDEX} bigint")
    ex.put(spark.createDataFrame([(0, "first"), (1, "second"), (2, "other")], "batch_index bigint, a string"), metadata=meta)
    want = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], f"batch_index bigint, {STEP} bigint, {INDEX} bigint")
    assert rows(ex.get_data(want, ["a"]), "a") == [("other",), ("second",)]


def test_reads_are_pruned(spark, folder, capsys):
    ex = Exchange(spark, folder, Layout(prompts=6, slots=200))
    ex.put_rows(spark.range(200).select(F.col("id").alias(STEP), (F.col("id") * 6).alias(INDEX), F.lit(1).alias("a"), F.lit("x").alias("b")))
    meta = spark.createDataFrame([(0, 100, 600)], f"batch_index bigint, {STEP} bigint, {INDEX} bigint")
    data = ex.get_data(meta, ["a"])
    assert rows(data, "a") == [(1,)]
    capsys.readouterr()
    data.explain("formatted")
    scans = [part for part in capsys.readouterr().out.split("\n\n") if "ReadSchema" in part and "fields_written" in part]
    assert scans
    for scan in scans:
        lines = {line.split(":")[0]: line for line in scan.split("\n") if ":" in line}
        assert "step_band" in lines["PartitionFilters"]
        assert "EqualTo(global_step,100)" in lines["PushedFilters"]
        assert "GreaterThanOrEqual(global_index,600)" in lines["PushedFilters"]
        assert "LessThanOrEqual(global_index,600)" in lines["PushedFilters"]
        assert "b:string" not in lines["ReadSchema"]
    many = spark.range(3, 198, 5).select(F.lit(0).alias("batch_index"), F.col("id").alias(STEP), (F.col("id") * 6).alias(INDEX))
    data = ex.get_data(many, ["a"])
    assert rows(data, "a") == [(1,)] * 39
    capsys.readouterr()
    data.explain("formatted")
    assert "GreaterThanOrEqual(global_index,18)" in capsys.readouterr().out
    assert ex.segments().count() == 200 and ex.segments([3, 100]).count() == 2


def test_stages_follow_the_log(spark, folder):
    """Two chained streams; each row is claimed once per stage and a later put is picked up."""
    from rowrelay.session import use_rocksdb_state
    from rowrelay.streaming.pipeline import Stage, run_available

    use_rocksdb_state(spark)
    ex = Exchange(spark, folder, Layout(prompts=6, samples=2, slots=2))
    stages = [
        Stage("generate", ["input_ids"], ["ids"], lambda d: d.withColumn("ids", F.transform("input_ids", lambda x: x + 1)), 4, grouped=True),
        Stage("score", ["ids"], ["total"], lambda d: d.withColumn("total", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)), 12),
    ]
    for step in (0, 1):
        ex.put(prompts(spark, 2), global_step=step)
        handed = run_available(ex, stages, folder + "-streams")
    assert handed["generate"].count() == 24 and handed["score"].groupBy(STEP).count().collect()[0]["count"] == 12
    assert all(ex.check_consumption(task, step) for task in ("generate", "score") for step in (0, 1))
    meta = spark.createDataFrame([(i, 1, 12 + i) for i in range(12)], f"batch_index bigint, {STEP} bigint, {INDEX} bigint")
    want = [(sum(v) + 2,) for v in PROMPTS for _ in range(2)]
    assert rows(ex.get_data(meta, ["total"]), "total") == want


def test_stages_run_together(spark, folder):
    """Two streams at once; batches are cut into chunks, put together in order, united, and cleared at the end."""
    from rowrelay.session import use_rocksdb_state
    from rowrelay.streaming.pipeline import Stage, run_together, united_metadata

    use_rocksdb_state(spark)
    ex = Exchange(spark, folder, Layout(prompts=6, samples=2, slots=2))
    ex.put_rows(spark.range(24).select(F.floor(F.col("id") / 12).alias(STEP), F.col("id").alias(INDEX), (F.col("id") * 10).alias("x")))
    seen = F.size(F.collect_set("chunk_id").over(Window.partitionBy("batch_id"))).cast("bigint")
    stages = [
        Stage("double", ["x"], ["y", "chunks"], lambda d: d.withColumn("chunks", seen).withColumn("y", F.col("x") * 2), 12, workers=5),
        Stage("add", ["x", "y"], ["z"], lambda d: d.withColumn("z", F.col("x") + F.col("y")), 4, workers=3),
    ]
    handed = run_together(ex, stages, folder + "-streams")
    assert {t: b.count() for t, b in handed.items()} == {"double": 24, "add": 24}
    assert not [q for q in spark.streams.active if q.isActive] and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    whole = united_metadata(ex, "double", folder + "-streams").orderBy(STEP, "batch_index").collect()
    assert [(r["batch_index"], r[INDEX]) for r in whole] == [(i % 12, i) for i in range(24)]
    assert len({r["batch_id"] for r in whole}) == 2 and all(set(r["fields"]) == {"x", "y", "chunks"} for r in whole)
    data = ex.get_data(spark.range(24).select(F.col("id").alias("batch_index"), F.floor(F.col("id") / 12).alias(STEP), F.col("id").alias(INDEX)), ["z", "chunks"])
    assert rows(data, "z", "chunks") == [(30 * i, 5) for i in range(24)]
    parts = united_metadata(ex, "add", folder + "-streams").groupBy("epoch", "batch_id").agg(F.array_sort(F.collect_list("batch_index")).alias("p"))
    assert [r["p"] for r in parts.collect()] == [[0, 1, 2, 3]] * 6
    ex.clear_all(united_metadata(ex, "add", folder + "-streams"))
    assert ex.segments().isEmpty() and ex.production().isEmpty() and ex.claims().isEmpty()


def test_writers_of_one_session_at_once(spark, folder):
    """No append loses rows to another one, and sequence numbers differ."""
    from concurrent.futures import ThreadPoolExecutor

    ex = Exchange(spark, folder, Layout(prompts=40))

    def put(i):
        return ex.put_rows(spark.range(5).select(F.lit(0).alias(STEP), (F.col("id") + 5 * i).alias(INDEX), F.lit(i).alias("a")))

    put(0)
    with ThreadPoolExecutor(4) as pool:
        assert len(set(pool.map(put, range(1, 8)))) == 7
    assert ex.segments().count() == ex.production().count() == 40


def test_writers_of_several_sessions_at_once(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    layout = Layout(prompts=40)
    Exchange(spark, folder, layout).put_rows(address_rows(spark, 0, [(0, (0,))], "a int"))

    def put(i):
        own = spark.newSession()
        Exchange(own, folder, layout).put_rows(own.range(5).select(F.lit(0).alias(STEP), (F.col("id") + 5 * i).alias(INDEX), F.lit(i).alias("a")))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(put, range(8)))
    ex = Exchange(spark, folder, layout)
    assert ex.segments().count() == ex.production().count() == 41 and ex.check_production(["a"], 0)


@pytest.mark.parametrize("mode", ["fetch", "force_fetch"])
def test_consumers_of_one_task_at_once(spark, folder, mode):
    """They share no row and leave none, whether they fetch in turn or at once."""
    from concurrent.futures import ThreadPoolExecutor

    layout = Layout(prompts=40)
    Exchange(spark, folder, layout).put(spark.range(40).select(F.col("id").alias("batch_index"), F.lit("x").alias("a")), global_step=0)

    def consume(_):
        ex = Exchange(spark.newSession(), folder, layout)
        return [r[0] for r in rows(ex.get_meta(["a"], 10, 0, mode=mode, task_name="t", wait_seconds=60), INDEX)]

    with ThreadPoolExecutor(3) as pool:
        batches = list(pool.map(consume, range(3)))
    batches.append(consume(0))
    assert sorted(batches) == [list(range(i, i + 10)) for i in range(0, 40, 10)]
    ex = Exchange(spark, folder, layout)
    assert ex.check_consumption("t", 0) and ex.claims("t", 0).count() == 40
    with pytest.raises(TimeoutError):
        ex.get_meta(["a"], 1, 0, mode=mode, task_name="t")


def test_offer_of_a_lost_consumer(spark, folder, monkeypatch):
    """One that is lost after it got its turn, and before its claims are in the table, holds nobody up."""
    from rowrelay.sources.tables import Tables

    tables = Tables(spark, folder)

    def pick(i):
        return lambda seq: spark.createDataFrame([("t", 0, i, seq, 0)], tables.schema("claims"))

    settle = Tables._settle
    with monkeypatch.context() as lost:
        calls = iter([settle, None])
        lost.setattr(Tables, "_settle", lambda self, turns: next(calls)(self, turns))
        with pytest.raises(TypeError):
            tables.claim("t", "0", pick(1))
    assert tables.read("claims").isEmpty()
    seen = []

    def late(seq):
        seen.append(tables.read("claims").count())
        return pick(2)(seq)

    assert tables.claim("t", "0", late) is not None and seen == [1]
    assert sorted(r[INDEX] for r in tables.read("claims").collect()) == [1, 2]
    assert tables.claim("t", "0", lambda seq: pick(3)(seq).limit(0)) is None


def test_only_one_gets_a_name(spark, tmp_path, monkeypatch):
    from rowrelay.session import Files

    files = Files(spark)
    assert files.take(f"{tmp_path}/a/1", "x") and not files.take(f"{tmp_path}/a/1", "y")
    assert files.text(f"{tmp_path}/a/1") == "x" and [c.rsplit("/", 1)[1] for c in files.children(f"{tmp_path}/a")] == ["1"]
    system, target = files._at(f"{tmp_path}/a/1")
    files.record(f"{tmp_path}/a/2", "z")
    with pytest.raises(FileExistsError):
        files._rename_once(system, files._at(f"{tmp_path}/a/2")[1], target)
    files._rename_once(system, files._at(f"{tmp_path}/a/2")[1], files._at(f"{tmp_path}/a/3")[1])
    assert files.text(f"{tmp_path}/a/3") == "z"


def test_put_needs_a_row_for_every_position(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=3))
    meta = ex.get_meta([], 3, 0, mode="insert")
    with pytest.raises(Exception, match="positions without a row"):
        ex.put(spark.createDataFrame([(0, "x"), (1, "y")], "batch_index bigint, a string"), metadata=meta)
    with pytest.raises(ValueError):
        ex.put(spark.createDataFrame([(0, "x")], "batch_index bigint, a string"), metadata=meta.limit(0))


def test_clearing_rows_unsets_cells_but_not_status(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=3))
    ex.put_rows(address_rows(spark, 0, [(i, ([float(i + 1)],)) for i in range(3)], "log_probs array<double>"))
    ex.clear_rows(spark.createDataFrame([(0, 0), (0, 2)], f"{STEP} bigint, {INDEX} bigint"))
    meta = spark.createDataFrame([(i, 0, i) for i in range(3)], f"batch_index bigint, {STEP} bigint, {INDEX} bigint")
    assert rows(ex.get_data(meta, ["log_probs"]), "log_probs") == [(None,), ([2.0],), (None,)]
    assert ex.check_production(["log_probs"], 0)


def test_fetch_takes_each_row_once_per_task(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=6, samples=2))
    ex.put(prompts(spark, 2), global_step=0)
    fields = ["input_ids", "attention_mask"]
    first = ex.get_meta(fields, 6, 0, task_name="generate_sequences")
    second = ex.get_meta(fields, 6, 0, task_name="generate_sequences")
    assert [r[0] for r in rows(first, INDEX)] == [0, 1, 2, 3, 4, 5]
    assert [r[0] for r in rows(second, INDEX)] == [6, 7, 8, 9, 10, 11]
    assert [r[0] for r in rows(first, INDEX)] == [0, 1, 2, 3, 4, 5], "a batch does not change when read again"
    with pytest.raises(TimeoutError, match="asked for 6 rows of step 0, 0 could"):
        ex.get_meta(fields, 6, 0, task_name="generate_sequences")
    assert ex.check_consumption("generate_sequences", 0) and not ex.check_consumption("another", 0)
    assert ex.get_meta(fields, 12, 0, task_name="another").count() == 12
    with pytest.raises(ValueError):
        ex.get_meta(fields, 6, 0)


def test_unknown_and_empty_fields_make_nothing_ready(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=6))
    ex.put(prompts(spark, 1), global_step=0)
    for fields in (["input_ids", "missing"], []):
        with pytest.raises(TimeoutError):
            ex.get_meta(fields, 1, 0, task_name="t")


def test_grouped_fetch_needs_whole_unconsumed_groups(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=6, samples=2))
    ex.put(prompts(spark, 2), global_step=0)
    assert [r[0] for r in rows(ex.get_meta(["input_ids"], 1, 0, task_name="t"), INDEX)] == [0]
    grouped = ex.get_meta(["input_ids"], 4, 0, get_n_samples=True, task_name="t")
    assert [r[0] for r in rows(grouped, INDEX)] == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        ex.get_meta(["input_ids"], 3, 0, get_n_samples=True, task_name="t")
    with pytest.raises(TimeoutError, match="8 rows of step 0, 6 could"):
        ex.get_meta(["input_ids"], 8, 0, get_n_samples=True, task_name="t")


def test_force_fetch_ignores_readiness(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=4))
    ex.put_rows(address_rows(spark, 0, [(1, (7,))], "a int"))
    meta = ex.get_meta(["a", "never"], 2, 0, mode="force_fetch", task_name="t")
    assert rows(meta, INDEX, render_fields(F.col("fields"))) == [(0, "a:-:-:0,never:-:-:0"), (1, "a:int:[]:1,never:-:-:0")]
    assert [r[0] for r in rows(ex.get_meta(["a"], 2, 0, mode="force_fetch", task_name="t"), INDEX)] == [2, 3]
    with pytest.raises(TimeoutError):
        ex.get_meta(["a"], 1, 0, mode="force_fetch", task_name="t")


def test_put_again_does_not_rearm_and_clear_does(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=6))
    ex.put(prompts(spark, 1), global_step=0)
    ex.get_meta(["input_ids"], 6, 0, task_name="t")
    ex.put(prompts(spark, 1), global_step=0)
    with pytest.raises(TimeoutError):
        ex.get_meta(["input_ids"], 1, 0, task_name="t")
    ex.clear(0)
    assert ex.production_status(0).agg(F.sum("input_ids")).first()[0] == 0
    assert ex.field_registry().count() == 2, "the registry outlives a clear"
    assert not ex.check_consumption("t", 0)
    ex.put(prompts(spark, 1), global_step=0)
    assert ex.get_meta(["input_ids"], 6, 0, task_name="t").count() == 6


def test_steps_sharing_a_slot_do_not_mix(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=6, slots=2))
    ex.put(prompts(spark, 1), global_step=1)
    with pytest.raises(TimeoutError):
        ex.get_meta(["input_ids"], 1, 3, task_name="t")
    assert [r[0] for r in rows(ex.get_clear_meta(3), INDEX)] == list(range(6, 12))


def test_a_step_must_be_put_whole(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=7))
    with pytest.raises(Exception, match="a step needs 7 rows"):
        ex.put(prompts(spark, 1), global_step=0)
    with pytest.raises(ValueError):
        ex.put(prompts(spark, 1))


def test_unnumbered_input_is_ordered_by_key(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=50))
    data = spark.range(50).select((49 - F.col("id")).alias("rank"), F.concat(F.lit("v"), "id").alias("a"))
    ex.put(data, global_step=0, order_by=["rank"])
    got = rows(ex.get_data(ex.get_meta(["a"], 50, 0, task_name="t"), ["a", "rank"]), "rank", "a")
    assert got == [(i, f"v{49 - i}") for i in range(50)]


def test_compaction_keeps_the_cells(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=6, slots=4))
    for step in (0, 1):
        ex.put(prompts(spark, 1), global_step=step)
    ex.put_rows(address_rows(spark, 0, [(2, ("x",)), (3, ("y",))], "note string"))
    ex.put_rows(address_rows(spark, 0, [(2, ("z",))], "note string"))
    ex.clear(1)
    meta = spark.createDataFrame([(i, 0, i) for i in range(6)], f"batch_index bigint, {STEP} bigint, {INDEX} bigint")
    before = rows(ex.get_data(meta, ["input_ids", "note"]), "input_ids", "note")
    ex.compact(0)
    assert ex.tables.read("segments").count() == 8  # one overwritten note is gone
    assert rows(ex.get_data(meta, ["input_ids", "note"]), "input_ids", "note") == before
    assert [b[1] for b in before] == [None, None, "z", "y", None, None]


def test_two_stage_flow(spark, folder):
    """Prompts, generation in two chunks, scoring on what was generated, union, clear."""
    ex = Exchange(spark, folder, Layout(prompts=8, samples=2, shards=2))
    ex.put(prompts(spark, 2, PROMPTS + [[200, 222], [300, 333]]), global_step=0)
    fields = ["input_ids", "attention_mask"]
    meta = ex.get_meta(fields, 16, 0, task_name="generate_sequences").withColumn("batch_id", F.lit(0).cast("bigint"))
    chunks = BA.chunk(meta, 2)
    outputs = []
    for part in range(2):
        one = chunks.filter(F.col("chunk_id") == part).drop("chunk_id")
        data = ex.get_data(one, ["input_ids"])
        out = data.select(
            "batch_index", F.transform("input_ids", lambda x: x + 1).alias("generate_sequences_ids"),
            F.lit("test_str").alias("non_tensor_data"),
        )
        ex.put(out, metadata=one)
        outputs.append(BA.add_fields(one, out, ["generate_sequences_ids", "non_tensor_data"]))
    meta = BA.concat(outputs)
    assert [r[0] for r in rows(meta, INDEX)] == list(range(16))
    log_prob = ex.get_meta(fields + ["generate_sequences_ids"], 16, 0, task_name="compute_old_log_prob")
    log_prob = log_prob.withColumn("batch_id", F.lit(0).cast("bigint"))
    data = ex.get_data(log_prob)
    assert rows(data, "generate_sequences_ids")[0:3] == [([2, 3],), ([2, 3],), ([4, 5],)]
    out = data.select("batch_index", F.lit(0.5).alias("old_log_prob"))
    ex.put(out, metadata=log_prob)
    both = BA.union(meta, BA.add_fields(log_prob, out, ["old_log_prob"]))
    names = BA.field_names(both).first()["field_names"]
    assert names == ["attention_mask", "generate_sequences_ids", "input_ids", "non_tensor_data", "old_log_prob"]
    assert BA.batch_is_ready(both).first()[0]
    ex.clear(0)
    with pytest.raises(TimeoutError):
        ex.get_meta(fields, 1, 0, task_name="anyone")


def test_loop_of_the_readme(spark, folder):
    """Read a batch, add a column made by split, put it back by the same metadata, twice."""
    ex = Exchange(spark, folder, Layout(prompts=4, samples=2))
    texts = spark.range(8).select(F.col("id").alias("batch_index"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    ex.put(texts, global_step=0)
    meta = ex.get_meta(["text"], 8, 0, task_name="generate")
    for _ in range(2):
        data = ex.get_data(meta)
        ex.put(data.select("*", F.split("text", " ").alias("words")).drop("text"), metadata=meta)
    score = ex.get_meta(["text", "words"], 8, 0, task_name="score")
    assert [r[0] for r in rows(ex.get_data(score, ["words"]), "words")] == [["a", "b", str(i)] for i in range(8)]
    ex.clear(0)


def test_unnumbered_rows_of_several_steps(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=10, slots=4))
    data = spark.range(30).select(F.pmod("id", F.lit(3).cast("bigint")).alias(STEP), (29 - F.col("id")).alias("rank"))
    ex.put(data, order_by=["rank"])
    got = ex.segments().groupBy(STEP).agg(F.sort_array(F.collect_list(F.struct(INDEX, "rank"))).alias("all")).collect()
    assert len(got) == 3
    for r in got:
        ranks = [x["rank"] for x in r["all"]]
        assert ranks == sorted(ranks) and [x[INDEX] for x in r["all"]] == list(range(10 * r[STEP], 10 * r[STEP] + 10))


def test_late_clear_after_compaction(spark, folder):
    """A clear of step 0 that lands after compaction with a sequence between the puts of steps 0 and 1."""
    ex = Exchange(spark, folder, Layout(prompts=4, slots=4))
    ex.put(spark.range(4).select(F.col("id").alias("batch_index"), F.lit("x").alias("a")), global_step=0)
    between = ex.tables.next_seq()
    ex.put(spark.range(4).select(F.col("id").alias("batch_index"), F.lit("y").alias("a")), global_step=1)
    ex.compact(0)
    ex.tables.append_record("clears", 0, between)
    assert [tuple(r) for r in ex.segments().groupBy(STEP).count().collect()] == [(1, 4)]


def test_waiting_fetch_survives_a_clear(spark, folder, monkeypatch):
    """The step is cleared and filled again while the fetch waits: its claims are newer than the clear."""
    ex = Exchange(spark, folder, Layout(prompts=4))
    prompt = spark.range(4).select(F.col("id").alias("batch_index"), F.lit("x").alias("a"))
    turns = []

    def refill(_seconds):
        if not turns:
            ex.clear(0)
            ex.put(prompt, global_step=0)
        turns.append(1)

    class Clock:
        monotonic, sleep = staticmethod(time.monotonic), staticmethod(refill)

    monkeypatch.setattr("rowrelay.plans.exchange.time", Clock)
    meta = ex.get_meta(["a"], 4, 0, task_name="t", wait_seconds=60)
    assert meta.count() == 4 and len(turns) == 1
    assert ex.tables.read("claims").count() == 4


def test_purge_frees_rows(spark, folder):
    ex = Exchange(spark, folder, Layout(prompts=4, slots=4))
    for step in (0, 1):
        ex.put(spark.range(4).select(F.col("id").alias("batch_index"), F.lit("x").alias("a")), global_step=step)
        ex.get_meta(["a"], 4, step, task_name="a/b: c")
    ex.clear(0)
    ex.purge(0)
    assert ex.stored_rows() == {"segments": 4, "production": 4, "claims": 4, "clears": 1}
    ex.clear(1)
    ex.purge(0)
    assert ex.stored_rows() == {"segments": 0, "production": 0, "claims": 0, "clears": 2}
    ex.put(spark.range(4).select(F.col("id").alias("batch_index"), F.lit("z").alias("a")), global_step=0)
    assert ex.get_meta(["a"], 4, 0, task_name="a/b: c").count() == 4


@pytest.mark.parametrize("lost", ["before", "between", "after"])
def test_crash_while_a_folder_is_replaced(spark, folder, monkeypatch, lost):
    """The cells are the same wherever ``compact`` was cut off, once the tables are recovered."""
    ex = Exchange(spark, folder, Layout(prompts=2, samples=2, slots=2))
    for value in ("a", "b"):
        ex.put_rows(address_rows(spark, 0, [(i, (value + str(i),)) for i in range(4)], "x string"))
    tables = type(ex.tables)
    if lost == "before":  # rows aside, no record yet
        monkeypatch.setattr("rowrelay.session.Files.record", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    elif lost == "between":  # the folder is gone, its rows are aside
        monkeypatch.setattr(tables, "_take_over", lambda self, aside: (self._files().delete(self._files().text(f"{aside}/folder")), 1 / 0))
    else:  # all written, the record is still there
        delete = lambda self, path: (_ for _ in ()).throw(RuntimeError("lost"))
        monkeypatch.setattr("rowrelay.session.Files.delete", delete)
    with pytest.raises((RuntimeError, ZeroDivisionError)):
        ex.compact(0)
    monkeypatch.undo()
    again = Exchange(spark, folder, ex.layout)
    assert again.recover() == (lost != "before") and again.recover() == 0
    meta = again.get_meta(["x"], 4, 0, mode="insert")
    assert rows(again.get_data(meta, ["x"]), "x") == [("b0",), ("b1",), ("b2",), ("b3",)]
    assert again.stored_rows()["segments"] == (8 if lost == "before" else 4)


def doc_tables(spark, folder, n, labelled=3):
    """Documents 0 to n - 1 and labels of every third one, in folders of several files as Spark writes them."""
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), (100 - F.col("id") % 11).alias("n_chars"),
    )
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.range(0, n, labelled).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.repartition(2).write.parquet(f"{folder}/labels.parquet")


def test_unnumbered_rows_of_a_step_that_is_not_full(spark, folder):
    doc_tables(spark, folder, 47)
    got = {r["doc_id"]: (r[STEP], r[INDEX]) for r in QUERIES["a1_put_unnumbered"](spark, folder).collect()}
    order = sorted(range(47), key=lambda i: (i // 40, 100 - i % 11, i))
    assert got == {i: (i // 40, p) for p, i in enumerate(order)}


def test_small_steps_share_a_folder(spark, tmp_path):
    """300 steps of 4 rows are one folder for each put, whose steps are still told apart; folders begun without a record keep 64."""
    layout = Layout(prompts=4, slots=512)
    rows = spark.range(1200).select(F.expr("id div 4").alias(STEP), F.col("id").alias(INDEX), F.col("id").alias("a"))
    for path, folders in ((f"{tmp_path}/new", 1), (f"{tmp_path}/old", 5)):
        if folders > 1:
            spark.range(0).write.parquet(f"{path}/production")
        Exchange(spark, path, layout).put_rows(rows)
        for name in ("segments", "bitmaps"):
            assert len([p for p in os.listdir(f"{path}/{name}") if p.startswith("step_band=")]) == folders
        again = Exchange(spark, path, Layout(prompts=1 << 20))  # what was recorded counts, not the reader's own layout
        assert sorted(r["a"] for r in again.segments([299]).collect()) == [1196, 1197, 1198, 1199]
    again.clear(299)
    again.tables.replace("segments", 299, again.segments(span=again.tables.neighbours(299)))
    assert again.tables.neighbours(299) == (256, 319)
    assert again.tables.read("segments").count() == 299 * 4
