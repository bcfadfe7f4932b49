"""Streams over several micro-batches against the batch operators and brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F, types as T

from rowrelay import Layout
from rowrelay.operators import fetch as FE, read as RD
from rowrelay.plans.queries import QUERIES
from rowrelay.plans.queries.streams import _stream
from rowrelay.schema import CLAIMS, INDEX, KEY, PRODUCTION, STEP
from rowrelay.session import use_rocksdb_state
from rowrelay.streaming import batches as BT, events as EV, ready as RY

LOG = T.StructType(PRODUCTION.fields[:-1])  # without the position inside a put
LAYOUT = Layout(prompts=30, samples=2, slots=2)
FIELDS = ["a", "b", "c"]
TASKS = {"one": ["a", "b"], "two": ["c"]}


@pytest.fixture(scope="module")
def history():
    """Puts in sequence order over three steps; some cells come twice."""
    rng = random.Random(11)
    cells = [(s, LAYOUT.step_range(s)[0] + i, f) for s in range(3) for i in range(60) for f in FIELDS if rng.random() < 0.85]
    cells += rng.sample(cells, 60)
    rng.shuffle(cells)
    return [(s, i, f, 0, None, None, n) for n, (s, i, f) in enumerate(cells)]


def write_parts(spark, rows, schema, folder, parts):
    """Each part becomes one file; the file source takes them in the order of writing."""
    step = -(-len(rows) // parts)
    for p in range(parts):
        part = spark.createDataFrame(rows[p * step : (p + 1) * step], schema)
        part.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_ready(spark, tmp_path, log, **kwargs):
    use_rocksdb_state(spark)
    out = str(tmp_path / "ready")
    query = RY.write_ready(RY.ready_stream(log, LAYOUT, TASKS, width=16, **kwargs), out, str(tmp_path / "cp"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) > 1, "several micro-batches"
    return spark.read.schema(RY.READY_SCHEMA).parquet(out)


def keyed(df, *columns):
    return sorted(tuple(r) for r in df.select("task_name", *KEY, *columns).collect())


@pytest.mark.parametrize("grouped", [False, True])
def test_ready_stream_equals_the_batch_scan(spark, tmp_path, history, grouped):
    folder = str(tmp_path / "log")
    write_parts(spark, history, LOG, folder, 4)
    got = run_ready(spark, tmp_path, stream(spark, LOG, folder), grouped=grouped)
    log, none = spark.read.schema(LOG).parquet(folder), spark.createDataFrame([], CLAIMS)
    want = []
    for task, fields in TASKS.items():
        rows = FE.scan_ready_groups(log, none, fields, task, 2) if grouped else FE.scan_ready(log, none, fields, task)
        want += [(task, *r) for r in rows.select(*KEY).collect()]
    assert keyed(got) == sorted(want), "each row exactly once"


def test_clear_drops_and_rearms(spark, tmp_path):
    folder, marks = str(tmp_path / "log"), str(tmp_path / "clears")
    start = LAYOUT.step_range(1)[0]
    row, other = start, start + 40
    puts = [
        [(1, row, "c", 0, None, None, 1), (0, 5, "c", 0, None, None, 2), (1, other, "a", 0, None, None, 3)],
        [(1, row, "c", 0, None, None, 4)],
        [(1, other, "b", 0, None, None, 11)],
        [(1, row, "c", 0, None, None, 12), (0, 5, "c", 0, None, None, 13)],
        [(1, other, "a", 0, None, None, 14), (1, row, "c", 0, None, None, 5)],
    ]
    clears = [[(0, 0)], [(9, 0)], [(1, 10)], [(9, 0)], [(9, 0)]]
    schema = f"{STEP} bigint, put_seq bigint"
    for cells, cleared in zip(puts, clears, strict=True):
        spark.createDataFrame(cells, LOG).coalesce(1).write.mode("append").parquet(folder)
        spark.createDataFrame(cleared, schema).coalesce(1).write.mode("append").parquet(marks)
    got = run_ready(spark, tmp_path, stream(spark, LOG, folder), clears=stream(spark, schema, marks))
    assert keyed(got, "ready_seq") == sorted(
        [("two", 1, row, 1), ("two", 0, 5, 2), ("two", 1, row, 12), ("one", 1, other, 14)]
    )


def test_batches_are_exact_and_survive_a_repeat(spark, tmp_path, history):
    folder = str(tmp_path / "log")
    write_parts(spark, history, LOG, folder, 4)
    use_rocksdb_state(spark)
    ready = RY.ready_stream(stream(spark, LOG, folder), LAYOUT, TASKS, width=16)
    cutter = BT.BatchCutter(spark, str(tmp_path / "batches"), 7)
    seen = []

    def again(rows, epoch):
        """A micro-batch repeated after a failure cuts the same rows."""
        first = keyed(rows, "batch_no", "batch_index")
        left = cutter._read(epoch).filter("waiting")
        fresh = rows.drop("batch_no", "batch_index").unionByName(left.select(*rows.drop("batch_no", "batch_index").columns))
        if epoch > 0:
            old = cutter._read(epoch - 1).filter("waiting").select("task_name", *KEY)
            fresh = fresh.join(old, ["task_name", *KEY], "left_anti")
        fresh = spark.createDataFrame(fresh.collect(), fresh.schema)
        assert keyed(cutter.cut(fresh, epoch), "batch_no", "batch_index") == first
        seen.append(epoch)

    BT.batch_stream(ready, cutter, str(tmp_path / "cp"), again).awaitTermination()
    assert len(seen) >= 4
    handed = cutter.batches()
    sizes = handed.groupBy("task_name", STEP, "epoch", "batch_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("batch_index").alias("d"), F.max("batch_index").alias("m")
    )
    assert {(r["n"], r["d"], r["m"]) for r in sizes.collect()} == {(7, 7, 6)}
    log, none = spark.read.schema(LOG).parquet(folder), spark.createDataFrame([], CLAIMS)
    for task, fields in TASKS.items():
        rows = handed.filter(F.col("task_name") == task)
        ready_rows = FE.scan_ready(log, none, fields, task)
        assert rows.count() == rows.dropDuplicates(KEY).count(), "no row twice"
        left = ready_rows.join(rows, KEY, "left_anti").groupBy(STEP).count().collect()
        assert all(r["count"] < 7 for r in left), "nothing is held back"


def test_cleared_left_overs_are_not_handed_out(spark, tmp_path):
    schema = f"task_name string, {STEP} bigint, {INDEX} bigint, ready_seq bigint"
    clears = {"rows": []}

    def read_clears():
        return spark.createDataFrame(clears["rows"], f"{STEP} bigint, clear_seq bigint")

    cutter = BT.BatchCutter(spark, str(tmp_path / "batches"), 2, clears=read_clears)
    assert cutter.cut(spark.createDataFrame([("t", 0, 3, 1)], schema), 0).count() == 0
    clears["rows"] = [(0, 5)]
    handed = cutter.cut(spark.createDataFrame([("t", 0, 4, 7)], schema), 1)
    assert handed.count() == 0
    handed = cutter.cut(spark.createDataFrame([("t", 0, 3, 8)], schema), 2)
    assert keyed(handed, "batch_index") == [("t", 0, 3, 0), ("t", 0, 4, 1)]


def test_clears_reach_every_block(spark):
    clears = spark.createDataFrame([(1, 9)], f"{STEP} bigint, put_seq bigint")
    got = [r["_block"] for r in EV.spread_clears(clears, LAYOUT, 16).orderBy("_block").collect()]
    assert got == [3, 4, 5, 6, 7]


def test_notifications(spark):
    schema = EV.NOTIFICATION
    fields = [("x", "bigint", []), ("y", "array<double>", [4])]
    rows = EV.explode_notifications(spark.createDataFrame([(0, [(1, 2), (7, 7)], fields, 5)], schema))
    got = sorted((r[INDEX], r["field"], r["field_pos"], r["dtype"], r["shape"]) for r in rows.collect())
    assert got == [(i, *f) for i in (1, 2, 7) for f in (("x", 0, "bigint", []), ("y", 1, "array<double>", [4]))]
    assert {f.name for f in rows.schema} == {f.name for f in PRODUCTION}


def test_live_rows_and_stream_agree_on_clears(spark):
    log = spark.createDataFrame([(1, 60, 5), (1, 60, 11)], f"{STEP} bigint, {INDEX} bigint, put_seq bigint")
    clears = spark.createDataFrame([(1, 10)], f"{STEP} bigint, clear_seq bigint")
    assert [r["put_seq"] for r in RD.live_rows(log, clears, "put_seq").collect()] == [11]


class _State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def _fed(processor, *events):
    import pandas as pd

    frame = pd.DataFrame(events, columns=["bit", "put_seq"])
    return [int(i) for out in processor.handleInputRows((0, 0), iter([frame]), None) for i in out[INDEX]]


def test_late_clear_keeps_newer_cells():
    block = RY.BlockReadiness([[0, 1]], 2, 4, 1)
    block.state = _State()
    assert _fed(block, (0, 3), (1, 10), (2, 10), (3, 11)) == [0, 1]
    # The clear is older than the second row's cells and than one cell of the first row.
    assert _fed(block, (-1, 5)) == []
    assert _fed(block, (0, 12)) == [0]
    # An old put that arrives after the clear does not count.
    assert _fed(block, (4, 4), (5, 12)) == []
    assert _fed(block, (-1, 20)) == []
    assert block.state.value == (b"", b"", 20)
    assert _fed(block, (0, 21), (1, 21)) == [0]


def test_clears_of_empty_blocks_expire(spark, folder):
    """The state of a cleared step falls to nothing; until then late puts stay dropped, and produced cells never expire."""
    use_rocksdb_state(spark)
    spark.createDataFrame([], "global_step bigint, put_seq bigint").write.parquet(f"{folder}/clears")
    schema = f"{STEP} bigint, {INDEX} bigint, field string, put_seq bigint"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/log")

    def put(step, seq):
        spark.createDataFrame([(step, step * 4 + i, "a", seq) for i in range(4)], schema).write.mode("append").parquet(f"{folder}/log")

    def clear(step, seq):
        spark.createDataFrame([(step, seq)], "global_step bigint, put_seq bigint").write.mode("append").parquet(f"{folder}/clears")

    def until(what):
        end = time.monotonic() + 100
        while not what():
            assert running.isActive and time.monotonic() < end
            time.sleep(0.3)

    def told(step):
        return spark.read.schema(RY.READY_SCHEMA).parquet(f"{folder}/out").filter(F.col(STEP) == step).count()

    def state_rows():
        last = running.lastProgress
        return last.stateOperators[0].numRowsTotal if last and last.stateOperators else -1

    log = spark.readStream.schema(schema).parquet(f"{folder}/log")
    clears = spark.readStream.schema("global_step bigint, put_seq bigint").parquet(f"{folder}/clears")
    ready = RY.ready_stream(log, Layout(prompts=4, slots=4), {"t": ["a"]}, clears=clears, forget_ms=12_000)
    spark.createDataFrame([], RY.READY_SCHEMA).write.parquet(f"{folder}/out")
    put(0, 10)
    put(1, 10)
    running = ready.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(processingTime="500 milliseconds").start(f"{folder}/out")
    try:
        until(lambda: told(0) == told(1) == 4)
        clear(0, 20)
        put(0, 15)
        put(2, 30)
        until(lambda: told(2) == 4)
        until(lambda: state_rows() == 2)
        assert told(0) == 4 and told(1) == 4
        clear(1, 40)
        clear(2, 40)
        until(lambda: state_rows() == 0)
        put(0, 50)
        until(lambda: told(0) == 8)
        assert told(1) == told(2) == 4
    finally:
        running.stop()


def test_pipeline_of_a_step_that_is_not_full(spark, tmp_path):
    """43 documents are one step of 40 and 3 rows of the next, too few for a batch; all labelled."""
    docs = spark.range(43).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(43).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["g5_task_pipeline"](spark, str(tmp_path)).collect()
    assert sorted((r[STEP], r["batch_no"]) for r in rows) == sorted([(0, i // 4) for i in range(40)])
    assert {(r["n_words"], r["score"]) for r in rows} == {(3, 3)}


def test_pipeline_measures_the_rest_of_a_step_that_is_not_full(spark, tmp_path):
    """50 documents are a step of 40 and one of 10: two of those fill no batch of 8, but are measured, too; 48 and 49 are labelled."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled = spark.range(50).filter("id NOT IN (40, 41)")
    labelled.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["g5_task_pipeline"](spark, str(tmp_path)).collect()
    last = {r[INDEX]: (r["batch_no"], r["n_words"], r["score"]) for r in rows if r[STEP] == 1}
    assert last == {40 + i: ((i - 2) // 4, 3, 3) for i in range(2, 10)}
    assert len(rows) == 48


def test_rows_that_fill_no_batch_come_in_a_smaller_one(spark, tmp_path):
    schema = f"task_name string, {STEP} bigint, {INDEX} bigint, ready_seq bigint"
    cutter = BT.BatchCutter(spark, str(tmp_path / "batches"), 3, whole=False)
    for _ in range(2):
        handed = cutter.cut(spark.createDataFrame([("t", 0, i, 1) for i in range(4)] + [("t", 1, 9, 1)], schema), 0)
        assert keyed(handed, "batch_no", "batch_index") == [("t", 0, 0, 0, 0), ("t", 0, 1, 0, 1), ("t", 0, 2, 0, 2), ("t", 0, 3, 1, 0), ("t", 1, 9, 0, 0)]
    handed = cutter.cut(spark.createDataFrame([("t", 0, 5, 2)], schema), 1)
    assert keyed(handed, "batch_no", "batch_index") == [("t", 0, 5, 0, 0)]
    assert cutter.batches().count() == 6


def test_driver_tables_in_folders_are_streams_too(spark, tmp_path):
    """Spark writes a table as a folder of files, all of which a stream has to find."""
    spark.range(20).repartition(3).write.parquet(f"{tmp_path}/rows.parquet")
    single = tmp_path / "single"
    single.mkdir()
    spark.range(20).toPandas().to_parquet(single / "rows.parquet")
    for place in (tmp_path, single):
        out = f"{tmp_path}/out-{place.name}"
        query = _stream(spark, str(place), "rows").writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(20))


def test_cells_are_packed_by_block():
    """One row for a block and task; of the puts of a cell the last one is left, clears are kept."""
    import numpy as np
    import pyarrow as pa

    cells = [(0, 0, 3, 5), (0, 1, 0, 9), (0, 0, 3, 7), (-2, 0, -1, 4), (0, 0, 1, 2), (-2, 0, -1, 6)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells, strict=True)], names=[STEP, "_block", "bit", "put_seq"])
    (packed,) = RY._latest_per_cell(iter([batch.slice(0, 2), batch.slice(2)]))
    got = {(r[STEP], r["_block"]): np.frombuffer(r["cells"], np.int64).reshape(-1, 2).tolist() for r in packed.to_pylist()}
    assert got == {(-2, 0): [[-1, 6]], (0, 0): [[1, 2], [3, 7]], (0, 1): [[0, 9]]}
