"""Streaming operators, run over all available input; the result is read back as a table."""

import time

from pyspark.sql import functions as F

from rowrelay.plans.exchange import Exchange
from rowrelay.plans.queries.registry import DOC_CTE, ORD_CTE, place, query
from rowrelay.schema import KEY, STEP
from rowrelay.session import Files, shared_dir, use_rocksdb_state
from rowrelay.sources import bindings as B
from rowrelay.sources.tables import Tables
from rowrelay.streaming import batches as BT, events as EV, pipeline as PL, ready as RY, waits as WT


def _stream(spark, sf_dir, name):
    """A driver table as a stream of its file, or of the files of its folder."""
    path, rows = f"{sf_dir}/{name}.parquet", spark.readStream.schema(B.table(spark, sf_dir, name).schema)
    if Files(spark).is_folder(path):
        return rows.parquet(path)
    # A file stream cannot begin at a file.
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _line_stream(spark, sf_dir):
    lines = _stream(spark, sf_dir, "lineitem")
    return lines.select(
        *B.address(F.col("l_orderkey"), B.ORD),
        F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("field"),
        F.col("l_linenumber").cast("bigint").alias("put_seq"),
    )


def _collect_ready(spark, ready, columns):
    folder = shared_dir(spark, "ready")
    RY.write_ready(ready, folder, shared_dir(spark, "stream")).awaitTermination()
    return spark.read.schema(RY.READY_SCHEMA).parquet(folder).select(*columns)


@query(
    "g1_production_stream",
    f"""WITH {DOC_CTE} SELECT global_step, global_index, f.field, f.field_pos, f.dtype, '[]' AS shape, doc_id AS put_seq
FROM doc, (VALUES ('text', 0, 'string'), ('lang', 1, 'string'), ('source', 2, 'string'), ('n_chars', 3, 'bigint')) AS f(field, field_pos, dtype)""",
)
def g1_production_stream(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents")
    step, index = B.address(F.col("doc_id"), B.DOC)
    shape = F.array().cast("array<int>").alias("shape")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(docs.schema[f].dataType.simpleString()).alias("dtype"), shape) for f in B.DOC_FIELDS])
    ranges = F.array(F.struct(index.alias("first"), index.alias("last")))
    notices = docs.select(step, ranges.alias("ranges"), fields.alias("fields"), F.col("doc_id").alias("put_seq"))
    tables = Tables(spark, shared_dir(spark, "exchange"), B.DOC)
    EV.append_production(EV.explode_notifications(notices), tables, shared_dir(spark, "stream")).awaitTermination()
    shape = F.concat(F.lit("["), F.array_join("shape", ","), F.lit("]")).alias("shape")
    return tables.read("production").select(*KEY, "field", "field_pos", "dtype", shape, "put_seq")


_TASKS = {"ship": ["l1", "l2"], "price": ["l2", "l3"]}


@query(
    "g2_ready_stream",
    f"""WITH {ORD_CTE},
has AS (SELECT global_step, global_index, bool_or(l_linenumber = 1) AS a, bool_or(l_linenumber = 2) AS b,
               bool_or(l_linenumber = 3) AS c FROM lines GROUP BY 1, 2)
SELECT 'ship' AS task_name, global_step, global_index FROM has WHERE a AND b
UNION ALL SELECT 'price', global_step, global_index FROM has WHERE b AND c""",
)
def g2_ready_stream(spark, sf_dir):
    use_rocksdb_state(spark)
    ready = RY.ready_stream(_line_stream(spark, sf_dir), B.ORD, _TASKS)
    return _collect_ready(spark, ready, ["task_name", *KEY])


@query(
    "g3_ready_group_stream",
    f"""WITH {ORD_CTE},
has AS (SELECT global_step, global_index FROM lines WHERE l_linenumber IN (1, 2) GROUP BY 1, 2 HAVING count(*) = 2),
g AS (SELECT global_step, global_index // 2 AS g FROM has GROUP BY 1, 2 HAVING count(*) = 2)
SELECT 'ship' AS task_name, global_step, CAST(g * 2 + i AS BIGINT) AS global_index, CAST(g AS BIGINT) AS group_id
FROM g, range(2) AS t(i)""",
)
def g3_ready_group_stream(spark, sf_dir):
    use_rocksdb_state(spark)
    ready = RY.ready_stream(_line_stream(spark, sf_dir), B.ORD, {"ship": ["l1", "l2"]}, grouped=True)
    return _collect_ready(spark, ready, ["task_name", *KEY, "group_id"])


@query(
    "g4_batch_stream",
    f"""WITH {ORD_CTE},
has AS (SELECT global_step, global_index FROM lines WHERE l_linenumber IN (1, 2) GROUP BY 1, 2 HAVING count(*) = 2),
q AS (SELECT *, row_number() OVER (PARTITION BY global_step ORDER BY global_index) - 1 AS p,
             count(*) OVER (PARTITION BY global_step) AS c FROM has)
SELECT 'ship' AS task_name, global_step, global_index, CAST(p // 16 AS BIGINT) AS batch_no, CAST(p % 16 AS BIGINT) AS batch_index
FROM q WHERE p < c // 16 * 16""",
)
def g4_batch_stream(spark, sf_dir):
    use_rocksdb_state(spark)
    ready = RY.ready_stream(_line_stream(spark, sf_dir), B.ORD, {"ship": ["l1", "l2"]})
    cutter = BT.BatchCutter(spark, shared_dir(spark, "batches"), 16)
    BT.batch_stream(ready, cutter, shared_dir(spark, "stream")).awaitTermination()
    return cutter.batches().select("task_name", *KEY, "batch_no", "batch_index")


@query(
    "g5_task_pipeline",
    f"""WITH {DOC_CTE},
w AS (SELECT *, len(string_split(text, ' ')) AS words FROM doc WHERE quality IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY global_step ORDER BY global_index) - 1 AS p,
             count(*) OVER (PARTITION BY global_step) AS c FROM w)
SELECT global_step, global_index, CAST(words AS INTEGER) AS n_words, CAST(words * quality AS BIGINT) AS score,
CAST(p // 4 AS BIGINT) AS batch_no FROM q WHERE p < c // 4 * 4""",
)
def g5_task_pipeline(spark, sf_dir):
    """Documents are measured in batches of 8, measured and labelled ones are scored in batches of 4.

    Every document is measured, the rest of a step that is not full in a smaller batch; only full batches are scored.
    """
    use_rocksdb_state(spark)
    exchange = Exchange(spark, shared_dir(spark, "exchange"), B.DOC)
    docs = B.doc_rows(spark, sf_dir)
    place = (F.col("doc_id") - F.col(STEP) * B.DOC.rows_per_step).alias("batch_index")
    exchange.put(docs.select(STEP, place, "text", "n_chars"), whole=False)
    labels = B.table(spark, sf_dir, "labels")
    exchange.put_rows(labels.select(*B.address(F.col("doc_id"), B.DOC), "quality"))
    words = F.size(F.split("text", " "))
    score = (F.col("n_words") * F.col("quality")).cast("bigint")
    stages = [
        PL.Stage("measure", ["text"], ["n_words"], lambda d: d.withColumn("n_words", words), 8, whole=False),
        PL.Stage("score", ["n_words", "quality"], ["score"], lambda d: d.withColumn("score", score), 4),
    ]
    handed = PL.run_available(exchange, stages, shared_dir(spark, "pipeline"))
    rows = handed["score"].select("batch_no", *KEY)
    data = exchange.get_data(rows.select(*KEY), ["n_words", "score"])
    return rows.join(data, KEY).select(*KEY, "n_words", "score", "batch_no")


@query(
    "g5_parallel_pipeline",
    f"""WITH {DOC_CTE},
q AS (SELECT global_step, count(*) // 10 AS b FROM doc WHERE quality IS NOT NULL AND text IS NOT NULL GROUP BY 1)
SELECT global_step, CAST(b AS BIGINT) AS batches, CAST(10 * b AS BIGINT) AS scored, CAST(10 * b AS BIGINT) AS as_computed,
       CAST(45 * b AS BIGINT) AS positions, 'quality,score,words' AS fields, CAST(0 AS BIGINT) AS rows_left
FROM q WHERE b > 0""",
)
def g5_parallel_pipeline(spark, sf_dir):
    """Two stages at once, batches of 10 dealt to three workers; then every step is cleared.

    A step's row tells, by the united metadata, how many rows were scored, how many of them with the score that the
    tables give, the sum of their positions, and how many rows still hold a cell after the clear. Which rows share
    a batch depends on when a stream sees them.
    """
    use_rocksdb_state(spark)
    exchange, folder = Exchange(spark, shared_dir(spark, "exchange"), B.DOC), shared_dir(spark, "pipeline")
    docs = B.doc_rows(spark, sf_dir).filter("text IS NOT NULL")
    exchange.put_rows(docs.select(*KEY, "text"))
    labels = B.table(spark, sf_dir, "labels").filter("quality IS NOT NULL")
    exchange.put_rows(labels.select(*B.address(F.col("doc_id"), B.DOC), "quality"))
    words = F.size(F.split("text", " "))
    score = (F.col("words") * F.col("quality")).cast("bigint")
    stages = [
        PL.Stage("measure", ["text"], ["words"], lambda d: d.withColumn("words", words), 1),
        PL.Stage("score", ["words", "quality"], ["score"], lambda d: d.withColumn("score", score), 10, workers=3),
    ]
    PL.run_together(exchange, stages, folder)
    meta = PL.united_metadata(exchange, "score", folder)
    data = exchange.get_data(meta.select(*KEY), ["score"])
    names = F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("fields")
    inputs = docs.select(*KEY, "doc_id", words.alias("words")).join(labels.select("doc_id", "quality"), "doc_id")
    expected = inputs.select(*KEY, score.alias("expected"))
    done = meta.select("epoch", "batch_no", "batch_index", *KEY, names).join(data, KEY).join(expected, KEY)
    scored = done.groupBy(STEP).agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_distinct("epoch", "batch_no").alias("batches"),
        F.count_if(F.col("score") == F.col("expected")).alias("as_computed"),
        F.sum("batch_index").alias("positions"),
        F.max("fields").alias("fields"),
    )
    # What the report tells is read before the clear, which leaves nothing to read.
    report = shared_dir(spark, "report")
    scored.write.parquet(report)
    steps = docs.select(STEP).distinct()
    exchange.clear_all(steps)
    left = exchange.segments().select(*KEY).distinct().groupBy(STEP).agg(F.count(F.lit(1)).alias("rows_left"))
    return spark.read.schema(scored.schema).parquet(report).join(left, STEP, "left").fillna(0, ["rows_left"])


_EVT_SMALL = f"""evt AS (SELECT event_id, event_type, {place('user_id', 2, 128)} FROM events)"""


@query(
    "g6_clear_event",
    f"""WITH {_EVT_SMALL}, c AS (SELECT global_step, max(event_id) AS at FROM evt WHERE event_type = 'error' GROUP BY 1),
live AS (SELECT e.* FROM evt e LEFT JOIN c ON c.global_step = e.global_step WHERE c.at IS NULL OR e.event_id > c.at)
SELECT 'browse' AS task_name, global_step, global_index FROM live WHERE event_type IN ('click', 'view')
GROUP BY 1, 2, 3 HAVING count(DISTINCT event_type) = 2
UNION ALL SELECT DISTINCT 'bill', global_step, global_index FROM live WHERE event_type = 'purchase'""",
)
def g6_clear_event(spark, sf_dir):
    use_rocksdb_state(spark)
    events = _stream(spark, sf_dir, "events")
    step, _ = B.address(F.col("user_id"), B.EVT_SMALL)
    clears = events.filter("event_type = 'error'").select(step, F.col("event_id").alias("put_seq"))
    tasks = {"browse": ["click", "view"], "bill": ["purchase"]}
    ready = RY.ready_stream(B.event_cells(events, B.EVT_SMALL), B.EVT_SMALL, tasks, clears=clears)
    return _collect_ready(spark, ready, ["task_name", *KEY])


@query(
    "g7_wait_timeout",
    f"""WITH {DOC_CTE} SELECT t.task_name, global_step, CAST(16 AS BIGINT) AS required,
count(*) FILTER (quality IS NOT NULL AND t.task_name = 'train') AS available,
count(*) FILTER (quality IS NOT NULL AND t.task_name = 'train') < 16 AS timed_out
FROM doc, (VALUES ('train'), ('audit')) AS t(task_name) GROUP BY 1, 2""",
)
def g7_wait_timeout(spark, sf_dir):
    """Labelled rows per step against a batch of 16; a short step is reported after two seconds.

    A task for which no row ever gets ready waits for every step, too.
    """
    use_rocksdb_state(spark)
    labels = _stream(spark, sf_dir, "labels")
    ready = labels.select(F.lit("train").alias("task_name"), *B.address(F.col("doc_id"), B.DOC))
    names = F.explode(F.array(F.lit("train"), F.lit("audit"))).alias("task_name")
    step = B.address(F.col("doc_id"), B.DOC)[0]
    requests = _stream(spark, sf_dir, "documents").select(names, step)
    folder = shared_dir(spark, "waits")
    steps = 2 * B.table(spark, sf_dir, "documents").select(step).distinct().count()
    running = (
        WT.wait_stream(ready, 16, 2, requests)
        .writeStream.format("parquet")
        .option("checkpointLocation", shared_dir(spark, "stream"))
        .trigger(processingTime="1 second")
        .start(folder)
    )
    try:
        while running.isActive:
            progress = running.lastProgress
            if progress is not None and progress.batchId > 0 and _answers(spark, folder) >= steps:
                break
            time.sleep(0.5)
        else:
            raise RuntimeError("the waiting stream ended before all answers came") from running.exception()
    finally:
        running.stop()
    return spark.read.schema(WT.WAIT_SCHEMA).parquet(folder)


def _answers(spark, folder) -> int:
    return spark.read.schema(WT.WAIT_SCHEMA).parquet(folder).count()
