"""Views of the driver tables as exchange logs.

documents / labels: rows whose early fields come with the document and whose late fields
come with its label. orders / lineitem: rows whose fields are the line numbers present.
events: a log of single-field puts in event order. conversations: prompt groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowrelay.functions import addressing as A
from rowrelay.functions.fieldmaps import field_meta
from rowrelay.layout import Layout
from rowrelay.operators import ingest as IN, read as RD
from rowrelay.schema import CLAIMS, FIELD_MAP, INDEX, KEY, NOT_PRODUCED, READY, STEP

DOC = Layout(prompts=10, samples=4, slots=8, shards=3)
DOC_PAIRS = Layout(prompts=20, samples=2, slots=8, shards=3)
ORD = Layout(prompts=250, samples=2, slots=8, shards=3)
EVT = Layout(prompts=25, samples=2, slots=8, shards=3)
EVT_SMALL = Layout(prompts=2, samples=1, slots=128)
CONV = Layout(prompts=5, samples=8, slots=8, shards=3)

DOC_FIELDS = ["text", "lang", "source", "n_chars"]
LABEL_FIELDS = ["quality", "toxic"]
EVENT_FIELDS = ["click", "error", "purchase", "signup", "view"]
LINE_FIELDS = [f"l{i}" for i in range(1, 8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(identifier: Column, layout: Layout) -> list[Column]:
    """Step and ring index of a dense identifier: steps are consecutive runs of rows."""
    step = A.floor_div(identifier, layout.rows_per_step)
    index = A.step_start(step, layout) + F.pmod(identifier.cast("bigint"), F.lit(layout.rows_per_step).cast("bigint"))
    return [step.alias(STEP), index.alias(INDEX)]


def steps_of(rows: DataFrame) -> DataFrame:
    return rows.select(STEP).distinct()


# --- documents and labels ----------------------------------------------------------


def doc_rows(spark: SparkSession, sf_dir: str, layout: Layout = DOC) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*address(F.col("doc_id"), layout), "*")


def doc_segment_list(spark: SparkSession, sf_dir: str, layout: Layout = DOC) -> list[tuple[DataFrame, list[str]]]:
    labels = table(spark, sf_dir, "labels").select(*address(F.col("doc_id"), layout), "*")
    return [
        (IN.segment(doc_rows(spark, sf_dir, layout), DOC_FIELDS, 1), DOC_FIELDS),
        (IN.segment(labels, LABEL_FIELDS, 2), LABEL_FIELDS),
    ]


def doc_segments(spark: SparkSession, sf_dir: str, layout: Layout = DOC) -> DataFrame:
    return RD.union_segments([s for s, _ in doc_segment_list(spark, sf_dir, layout)])


def doc_production(spark: SparkSession, sf_dir: str, layout: Layout = DOC) -> DataFrame:
    logs = [IN.production_rows(s, fields) for s, fields in doc_segment_list(spark, sf_dir, layout)]
    return RD.union_segments(logs)


def doc_claims(spark: SparkSession, sf_dir: str, layout: Layout = DOC) -> DataFrame:
    """Task ``train`` has already taken the documents that are not in English."""
    taken = doc_rows(spark, sf_dir, layout).filter("lang <> 'en'")
    return taken.select(
        F.lit("train").alias("task_name"), *KEY, F.lit(1).cast("bigint").alias("claim_seq"),
        F.lit(None).cast("bigint").alias("batch_index"),
    )


def doc_meta(spark: SparkSession, sf_dir: str, layout: Layout = DOC) -> DataFrame:
    """One batch per step: text and n_chars are there, quality only on labelled rows."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    scalar = F.array().cast("array<int>")
    null = F.lit(None)
    labelled = F.col("quality").isNotNull()
    fields = F.create_map(
        F.lit("text"), field_meta(null, null, F.lit(READY)),
        F.lit("n_chars"), field_meta(F.lit("bigint"), scalar, F.lit(READY)),
        F.lit("quality"),
        field_meta(
            F.when(labelled, "int"), F.when(labelled, scalar), F.when(labelled, READY).otherwise(NOT_PRODUCED)
        ),
    )
    step, index = address(F.col("doc_id"), layout)
    place = F.pmod("doc_id", F.lit(layout.rows_per_step).cast("bigint")).alias("batch_index")
    return rows.select(step.alias("batch_id"), place, step, index, fields.cast(FIELD_MAP).alias("fields"))


# --- orders and lineitem -----------------------------------------------------------


def order_rows(spark: SparkSession, sf_dir: str, layout: Layout = ORD) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*address(F.col("o_orderkey"), layout), "*")


def line_production(spark: SparkSession, sf_dir: str, layout: Layout = ORD) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        *address(F.col("l_orderkey"), layout),
        F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("field"),
        (F.col("l_linenumber") - 1).alias("field_pos"),
        F.lit("double").alias("dtype"),
        F.array().cast("array<int>").alias("shape"),
        F.lit(1).cast("bigint").alias("put_seq"),
    )


def order_claims(spark: SparkSession, sf_dir: str, layout: Layout = ORD) -> DataFrame:
    """Task ``ship`` has taken the finished orders; task ``audit`` has taken every order."""
    rows = order_rows(spark, sf_dir, layout)
    shipped = F.when(F.col("o_orderstatus") == "F", F.lit("ship"))
    return rows.select(
        F.explode(F.array_compact(F.array(F.lit("audit"), shipped))).alias("task_name"), *KEY,
        F.lit(1).cast("bigint").alias("claim_seq"), F.lit(None).cast("bigint").alias("batch_index"),
    )


# --- events ------------------------------------------------------------------------


def event_cells(events: DataFrame, layout: Layout = EVT) -> DataFrame:
    """One produced cell per event; the shape stands for the size of the value written."""
    return events.select(
        *address(F.col("user_id"), layout),
        F.col("event_type").alias("field"),
        F.lit(0).alias("field_pos"),
        F.lit("double").alias("dtype"),
        F.array(F.length("props")).alias("shape"),
        F.col("event_id").alias("put_seq"),
    )


def event_production(spark: SparkSession, sf_dir: str, layout: Layout = EVT) -> DataFrame:
    return event_cells(table(spark, sf_dir, "events"), layout)


def event_segments(spark: SparkSession, sf_dir: str, layout: Layout = EVT) -> DataFrame:
    """Each event writes its value into the field named by its type."""
    events = table(spark, sf_dir, "events")
    return events.select(
        *address(F.col("user_id"), layout),
        F.col("event_id").alias("put_seq"),
        F.lit(0).cast("bigint").alias("write_pos"),
        F.array("event_type").alias("fields_written"),
        *[F.when(F.col("event_type") == f, F.col("value")).alias(f) for f in EVENT_FIELDS],
    )


def event_clears(spark: SparkSession, sf_dir: str, layout: Layout = EVT) -> DataFrame:
    """An error event clears its step."""
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return errors.select(address(F.col("user_id"), layout)[0], F.col("event_id").alias("clear_seq"))


# --- conversations and embeddings ----------------------------------------------------


def conversation_production(spark: SparkSession, sf_dir: str, layout: Layout = CONV) -> DataFrame:
    """A row per turn slot; eight slots make the prompt group of a conversation."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        *address(F.col("conv_id") * 8 + F.col("turn"), layout),
        F.lit("text").alias("field"),
        F.lit(0).alias("field_pos"),
        F.lit(None).cast("string").alias("dtype"),
        F.lit(None).cast("array<int>").alias("shape"),
        F.lit(1).cast("bigint").alias("put_seq"),
    )


def no_claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CLAIMS)


def tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in batches of 100 with a dense, a ragged, a scalar and a text column."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        A.floor_div(F.col("vec_id"), 100).alias("batch_id"),
        F.pmod("vec_id", F.lit(100).cast("bigint")).alias("batch_index"),
        "embedding",
        F.filter("embedding", lambda x: x > 0).alias("positive"),
        F.col("label"),
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("name"),
    )
