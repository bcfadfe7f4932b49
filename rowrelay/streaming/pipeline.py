"""Stages of a dataflow on one exchange: each is enabled by the columns of earlier ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from rowrelay.operators import batch as BA
from rowrelay.operators.bitmaps import claim_bitmaps
from rowrelay.operators.fetch import batch_meta, claim
from rowrelay.plans.exchange import Exchange
from rowrelay.schema import FIELD_MAP, INDEX, KEY, STEP
from rowrelay.streaming.batches import BatchCutter, batch_stream
from rowrelay.streaming.ready import ready_stream


@dataclass(frozen=True)
class Stage:
    """A task: the fields it reads, the columns it adds, the size of its batches.

    ``compute`` gets the values of the rows handed out and returns them with new columns. With several
    ``workers`` a batch is cut into that many chunks, each computed by a task of its own. Without ``whole`` the rows
    of a step that fill no batch are handed out, too, in a smaller one at the end of each micro-batch.
    """

    task: str
    inputs: list[str]
    outputs: list[str]
    compute: Callable[[DataFrame], DataFrame]
    batch_size: int
    grouped: bool = False
    workers: int = 1
    whole: bool = True


def batch_ids(handed: DataFrame, exchange: Exchange) -> DataFrame:
    """The rows with ``batch_id``: one number for each step and batch of a micro-batch."""
    # A step has no more batches than rows, so the numbers of two steps cannot meet.
    return handed.withColumn("batch_id", F.col(STEP) * exchange.layout.rows_per_step + F.col("batch_no"))


def compute_chunks(exchange: Exchange, stage: Stage, handed: DataFrame, folder: str, epoch: int) -> None:
    """Compute each batch in chunks, put the results, and write the united metadata.

    The results are written below ``folder`` before they are put: that is where the chunks are computed at once, and a
    repeat of the micro-batch replaces them. The chunks are then concatenated in order, and their new fields united
    with those the batch had; the metadata keeps the positions of the batch.
    """
    spark = exchange.spark
    places = batch_ids(handed, exchange).select("batch_id", "batch_no", "batch_index", *KEY)
    chunks = BA.chunk(places, stage.workers)
    data = exchange.get_data(places.select(*KEY), stage.inputs).join(chunks, KEY).repartition("batch_id", "chunk_id")
    place = ["batch_id", "batch_no", "chunk_id", "batch_index", *KEY]
    computed = stage.compute(data).select(*place, *stage.outputs)
    computed.write.mode("overwrite").parquet(f"{folder}/results/epoch={epoch}")
    results = spark.read.schema(computed.schema).parquet(f"{folder}/results/epoch={epoch}")
    exchange.put_rows(results.select(*KEY, *stage.outputs))
    new = BA.concat_parts(BA.extract_field_metas(results, stage.outputs), "chunk_id")
    had = batch_meta(places, exchange.batch_production(places), stage.inputs)
    united = BA.union(had, new.select("batch_id", "batch_index", *KEY, "fields"), validate=True)
    united.write.mode("overwrite").parquet(f"{folder}/metas/epoch={epoch}")


def start_stage(exchange: Exchange, stage: Stage, folder: str, **trigger):
    """Follow the production log, cut batches, compute, and put the results.

    Rows are claimed before they are read, and the results are put before the micro-batch is
    committed. A claim carries the sequence of the put that made its row ready, which a repeat
    of the micro-batch finds again: the same claims, and the same values, leave all status as it is.
    ``compute`` also gets ``batch_no`` and ``batch_index``, so it may work batch by batch.
    """
    spark, tables = exchange.spark, exchange.tables
    log, marks = tables.read_stream("production"), tables.read_stream("clears")
    ready = ready_stream(
        log,
        exchange.layout,
        {stage.task: stage.inputs},
        grouped=stage.grouped,
        clears=marks.withColumnRenamed("clear_seq", "put_seq"),
    )
    samples = exchange.layout.samples if stage.grouped else 1
    batches = f"{folder}/{stage.task}/batches"
    cutter = BatchCutter(spark, batches, stage.batch_size, samples, lambda: tables.read("clears"), stage.whole)

    def work(handed: DataFrame, epoch: int) -> None:
        if handed.isEmpty():
            return
        taken = claim(handed, stage.task, F.col("ready_seq"))
        tables.append("claims", taken)
        tables.append("bitmaps", claim_bitmaps(taken))
        if stage.workers > 1:
            compute_chunks(exchange, stage, handed, f"{folder}/{stage.task}", epoch)
            return
        places = handed.select(*KEY, "batch_no", "batch_index")
        data = exchange.get_data(places.select(*KEY), stage.inputs).join(places, KEY)
        exchange.put_rows(stage.compute(data).select(*KEY, *stage.outputs))

    query = batch_stream(ready, cutter, f"{folder}/{stage.task}/checkpoint", work, **trigger)
    return query, cutter


def run_available(exchange: Exchange, stages: list[Stage], folder: str) -> dict[str, DataFrame]:
    """Run the stages over everything put so far, in order; returns each task's batches."""
    handed = {}
    for stage in stages:
        query, cutter = start_stage(exchange, stage, folder)
        query.awaitTermination()
        handed[stage.task] = cutter.batches()
    return handed


POOL = "spark.scheduler.pool"


def run_together(exchange: Exchange, stages: list[Stage], folder: str, every: str = "1 second") -> dict[str, DataFrame]:
    """Run all stages at the same time over everything put so far; returns each task's batches.

    Every stage is a stream of its own in a scheduler pool named after its task (pools share the executors
    evenly where ``spark.scheduler.mode`` is FAIR), so a later stage works on finished batches while an earlier one still computes.
    ``stages`` come in order: one may read what those before it write. Stages are at rest once all before them
    are and nothing new is left for them. The streams end then, or with the first one that fails.
    """
    context = exchange.spark.sparkContext
    pool, running, handed = context.getLocalProperty(POOL), [], {}
    try:
        for stage in stages:
            # A stream keeps the pool of the thread that has started it.
            context.setLocalProperty(POOL, stage.task)
            query, cutter = start_stage(exchange, stage, folder, processingTime=every)
            running.append(query)
            handed[stage.task] = cutter
        context.setLocalProperty(POOL, pool)
        for query in running:
            query.processAllAvailable()
    finally:
        context.setLocalProperty(POOL, pool)
        for query in running:
            query.stop()
    return {task: cutter.batches() for task, cutter in handed.items()}


_META = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("batch_id", "batch_no", "batch_index", STEP, INDEX)] + [T.StructField("fields", FIELD_MAP)]
)


def united_metadata(exchange: Exchange, task: str, folder: str) -> DataFrame:
    """Metadata of all batches of a stage with several workers: (epoch, batch_id, batch_no, position, address, fields)."""
    schema = T.StructType([*_META.fields, T.StructField("epoch", T.LongType())])
    return exchange.spark.read.schema(schema).parquet(f"{folder}/{task}/metas")
