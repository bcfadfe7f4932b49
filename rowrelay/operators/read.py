"""Reading cells back: last write per cell, ordered gather, cleared steps and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowrelay.functions import addressing as A
from rowrelay.functions.blocks import BLOCK
from rowrelay.functions.fieldmaps import empty_fields
from rowrelay.layout import Layout
from rowrelay.schema import INDEX, KEY, STEP


def union_segments(segments: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), segments)


def resolve_cells(segments: DataFrame, fields: list[str], keys: DataFrame | None = None) -> DataFrame:
    """The current value of each requested field per row: the latest put that wrote it wins.

    A put decides by ``fields_written``, so a written NULL replaces a value and a put that
    did not bring the field leaves it alone. With ``keys`` only those rows are read, before
    anything is aggregated.
    """
    unknown = [f for f in fields if f not in segments.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    rows = segments.select(*KEY, "put_seq", "write_pos", "fields_written", *[F.col(f"`{f}`") for f in fields])
    wanted = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
    rows = rows.filter(F.arrays_overlap("fields_written", wanted))
    if keys is not None:
        rows = rows.join(keys.select(*KEY), KEY, "left_semi")
    moment = F.struct("put_seq", "write_pos")
    latest = [
        F.max_by(F.col(f"`{f}`"), F.when(F.array_contains("fields_written", f), moment)).alias(f) for f in fields
    ]
    return rows.groupBy(*KEY).agg(*latest)


def get_data(meta: DataFrame, segments: DataFrame, fields: list[str], ordered: bool = False) -> DataFrame:
    """Requested fields of the batch's rows, fields in name order, one row per batch position.

    Rows carry ``batch_index``; ``ordered`` also sorts the result by it.
    """
    names = sorted(set(fields))
    place = [c for c in ("batch_id", "batch_index") if c in meta.columns]
    where = meta.select(*place, *KEY)
    if not names:
        return where.orderBy(*place) if ordered else where
    cells = resolve_cells(segments, names, keys=where)
    out = where.join(cells, KEY, "left").select(*place, *KEY, *[F.col(f"`{n}`") for n in names])
    return out.orderBy(*place) if ordered else out


def live_rows(log: DataFrame, clears: DataFrame, seq: str) -> DataFrame:
    """Rows of a log written after the last clear of their step.

    The clears are one row per step after aggregation, whatever the number of tasks. Spark broadcasts them
    when their size allows; beyond that a step with most of the rows must not end in one task, so both sides also join
    on a hash of the step: what follows cannot build on that order of the rows, and Spark is free to split the partition of such a step.
    """
    last = clears.groupBy(STEP).agg(F.max("clear_seq").alias("_cleared")).withColumn("_place", F.xxhash64(STEP))
    kept = log.withColumn("_place", F.xxhash64(STEP)).join(last, [STEP, "_place"], "left")
    kept = kept.filter(F.col("_cleared").isNull() | (F.col(seq) > F.col("_cleared")))
    return kept.select(*log.columns)


def row_space(steps: DataFrame, layout: Layout, width: int = BLOCK) -> DataFrame:
    """Every row address of the given steps (one row per step in ``steps``).

    A step is cut into blocks first and the blocks are dealt to the tasks, so one huge
    step is generated by many tasks.
    """
    last_block = (layout.rows_per_step - 1) // width
    start = A.step_start(F.col(STEP), layout)
    blocks = steps.select(
        F.col(STEP).cast("bigint").alias(STEP),
        start.alias("_start"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last_block).cast("bigint"))).alias("_b"),
    )
    if last_block:
        blocks = blocks.repartition(STEP, "_b")
    first = F.col("_start") + F.col("_b") * width
    end = F.least(first + width, F.col("_start") + layout.rows_per_step) - 1
    return blocks.select(STEP, F.explode(F.sequence(first, end)).alias(INDEX))


def step_space(spark: SparkSession, layout: Layout, global_step: int) -> DataFrame:
    """Every row address of one step."""
    start, end = layout.step_range(global_step)
    return spark.range(start, end).select(F.lit(global_step).cast("bigint").alias(STEP), F.col("id").alias(INDEX))


def clear_meta(addresses: DataFrame, layout: Layout) -> DataFrame:
    """Batch of every address of a step, without fields."""
    return addresses.select(
        (F.col(INDEX) - A.step_start(F.col(STEP), layout)).alias("batch_index"),
        *KEY,
        empty_fields().alias("fields"),
    )


def winners(segments: DataFrame) -> DataFrame:
    """(address, field, put_seq, write_pos): the write that holds the current value of every cell; narrow columns only."""
    written = segments.select(*KEY, "put_seq", "write_pos", F.explode("fields_written").alias("field"))
    last = written.groupBy(*KEY, "field").agg(F.max(F.struct("put_seq", "write_pos")).alias("m"))
    return last.select(*KEY, "field", "m.put_seq", "m.write_pos")


def compact(segments: DataFrame, fields: list[str]) -> DataFrame:
    """The segments without overwritten cells; what is left keeps its own sequence.

    So a clear or a put that lands later, whatever its sequence, finds the same cells before and
    after. A row keeps one segment row for each put that still holds one of its cells.
    """
    place = [*KEY, "put_seq", "write_pos"]
    kept = winners(segments).groupBy(*place).agg(F.collect_set("field").alias("_kept"))
    rows = segments.join(kept, place)
    names = F.array_sort(F.array_intersect("fields_written", "_kept"))
    cells = [F.when(F.array_contains("_kept", f), F.col(f"`{f}`")).alias(f) for f in fields]
    return rows.select(*place, names.alias("fields_written"), *cells)
