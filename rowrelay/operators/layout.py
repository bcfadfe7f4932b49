"""Slots of the address ring and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowrelay.functions import addressing as A
from rowrelay.functions.blocks import rank_by_block
from rowrelay.layout import Layout
from rowrelay.schema import INDEX, STEP


def step_ranges(steps: DataFrame, layout: Layout) -> DataFrame:
    step = F.col(STEP)
    return steps.select(
        STEP,
        A.slot(step, layout).alias("slot"),
        A.step_start(step, layout).alias("start_index"),
        A.step_end(step, layout).alias("end_index"),
    )


def slot_conflicts(steps: DataFrame, layout: Layout) -> DataFrame:
    """Slots that more than one live step maps to, with the number of such steps."""
    per_slot = step_ranges(steps, layout).groupBy("slot").agg(F.count_distinct(STEP).alias("live_steps"))
    return per_slot.filter("live_steps > 1")


def prompt_groups(rows: DataFrame, samples: int) -> DataFrame:
    index = F.col(INDEX)
    return rows.withColumn("group_id", A.prompt_group(index, samples)).withColumn(
        "group_offset", A.group_offset(index, samples)
    )


def shard_map(rows: DataFrame, shards: int) -> DataFrame:
    index = F.col(INDEX)
    return rows.withColumn("shard_id", A.shard_id(index, shards)).withColumn(
        "local_index", A.local_index(index, shards)
    )


def shard_groups(meta: DataFrame, shards: int) -> DataFrame:
    """Rows of each batch with their place in their shard's list, kept flat.

    ``shard_pos`` is the row's position among the rows of its shard in batch order.
    """
    placed = shard_map(meta, shards)
    narrow = placed.select("batch_id", "batch_index", "global_index", "shard_id", "local_index")
    return rank_by_block(narrow, ["batch_id", "shard_id"], "batch_index", "shard_pos")


def shard_summary(meta: DataFrame, shards: int) -> DataFrame:
    """Per batch and shard: size, smallest and largest local index, union of field names."""
    placed = shard_map(meta, shards)
    sizes = placed.groupBy("batch_id", "shard_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("local_index").alias("first_local"),
        F.max("local_index").alias("last_local"),
    )
    names = (
        placed.select("batch_id", "shard_id", F.explode(F.map_keys("fields")).alias("field"))
        .groupBy("batch_id", "shard_id", "field")
        .agg(F.lit(1))
        .groupBy("batch_id", "shard_id")
        .agg(F.array_sort(F.collect_list("field")).alias("field_names"))
    )
    empty = F.array().cast("array<string>")
    return sizes.join(names, ["batch_id", "shard_id"], "left").withColumn(
        "field_names", F.coalesce("field_names", empty)
    )


def capacity_check(rows: DataFrame, layout: Layout) -> DataFrame:
    """Per shard: rows held, largest local index and rows whose address lies outside the shard."""
    local = F.col("local_index")
    outside = (local < 0) | (local >= layout.shard_capacity)
    return (
        shard_map(rows, layout.shards)
        .groupBy("shard_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max(local).alias("last_local"),
            F.count(F.when(outside, 1)).alias("outside"),
        )
        .withColumn("capacity", F.lit(layout.shard_capacity).cast("bigint"))
    )
