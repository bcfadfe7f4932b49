"""Status as mergeable bitmaps, so that a poll reads no log.

A put adds one row for each (step, field, block of addresses), a claim one for each (task, step, block):
the block's rows as the bits of one number. Bitmaps of several puts are merged by OR; a row is ready when the bitmaps of
all fields have it (AND) and the task's has not (AND NOT). Counting needs the bitmaps only, and
rows are written out of the blocks that hold any. Clears leave out bitmaps as they leave out log records.

A block is as wide as a number: memory and files follow the rows that are there, however small or sparse the
steps are, and sums of any number of blocks are kept in hash tables of fixed-size values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowrelay.functions import addressing as A
from rowrelay.layout import Layout
from rowrelay.schema import INDEX, STEP

BLOCK = 64  # addresses of a bitmap: the bits of a BIGINT
FIELD, TASK = "field", "task"
PLACE = (STEP, INDEX)  # the index of a bitmap is its block's first address


def bitmaps(log: DataFrame, kind: str, name: str, seq: str) -> DataFrame:
    """(kind, name, global_step, global_index, seq, bits) of log records, combined before the only shuffle."""
    first = A.floor_div(F.col(INDEX), BLOCK) * BLOCK
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(INDEX) - first).cast("int"))
    placed = log.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), STEP, first.alias("_first"), F.col(seq).alias("seq"), bit.alias("_bit"))
    made = placed.groupBy("kind", "name", STEP, "_first", "seq").agg(F.coalesce(F.bit_or("_bit"), F.lit(0)).alias("bits"))
    return made.select("kind", "name", STEP, F.col("_first").alias(INDEX), "seq", "bits")


def production_bitmaps(production: DataFrame) -> DataFrame:
    return bitmaps(production, FIELD, "field", "put_seq")


def claim_bitmaps(claims: DataFrame) -> DataFrame:
    return bitmaps(claims, TASK, "task_name", "claim_seq")


def merged(index: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """(name, global_step, global_index, bits): one bitmap for each name and block."""
    some = index.filter((F.col("kind") == kind) & F.col("name").isin(names))
    return some.groupBy("name", *PLACE).agg(F.bit_or("bits").alias("bits"))


def ready_blocks(index: DataFrame, fields: list[str], task: str) -> DataFrame:
    """(global_step, global_index, taken, either, n): blocks with rows that are ready for the task.

    ``either`` has what is ready or taken, so ``n`` is the difference of two counts.
    """
    names = list(dict.fromkeys(fields))
    if not names:
        return index.select(*PLACE, F.col("bits").alias("taken"), F.col("bits").alias("either"), F.lit(0).cast("bigint").alias("n")).filter(F.lit(False))
    whole = merged(index, FIELD, names).groupBy(*PLACE).agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("_names"))
    whole = whole.filter(F.col("_names") == len(names)).select(*PLACE, "bits", F.lit(False).alias("_taken"))
    both = whole.unionByName(merged(index, TASK, [task]).select(*PLACE, "bits", F.lit(True).alias("_taken")))
    taken = F.coalesce(F.bit_or(F.when(F.col("_taken"), F.col("bits"))), F.lit(0))
    met = both.groupBy(*PLACE).agg(taken.alias("taken"), F.bit_or("bits").alias("either"))
    return met.withColumn("n", (F.bit_count("either") - F.bit_count("taken")).cast("bigint")).filter("n > 0")


def ready_count(index: DataFrame, fields: list[str], task: str) -> DataFrame:
    """(global_step, available): ready rows of each step that has any."""
    return ready_blocks(index, fields, task).groupBy(STEP).agg(F.sum("n").alias("available"))


def ready_rows(index: DataFrame, fields: list[str], task: str) -> DataFrame:
    """(global_step, global_index) of the rows that are ready for the task."""
    free = F.col("either").bitwiseAND(F.bitwise_not(F.col("taken")))
    bit = F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))
    bits = ready_blocks(index, fields, task).select(*PLACE, free.alias("_free"), bit.alias("_bit"))
    return bits.filter(F.getbit("_free", F.col("_bit")) == 1).select(STEP, (F.col(INDEX) + F.col("_bit")).alias(INDEX))


def ready_group_rows(index: DataFrame, fields: list[str], task: str, samples: int) -> DataFrame:
    """The ready rows of prompt groups that are ready as a whole."""
    rows = ready_rows(index, fields, task).withColumn("_unit", A.prompt_group(F.col(INDEX), samples))
    full = rows.groupBy(STEP, "_unit").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == samples)
    offset = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint")))
    return full.select(STEP, (F.col("_unit") * samples).alias("_first"), offset.alias("_offset")).select(STEP, (F.col("_first") + F.col("_offset")).alias(INDEX))


def produced_count(index: DataFrame, fields: list[str]) -> DataFrame:
    """Rows produced for each step and field."""
    counted = merged(index, FIELD, fields).groupBy(STEP, F.col("name").alias("field"))
    return counted.agg(F.sum(F.bit_count("bits")).alias("produced"))


def check_consumption(index: DataFrame, steps: DataFrame, layout: Layout, tasks: list[str]) -> DataFrame:
    """Per task and step: how many rows it has taken and whether that is all of them."""
    counts = merged(index, TASK, tasks).groupBy(F.col("name").alias("task_name"), STEP).agg(F.sum(F.bit_count("bits")).alias("n"))
    asked = steps.select(STEP, F.explode(F.array(*[F.lit(t) for t in dict.fromkeys(tasks)])).alias("task_name"))
    consumed = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return asked.join(counts, ["task_name", STEP], "left").select("task_name", STEP, consumed.alias("consumed"), (consumed == layout.rows_per_step).alias("all_consumed"))
