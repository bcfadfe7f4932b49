"""Status tables: what has been produced and what each task has consumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowrelay.functions import addressing as A
from rowrelay.functions.blocks import distinct_per_group
from rowrelay.layout import Layout
from rowrelay.operators.read import row_space
from rowrelay.schema import INDEX, KEY, STEP


def write_moment(log: DataFrame) -> Column:
    """Order of writes; logs without a position inside a put have one write per cell and put."""
    position = F.coalesce("write_pos", F.lit(0).cast("bigint")) if "write_pos" in log.columns else F.lit(0).cast("bigint")
    return F.struct(F.col("put_seq"), position.alias("write_pos"))


def _unique(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


def production_status(production: DataFrame, steps: DataFrame, layout: Layout, fields: list[str]) -> DataFrame:
    """0/1 per row and field over the whole row space; rows never put are all zero.

    Row space and log meet in one aggregation, which needs a single shuffle. Pass the log of
    the steps asked for: a filter on ``global_step`` prunes its files.
    """
    names = _unique(fields)
    space = row_space(steps, layout).select(*KEY, F.lit(None).cast("string").alias("field"), F.lit(1).alias("_in"))
    cells = production.filter(F.col("field").isin(names)).select(*KEY, "field", F.lit(0).alias("_in"))
    flags = [F.max((F.coalesce(F.col("field"), F.lit("")) == n).cast("tinyint")).alias(n) for n in names]
    table = space.unionByName(cells).groupBy(*KEY).agg(F.max("_in").alias("_in"), *flags)
    return table.filter("_in = 1").drop("_in")


def produced_count(production: DataFrame) -> DataFrame:
    """Rows produced per step and field."""
    return distinct_per_group(production, [STEP, "field"], INDEX, "produced")


def field_registry(production: DataFrame) -> DataFrame:
    """Fields in first-seen order with their column number."""
    first = production.groupBy("field").agg(F.min(F.struct("put_seq", "field_pos")).alias("first"))
    # One row per field name, i.e. per column of the table.
    ordered = first.agg(F.array_sort(F.collect_list(F.struct("first", "field"))).alias("all"))
    return ordered.select(F.posexplode("all").alias("column_number", "f")).select(
        F.col("f.field").alias("field"), F.col("column_number").cast("bigint"), F.col("f.first.put_seq").alias("first_put_seq")
    )


def field_info(production: DataFrame) -> DataFrame:
    """dtype and shape of the latest write of every cell; within a put the last position wins."""
    latest = F.max_by(F.struct("dtype", "shape"), write_moment(production)).alias("info")
    return production.groupBy(*KEY, "field").agg(latest).select(*KEY, "field", "info.dtype", "info.shape")


def consumption_status(claims: DataFrame, steps: DataFrame, layout: Layout, tasks: list[str]) -> DataFrame:
    """(task, row, 0/1) over the whole row space; a task nobody has seen is all zero."""
    names = _unique(tasks)
    space = row_space(steps, layout).select(*KEY, F.lit(None).cast("string").alias("task_name"), F.lit(1).alias("_in"))
    taken = claims.filter(F.col("task_name").isin(names)).select(*KEY, "task_name", F.lit(0).alias("_in"))
    flags = [F.max((F.coalesce(F.col("task_name"), F.lit("")) == t).cast("tinyint")).alias(f"_t{i}") for i, t in enumerate(names)]
    table = space.unionByName(taken).groupBy(*KEY).agg(F.max("_in").alias("_in"), *flags).filter("_in = 1")
    pairs = F.array(*[F.struct(F.lit(t).alias("task_name"), F.col(f"_t{i}").alias("consumed")) for i, t in enumerate(names)])
    return table.select(*KEY, F.explode(pairs).alias("p")).select("p.task_name", *KEY, "p.consumed")


def check_consumption(claims: DataFrame, steps: DataFrame, layout: Layout, tasks: list[str]) -> DataFrame:
    """Per task and step: how many rows it has consumed and whether that is all of them."""
    names = _unique(tasks)
    wanted = claims.filter(F.col("task_name").isin(names)).filter(A.in_step(F.col(STEP), F.col(INDEX), layout))
    counts = distinct_per_group(wanted, ["task_name", STEP], INDEX, "consumed")
    asked = steps.select(STEP, F.explode(F.array(*[F.lit(t) for t in names])).alias("task_name"))
    joined = asked.join(counts, ["task_name", STEP], "left")
    consumed = F.coalesce(F.col("consumed"), F.lit(0).cast("bigint"))
    return joined.select(
        "task_name", STEP, consumed.alias("consumed"), (consumed == layout.rows_per_step).alias("all_consumed")
    )


def check_production(production: DataFrame, steps: DataFrame, layout: Layout, fields: list[str]) -> DataFrame:
    """Per step: the rows of the least produced field and whether every row has every field."""
    names = _unique(fields)
    wanted = production.filter(F.col("field").isin(names)).filter(A.in_step(F.col(STEP), F.col(INDEX), layout))
    per_field = produced_count(wanted)
    counts = per_field.groupBy(STEP).agg(F.count(F.lit(1)).alias("_fields"), F.min("produced").alias("_least"))
    joined = steps.select(STEP).join(counts, STEP, "left")
    least = F.when(F.col("_fields") == len(names), F.col("_least")).otherwise(0).cast("bigint")
    return joined.select(STEP, least.alias("least_produced"), (least == layout.rows_per_step).alias("all_produced"))


def all_registered(production: DataFrame, fields: list[str]) -> Column:
    """Scalar condition: every field has been produced by somebody at some time."""
    names = _unique(fields)
    seen = [F.max(F.when(F.col("field") == n, 1)) for n in names]
    total = sum((F.coalesce(s, F.lit(0)) for s in seen), F.lit(0))
    return production.filter(F.col("field").isin(names)).agg((total == len(names)).alias("ok")).select("ok").scalar()


def status_mask(
    production: DataFrame, claims: DataFrame, steps: DataFrame, layout: Layout, fields: list[str], task: str
) -> tuple[DataFrame, DataFrame]:
    """(rows of the steps the task has not consumed, column numbers of the fields).

    Both are empty as soon as one requested field is not registered.
    """
    names = _unique(fields)
    known = all_registered(production, names) if names else F.lit(True)
    space = row_space(steps, layout)
    taken = claims.filter(F.col("task_name") == task).select(*KEY)
    rows = space.join(taken, KEY, "left_anti").filter(known)
    columns = field_registry(production).filter(F.col("field").isin(names)).filter(known)
    return rows, columns.select("field", "column_number")
