"""Finding ready rows, picking batches of an exact size and handing them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowrelay.functions import addressing as A
from rowrelay.functions.bits import collect_bits, has_all, position_in
from rowrelay.functions.blocks import BLOCK, distinct_per_group, lowest
from rowrelay.functions.fieldmaps import constant_fields, empty_fields, field_meta
from rowrelay.layout import Layout
from rowrelay.operators.status import write_moment
from rowrelay.schema import FIELD_MAP, INDEX, KEY, NOT_PRODUCED, READY, STEP

# A prompt group is tested in one aggregation while its cells fit this many bits;
# wider groups are tested row by row first and counted afterwards.
GROUP_BITS = 496


def _unique(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


def _rows_of(units: DataFrame, samples: int) -> DataFrame:
    """Rows of the groups in ``units`` (global_step, _unit)."""
    if samples == 1:
        return units.select(STEP, F.col("_unit").alias(INDEX))
    offset = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint")))
    return units.select(STEP, "_unit", offset.alias("_offset")).select(
        STEP, (F.col("_unit") * samples + F.col("_offset")).alias(INDEX)
    )


def scan_ready_units(production: DataFrame, claims: DataFrame, fields: list[str], task: str, samples: int) -> DataFrame:
    """(global_step, _unit) of rows, or of groups of ``samples`` rows, that are wholly ready.

    Produced cells become bits of a per-unit set, a claim on any row of the unit spoils it.
    Log and claims meet in one aggregation: one shuffle, combined before it.
    """
    names = _unique(fields)
    unit = A.prompt_group(F.col(INDEX), samples).alias("_unit")
    if not names:
        return production.select(STEP, unit).filter(F.lit(False))
    n_bits = len(names) * samples
    if samples > 1 and n_bits > GROUP_BITS:
        rows = scan_ready(production, claims, names, task)
        full = rows.groupBy(STEP, unit).agg(F.count(F.lit(1)).alias("_n"))
        return full.filter(F.col("_n") == samples).select(STEP, "_unit")
    bit = A.group_offset(F.col(INDEX), samples) * len(names) + position_in(F.col("field"), names)
    cells = production.filter(F.col("field").isin(names)).select(
        STEP, unit, bit.cast("bigint").alias("_bit"), F.lit(0).alias("_claimed")
    )
    taken = claims.filter(F.col("task_name") == task).select(
        STEP, unit, F.lit(None).cast("bigint").alias("_bit"), F.lit(1).alias("_claimed")
    )
    state = (
        cells.unionByName(taken)
        .groupBy(STEP, "_unit")
        .agg(*collect_bits(F.col("_bit"), n_bits, "_w"), F.max("_claimed").alias("_claimed"))
    )
    return state.filter(has_all(n_bits, "_w") & (F.col("_claimed") == 0)).select(STEP, "_unit")


def scan_ready(production: DataFrame, claims: DataFrame, fields: list[str], task: str) -> DataFrame:
    """Rows with every requested field produced that the task has not consumed.

    An unknown field or an empty list of fields makes nothing ready.
    """
    return _rows_of(scan_ready_units(production, claims, fields, task, 1), 1)


def scan_ready_groups(production: DataFrame, claims: DataFrame, fields: list[str], task: str, samples: int) -> DataFrame:
    """Rows of the prompt groups whose ``samples`` rows are all ready and unconsumed."""
    return _rows_of(scan_ready_units(production, claims, fields, task, samples), samples)


def scan_ready_tasks(production: DataFrame, claims: DataFrame, tasks: dict[str, list[str]]) -> DataFrame:
    """(task_name, row) for many tasks at once, reading and shuffling the log a single time."""
    names = _unique([f for fields in tasks.values() for f in fields])
    labels = list(tasks)
    cells = production.filter(F.col("field").isin(names)).select(
        *KEY, position_in(F.col("field"), names).alias("_bit"), F.lit(None).cast("bigint").alias("_taker")
    )
    taken = claims.filter(F.col("task_name").isin(labels)).select(
        *KEY, F.lit(None).cast("bigint").alias("_bit"), position_in(F.col("task_name"), labels).alias("_taker")
    )
    state = (
        cells.unionByName(taken)
        .groupBy(*KEY)
        .agg(*collect_bits(F.col("_bit"), len(names), "_w"), *collect_bits(F.col("_taker"), len(labels), "_c"))
    )
    ready = []
    for i, label in enumerate(labels):
        wanted = [names.index(f) for f in _unique(tasks[label])]
        if wanted:
            free = ~has_all(len(labels), "_c", [i])
            ready.append(F.when(has_all(len(names), "_w", wanted) & free, F.lit(label)))
    if not ready:
        return production.select(F.lit("").alias("task_name"), *KEY).filter(F.lit(False))
    return state.select(F.explode(F.array_compact(F.array(*ready))).alias("task_name"), *KEY)


def sequential_sample(rows: DataFrame, k: int, keys: tuple[str, ...] = (STEP,), exact: bool = False) -> DataFrame:
    """The ``k`` lowest indices per step (or other keys), with their ``batch_index``."""
    return lowest(rows, list(keys), INDEX, k, "batch_index", exact)


def sequential_sample_units(units: DataFrame, k: int, samples: int, exact: bool = False) -> DataFrame:
    """The ``k / samples`` lowest complete groups per step as rows in order."""
    if k % samples:
        raise ValueError(f"batch size {k} is not a multiple of {samples}")
    picked = lowest(units, [STEP], "_unit", k // samples, "_rank", exact)
    offset = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint")))
    return picked.withColumn("_offset", offset).select(
        STEP,
        (F.col("_unit") * samples + F.col("_offset")).alias(INDEX),
        (F.col("_rank") * samples + F.col("_offset")).alias("batch_index"),
    )


def sequential_sample_groups(rows: DataFrame, k: int, samples: int, exact: bool = False) -> DataFrame:
    """As ``sequential_sample`` on whole groups; incomplete groups are left out."""
    units = rows.groupBy(STEP, A.prompt_group(F.col(INDEX), samples).alias("_unit"))
    if samples <= GROUP_BITS:
        seen = units.agg(*collect_bits(A.group_offset(F.col(INDEX), samples), samples, "_w"))
        full = seen.filter(has_all(samples, "_w"))
    else:
        full = units.agg(F.count_distinct(INDEX).alias("_n")).filter(F.col("_n") == samples)
    return sequential_sample_units(full.select(STEP, "_unit"), k, samples, exact)


def fetch_rows(
    production: DataFrame, claims: DataFrame, fields: list[str], k: int, task: str, samples: int = 1
) -> DataFrame:
    """Exactly ``k`` ready rows per step, lowest indices first, or no rows for the step."""
    if not task:
        raise ValueError("a fetch needs a task name")
    units = scan_ready_units(production, claims, fields, task, samples)
    if samples > 1:
        return sequential_sample_units(units, k, samples, exact=True)
    return sequential_sample(_rows_of(units, 1), k, exact=True)


def force_fetch_rows(
    steps: DataFrame, claims: DataFrame, layout: Layout, k: int, task: str, grouped: bool = False, width: int = BLOCK
) -> DataFrame:
    """Exactly ``k`` unconsumed rows per step whatever their readiness, or none.

    The free rows are counted per block from the claims alone; only the blocks that hold
    the ``k`` lowest ones are then written out as rows, so the work follows the claims and
    ``k``, not the size of the step.
    """
    if not task:
        raise ValueError("a fetch needs a task name")
    samples = layout.samples if grouped else 1
    if k % samples:
        raise ValueError(f"batch size {k} is not a multiple of {samples}")
    units = layout.rows_per_step // samples
    wanted = k // samples
    unit = A.prompt_group(F.col(INDEX), samples).alias("_unit")
    taken = claims.filter((F.col("task_name") == task) & A.in_step(F.col(STEP), F.col(INDEX), layout)).select(STEP, unit)
    start = A.floor_div(A.step_start(F.col(STEP), layout), samples)
    # Blocks are counted from the step's own start.
    taken = taken.withColumn("_block", A.floor_div(F.col("_unit") - start, width))
    spaces = steps.select(
        STEP, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((units - 1) // width).cast("bigint"))).alias("_block")
    )
    used = distinct_per_group(taken, [STEP, "_block"], "_unit", "_used")
    size = F.least(F.lit(width).cast("bigint"), F.lit(units) - F.col("_block") * width)
    free = spaces.join(used, [STEP, "_block"], "left").withColumn("_free", size - F.coalesce("_used", F.lit(0)))
    step = Window.partitionBy(STEP)
    lower = step.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        free.withColumn("_before", F.coalesce(F.sum("_free").over(lower), F.lit(0)))
        .withColumn("_total", F.sum("_free").over(step))
        .filter((F.col("_total") >= wanted) & (F.col("_before") < wanted) & (F.col("_free") > 0))
        .select(STEP, "_block")
    )
    first = start + F.col("_block") * width
    last = F.least(first + width, start + units) - 1
    rows = blocks.select(STEP, "_block", F.explode(F.sequence(first, last)).alias("_unit"))
    nearby = taken.join(blocks, [STEP, "_block"], "left_semi")
    open_units = rows.join(nearby, [STEP, "_block", "_unit"], "left_anti").select(STEP, "_unit")
    if samples > 1:
        return sequential_sample_units(open_units, k, samples, exact=True)
    return sequential_sample(_rows_of(open_units, 1), k, exact=True)


def batch_gate(ready: DataFrame, steps: DataFrame, k: int) -> DataFrame:
    """Per step: rows available, rows required, whether a batch can be cut."""
    counts = ready.groupBy(STEP).agg(F.count(F.lit(1)).alias("available"))
    available = F.coalesce(F.col("available"), F.lit(0).cast("bigint"))
    return steps.join(counts, STEP, "left").select(
        STEP,
        available.alias("available"),
        F.lit(k).cast("bigint").alias("required"),
        (available >= k).alias("is_sufficient"),
    )


def claim(rows: DataFrame, task: str, claim_seq: int | Column) -> DataFrame:
    """Claim records of handed-out rows, to be appended to the claims of the task."""
    seq = claim_seq if isinstance(claim_seq, Column) else F.lit(claim_seq)
    place = F.col("batch_index") if "batch_index" in rows.columns else F.lit(None)
    return rows.select(
        F.lit(task).alias("task_name"), *KEY, seq.cast("bigint").alias("claim_seq"),
        place.cast("bigint").alias("batch_index"),
    )


def insert_meta(addresses: DataFrame, layout: Layout, fields: list[str]) -> DataFrame:
    """Batch of all rows of the steps in ``addresses``; no field is produced yet."""
    return addresses.select(
        (F.col(INDEX) - A.step_start(F.col(STEP), layout)).alias("batch_index"),
        *KEY,
        constant_fields(fields, NOT_PRODUCED).alias("fields"),
    )


def batch_meta(rows: DataFrame, production: DataFrame, fields: list[str], real_status: bool = False) -> DataFrame:
    """Add the field map: dtype and shape of the latest put of each requested field.

    Fetched rows are ready by selection; with ``real_status`` (force fetch) the status of
    each field is looked up, and fields not produced carry neither dtype nor shape.
    """
    names = _unique(fields)
    if not names:
        return rows.withColumn("fields", empty_fields())
    log = production.filter(F.col("field").isin(names)).join(rows.select(*KEY), KEY, "left_semi")
    latest = [
        F.max_by(F.struct("dtype", "shape"), F.when(F.col("field") == n, write_moment(log))).alias(f"_f{i}")
        for i, n in enumerate(names)
    ]
    produced = [F.max(F.when(F.col("field") == n, 1)).alias(f"_p{i}") for i, n in enumerate(names)]
    info = log.groupBy(*KEY).agg(*latest, *produced)
    pairs = []
    for i, n in enumerate(names):
        status = F.when(F.col(f"_p{i}") == 1, READY).otherwise(NOT_PRODUCED) if real_status else F.lit(READY)
        pairs += [F.lit(n), field_meta(F.col(f"_f{i}.dtype"), F.col(f"_f{i}.shape"), status)]
    joined = rows.join(info, KEY, "left")
    return joined.select(*rows.columns, F.create_map(*pairs).cast(FIELD_MAP).alias("fields"))
