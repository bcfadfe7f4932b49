"""Column expressions that turn steps and indices into addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowrelay.layout import Layout


def floor_div(value: Column, divisor: int) -> Column:
    """Integer division rounding down, staying in BIGINT (no detour over DOUBLE)."""
    value = value.cast("bigint")
    if divisor == 1:
        return value
    rest = F.pmod(value, F.lit(divisor).cast("bigint"))
    return F.call_function("div", value - rest, F.lit(divisor).cast("bigint"))


def slot(step: Column, layout: Layout) -> Column:
    return F.pmod(step.cast("bigint"), F.lit(layout.slots).cast("bigint"))


def step_start(step: Column, layout: Layout) -> Column:
    return slot(step, layout) * F.lit(layout.rows_per_step).cast("bigint")


def step_end(step: Column, layout: Layout) -> Column:
    return step_start(step, layout) + F.lit(layout.rows_per_step).cast("bigint")


def in_step(step: Column, index: Column, layout: Layout) -> Column:
    return (index >= step_start(step, layout)) & (index < step_end(step, layout))


def prompt_group(index: Column, samples: int) -> Column:
    return floor_div(index, samples)


def group_offset(index: Column, samples: int) -> Column:
    return F.pmod(index.cast("bigint"), F.lit(samples).cast("bigint"))


def shard_id(index: Column, shards: int) -> Column:
    return F.pmod(index.cast("bigint"), F.lit(shards).cast("bigint"))


def local_index(index: Column, shards: int) -> Column:
    return floor_div(index, shards)
