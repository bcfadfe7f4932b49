"""Production and clear events as streams.

An event row is a produced cell or, with a NULL field, the clear of its step:
(global_step, global_index, field, dtype, shape, put_seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from rowrelay.functions import addressing as A
from rowrelay.functions.blocks import BLOCK
from rowrelay.layout import Layout
from rowrelay.operators.bitmaps import production_bitmaps
from rowrelay.schema import INDEX, STEP
from rowrelay.sources.tables import Tables

# What a producer announces after a put: which fields it wrote onto which rows, of what type and
# shape each. Indices are given as ranges [first, last], so that a put of any size is a small message.
NOTIFICATION = T.StructType(
    [
        T.StructField(STEP, T.LongType()),
        T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField(
            "fields",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("field", T.StringType()),
                        T.StructField("dtype", T.StringType()),
                        T.StructField("shape", T.ArrayType(T.IntegerType())),
                    ]
                )
            ),
        ),
        T.StructField("put_seq", T.LongType()),
    ]
)


def explode_notifications(notifications: DataFrame) -> DataFrame:
    """Announcements to production rows; works on streams and on tables."""
    ranges = notifications.select(STEP, F.explode("ranges").alias("r"), "fields", "put_seq")
    rows = ranges.select(STEP, F.explode(F.sequence("r.first", "r.last")).alias(INDEX), "fields", "put_seq")
    cells = rows.select(STEP, INDEX, F.posexplode("fields").alias("field_pos", "f"), "put_seq")
    return cells.select(
        STEP, INDEX, "f.field", "field_pos", "f.dtype", "f.shape", "put_seq", F.lit(0).cast("bigint").alias("write_pos")
    )


def append_production(stream: DataFrame, tables: Tables, checkpoint: str, **trigger):
    """Continuously append production rows to the log.

    A micro-batch repeated after a failure adds rows that are there already, which changes
    nothing: presence in the log is a set.
    """

    def append(rows: DataFrame, _epoch: int) -> None:
        tables.append("production", rows)
        tables.append("bitmaps", production_bitmaps(rows))

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def spread_clears(clears: DataFrame, layout: Layout, width: int = BLOCK) -> DataFrame:
    """A clear event (global_step, put_seq) for every address block of its step."""
    first = A.floor_div(A.step_start(F.col(STEP), layout), width)
    last = A.floor_div(A.step_end(F.col(STEP), layout) - 1, width)
    return clears.select(STEP, F.explode(F.sequence(first, last)).alias("_block"), "put_seq")
