"""Putting data: addresses for new rows, segments of written cells, production rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowrelay.functions import addressing as A
from rowrelay.functions.blocks import dense_position, rank_by_block
from rowrelay.functions.fieldmaps import cell_dtype, cell_shape
from rowrelay.layout import Layout
from rowrelay.schema import INDEX, KEY, STEP

SEGMENT_COLUMNS = [*KEY, "put_seq", "write_pos", "fields_written"]


def repeat_interleave(prompts: DataFrame, samples: int, position: str, out: str = "batch_index") -> DataFrame:
    """Every row ``samples`` times; copies of the row at position p get p*samples, p*samples+1, ..."""
    copies = prompts.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return copies.withColumn(out, (F.col(position) * samples + F.col("_rep")).cast("bigint")).drop("_rep")


def number_rows(df: DataFrame, order_by: list[str], position: str = "batch_index") -> DataFrame:
    """Dense 0-based position of unnumbered input rows in the order of ``order_by``, within each step if they name one."""
    if STEP not in df.columns:
        return dense_position(df, order_by, position)
    # In the order of (step, keys) the rows of a step are neighbours: count from its first one.
    placed = dense_position(df, [STEP, *[c for c in order_by if c != STEP]], "_all")
    first = placed.groupBy(STEP).agg(F.min("_all").alias("_first"))
    return placed.join(first, STEP).withColumn(position, F.col("_all") - F.col("_first")).drop("_all", "_first")


def insert_rows(df: DataFrame, layout: Layout, index: str, strict: bool = True) -> DataFrame:
    """Address the rows of whole steps: the i-th row of a step gets its step's start + i.

    ``df`` has ``global_step`` and a BIGINT column ``index`` that is unique within a step.
    A step must bring exactly ``rows_per_step`` rows; ``strict`` fails the job otherwise,
    else ``is_full`` tells.
    """
    ranked = rank_by_block(df, [STEP], index, "batch_index", size="_size")
    full = F.col("_size") == layout.rows_per_step
    address = A.step_start(F.col(STEP), layout) + F.col("batch_index")
    if strict:
        message = F.concat(
            F.lit(f"a step needs {layout.rows_per_step} rows, step "),
            F.col(STEP).cast("string"),
            F.lit(" has "),
            F.col("_size").cast("string"),
        )
        address = F.when(full, address).otherwise(F.raise_error(message).cast("bigint"))
    out = ranked.withColumn(INDEX, address)
    return out.drop("_size") if strict else out.withColumn("is_full", full).drop("_size")


def insert_positions(df: DataFrame, layout: Layout, position: str = "batch_index", whole: bool = True) -> DataFrame:
    """Address rows of whole steps that already know their position in the step.

    The positions of every step must be exactly 0 .. ``rows_per_step`` - 1, else the job
    fails before anything is written. They are checked in a pass over the positions alone
    whose result is one value, so the rows themselves are not moved.

    Without ``whole`` a step may bring fewer rows, such as the last one of a table: each position of it once at most.
    """
    narrow = df.select(STEP, F.col(position).cast("bigint").alias("_p"))
    buckets = narrow.groupBy(STEP, F.bitmap_bucket_number("_p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"),
        F.count(F.lit(1)).alias("_rows"),
        F.min("_p").alias("_low"),
        F.max("_p").alias("_high"),
    )
    per_step = buckets.groupBy(STEP).agg(
        F.sum(F.bitmap_count("_bits")).alias("_distinct"),
        F.sum("_rows").alias("_rows"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
    )
    size = layout.rows_per_step
    right = (F.col("_distinct") == F.col("_rows")) & (F.col("_low") >= 0) & (F.col("_high") <= size - 1)
    if whole:
        right &= F.col("_rows") == size
    needed = f"{size} rows" if whole else f"at most {size} rows"
    wrong = F.concat(
        F.lit(f"a step needs {needed} at positions 0 to {size - 1}, step "),
        F.col(STEP).cast("string"), F.lit(" has "), F.col("_rows").cast("string"),
        F.lit(" from "), F.col("_low").cast("string"), F.lit(" to "), F.col("_high").cast("string"),
    )
    empty = F.when(F.count(F.lit(1)) == 0, F.lit(f"a step needs {size} rows, there are none"))
    found = per_step.agg(F.coalesce(F.min(F.when(~F.coalesce(right, F.lit(False)), wrong)), empty).alias("m")).scalar()
    address = A.step_start(F.col(STEP), layout) + F.col(position)
    return df.withColumn(INDEX, F.when(found.isNull(), address).otherwise(F.raise_error(found).cast("bigint")))


def transfer_rows(meta: DataFrame, data: DataFrame, shards: int | None = None) -> DataFrame:
    """Give each input row the address that the batch holds at the row's position.

    Both sides carry ``batch_index`` (and ``batch_id`` when several batches are handled).
    A position without an input row fails the job; input beyond the batch is left out. An
    address that the input carries from an earlier read gives way to the batch's.
    """
    on = [c for c in ("batch_id", "batch_index") if c in meta.columns and c in data.columns]
    data = data.drop(*[c for c in meta.columns if c not in on])
    out = meta.drop("fields").join(data.withColumn("_given", F.lit(True)), on, "left")
    missing = F.raise_error(F.lit("the batch has positions without a row")).cast("bigint")
    out = out.withColumn(INDEX, F.when(F.col("_given"), F.col(INDEX)).otherwise(missing)).drop("_given")
    if shards is not None:
        out = out.withColumn("shard_id", A.shard_id(F.col(INDEX), shards))
        out = out.withColumn("local_index", A.local_index(F.col(INDEX), shards))
    return out


def segment(rows: DataFrame, fields: list[str], put_seq: int | Column, write_pos: str | None = None) -> DataFrame:
    """Rows of one put: address, sequence, names of the written fields and their values.

    ``write_pos`` orders rows that hit the same address within the put: the last wins.
    """
    seq = put_seq if isinstance(put_seq, Column) else F.lit(put_seq)
    pos = F.col(write_pos) if write_pos else F.lit(0)
    return rows.select(
        *[F.col(k).cast("bigint").alias(k) for k in KEY],
        seq.cast("bigint").alias("put_seq"),
        pos.cast("bigint").alias("write_pos"),
        F.array(*[F.lit(f) for f in fields]).alias("fields_written"),
        *[F.col(f"`{f}`") for f in fields],
    )


def production_rows(segment_rows: DataFrame, fields: list[str]) -> DataFrame:
    """One production row per written cell, with the dtype and shape of the written value."""
    types = {f.name: f.dataType for f in segment_rows.schema}
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.lit(i).alias("field_pos"),
                cell_dtype(F.col(f"`{f}`"), types[f]).alias("dtype"),
                cell_shape(F.col(f"`{f}`"), types[f]).alias("shape"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return segment_rows.select(*KEY, "put_seq", "write_pos", F.explode(cells).alias("c")).select(*KEY, "c.*", "put_seq", "write_pos")


def clear_row_segment(rows: DataFrame, field_types: dict[str, T.DataType], put_seq: int | Column) -> DataFrame:
    """Clearing rows is a put of NULL into every known field; the status is not touched."""
    nulls = rows.select("*", *[F.lit(None).cast(t).alias(f) for f, t in field_types.items()])
    return segment(nulls, list(field_types), put_seq)


def conflicting_types(known: dict[str, T.DataType], incoming: T.StructType, fields: list[str]) -> list[str]:
    """Fields whose type differs from the one the first put fixed; whether it admits NULL does not count."""
    return [f for f in fields if f in known and known[f].simpleString() != incoming[f].dataType.simpleString()]
