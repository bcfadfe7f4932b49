"""Positions and totals inside big groups, without one task per group.

A step or a batch may hold most of all rows, so no window is ever partitioned by a
step or batch alone. Rows are cut into blocks of ``width`` consecutive indices. Indices
are unique inside their group, hence a block has at most ``width`` rows; the table with one
row per block is accumulated as a tree, so that sparse indices (times, hashes) do as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowrelay.functions.addressing import floor_div
from rowrelay.session import ensure_checkpoint_dir

BLOCK = 1 << 16
FAN = 1 << 16  # children of a node in the tree of blocks
FEW = 1_000  # up to so many lowest rows are cut out of each task before the shuffle (Spark's limit for it)
SPREAD = 64  # parts of a group that are cut on their own


def block_of(index: str, width: int = BLOCK) -> Column:
    """Block number of a non-NULL index, typed as never NULL.

    A join on a nullable key adds its own NULL filter to either side. With keys that need
    none, the rows and their block table keep the same plan below, and Spark shuffles the
    rows once for both.
    """
    return F.coalesce(floor_div(F.col(index), width), F.lit(0).cast("bigint"))


def with_keys(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The rows, as long as keys and index are set: a row without them has no place and fails the job."""
    columns = {}
    for c in [*keys, index]:
        kind = df.schema[c].dataType
        failure = F.raise_error(F.lit(f"rows without {c} cannot be placed")).cast(kind)
        # The last value is never reached; it tells Spark that the column has no NULL.
        columns[c] = F.coalesce(F.col(c), failure, F.lit("0").cast(kind))
    return df.withColumns(columns)


def block_table(df: DataFrame, keys: list[str], index: str, width: int = BLOCK) -> DataFrame:
    """(keys, _block, _n, _before, _total): rows in the block, in lower blocks, in the group.

    Indices may be far apart, so that a group has as many blocks as rows. Blocks are therefore
    accumulated in a tree: ``FAN`` neighbouring blocks have one parent, and so on twice. With
    ``width`` 65,536 that covers all of 64 bits, and no window has more than ``FAN`` rows.
    """
    placed = df.select(*keys, block_of(index, width).alias("_block"))
    blocks = placed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_up", floor_div(F.col("_block"), FAN))
    ups = blocks.groupBy(*keys, "_up").agg(F.sum("_n").alias("_n")).withColumn("_top", floor_div(F.col("_up"), FAN))
    tops = ups.groupBy(*keys, "_top").agg(F.sum("_n").alias("_n"))

    def before(parents: list[str], place: str) -> Column:
        lower = Window.partitionBy(*parents).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(lower), F.lit(0))

    tops = tops.select(*keys, "_top", before(keys, "_top").alias("_b3"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    ups = ups.select(*keys, "_top", "_up", before([*keys, "_top"], "_up").alias("_b2")).join(tops, [*keys, "_top"])
    blocks = blocks.select(*keys, "_up", "_block", "_n", before([*keys, "_up"], "_block").alias("_b1")).join(ups, [*keys, "_up"])
    return blocks.select(*keys, "_block", "_n", (F.col("_b1") + F.col("_b2") + F.col("_b3")).alias("_before"), "_total")


def with_group_size(df: DataFrame, keys: list[str], index: str, size: str, width: int = BLOCK) -> DataFrame:
    """Add the row count of its group to every row."""
    df = with_keys(df, keys, index)
    table = block_table(df, keys, index, width).select(*keys, "_block", F.col("_total").alias(size))
    placed = df.withColumn("_block", block_of(index, width))
    return placed.join(table, [*keys, "_block"]).drop("_block")


def rank_by_block(
    df: DataFrame,
    keys: list[str],
    index: str,
    rank: str,
    size: str | None = None,
    limit: int | Column | None = None,
    width: int = BLOCK,
) -> DataFrame:
    """0-based rank of every row in its group, by a BIGINT index that is unique in the group.

    Rows with a NULL key or index fail the job.
    With ``limit`` only ranks below it are kept, and blocks that start beyond it are
    dropped before any row is moved. ``limit`` may use the columns ``keys`` and ``_total``.
    """
    df = with_keys(df, keys, index)
    table = block_table(df, keys, index, width)
    if limit is not None:
        limit = limit if isinstance(limit, Column) else F.lit(limit)
        table = table.filter(F.col("_before") < limit)
    placed = df.withColumn("_block", block_of(index, width))
    joined = placed.join(table.drop("_n"), [*keys, "_block"])
    inside = Window.partitionBy(*keys, "_block").orderBy(index)
    out = joined.withColumn(rank, F.col("_before") + F.row_number().over(inside) - 1)
    if limit is not None:
        out = out.filter(F.col(rank) < limit)
    if size:
        out = out.withColumn(size, F.col("_total"))
    return out.drop("_block", "_before", "_total")


def lowest(df: DataFrame, keys: list[str], index: str, k: int, rank: str, exact: bool = False) -> DataFrame:
    """The ``k`` rows with the lowest index of every group, with their 0-based rank.

    With ``exact`` a group with fewer than ``k`` rows gives no rows at all. A small ``k`` needs no
    tree of blocks: ``SPREAD`` parts of a group send ``k`` rows each at most.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if k <= FEW:

        def cut(rows: DataFrame, parts: list[str]) -> DataFrame:
            place = F.row_number().over(Window.partitionBy(*parts).orderBy(index))
            return rows.withColumn(rank, place.cast("bigint") - 1).withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")

        parted = with_keys(df, keys, index).withColumn("_spread", F.pmod(F.xxhash64(index), F.lit(SPREAD)))
        picked = cut(cut(parted, [*keys, "_spread"]).drop(rank, "_spread"), keys)
        if not exact:
            return picked
        return picked.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("_size") == k).drop("_size")
    picked = rank_by_block(df, keys, index, rank, size="_size", limit=k)
    return (picked.filter(F.col("_size") >= k) if exact else picked).drop("_size")


def distinct_per_group(df: DataFrame, keys: list[str], index: str, out: str) -> DataFrame:
    """Exact number of distinct indices per group.

    Indices are set in bitmaps of 32768 addresses before the shuffle, so a group of any
    size sends one bitmap per bucket and task instead of its rows.
    """
    bitmaps = df.groupBy(*keys, F.bitmap_bucket_number(F.col(index)).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(index))).alias("_bits")
    )
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("_bits")).cast("bigint").alias(out))


def dense_position(df: DataFrame, order_by: list[str], position: str) -> DataFrame:
    """0-based position of every row in the order of ``order_by`` (a unique key).

    For input without a usable integer index. Rows are range partitioned and sorted once
    and written as a checkpoint, so that the counts and the rows see the same ranges even
    when a task is repeated; then each range gets the number of rows before it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (
        df.repartitionByRange(*[F.col(c) for c in order_by])
        .sortWithinPartitions(*order_by)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
    )
    # monotonically_increasing_id: partition number above bit 33, row number below.
    part = F.call_function("shiftright", F.col("_mid"), F.lit(33))
    placed = ranged.withColumn("_part", part).withColumn("_row", F.col("_mid") - F.call_function("shiftleft", part, F.lit(33)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range, that is at most one per shuffle partition whatever the data size:
    # a single ordered window and a broadcast are bounded by that.
    lower = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(position, F.col("_before") + F.col("_row"))
        .drop("_mid", "_part", "_row", "_before")
    )
