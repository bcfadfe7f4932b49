"""Sharding by proportional stratified interleaving.

Within each source rows are ranked in the order of a seeded hash. The rank r of n rows becomes the
fraction (r + u) / n, u in [0, 1) from the same hash, so that sources of any size, single rows too,
spread evenly over [0, 1). All rows sorted by fraction are cut into shards of equal counts: the law
is ``rows``, counts differ by one at most, and every shard has the corpus's mixture of sources.

Both rankings work for sources of any size: the hash and the fraction are cut into equal ranges,
about ``RANGE_ROWS`` rows each, rows are ordered inside a range only, and ranges are accumulated in a
table with one row each. Texts are reduced to size and checksum before anything is shuffled.

Defined results: a NULL source is a source of its own; NULL text has size 1 (no bytes, plus 1) and
checksum 0; NULL ``doc_id`` is hashed like the text "null". Equal rows are interchangeable: each gets a
place of its own. Empty input gives no rows. Other columns of the input are not needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 8
SEED = 20
RANGE_ROWS = 1_000
SALTS = 64
# The largest number of ranges of one ranking: what one accumulating task sees.
MOST_RANGES = 1 << 16


def unit(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hexadecimal digest."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def ranked(df: DataFrame, groups: list[str], unit_column: str, order: list[str], ranges: Column, name: str) -> DataFrame:
    """0-based rank of every row in its group by ``unit_column`` (even in [0, 1)), then ``order``."""
    cut = df.withColumn("_range", F.least(F.floor(F.col(unit_column) * ranges), ranges - 1).cast("bigint"))
    counts = cut.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*groups, "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_range").orderBy(unit_column, *order)
    joined = cut.withColumn("_inside", F.row_number().over(inside)).join(before, [*groups, "_range"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside") - 1).alias(name))


def interleaved(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row."""
    data = F.col("text").cast("string").cast("binary")
    narrow = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("_no_source"),
        (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("bigint").alias("text_crc32"),
    ).withColumn("_key", F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32").cast("binary")))
    strata = ["source", "_no_source"]
    sizes = narrow.groupBy(*strata).agg(F.count(F.lit(1)).alias("_of"))
    # A large source meets its size in SALTS parts.
    spread_sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = narrow.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    counted = salted.join(spread_sizes, [*strata, "_salt"]).drop("_salt").withColumn("_u", unit(F.col("_key")))
    ranges = F.least(F.ceil(F.col("_of") / RANGE_ROWS), F.lit(MOST_RANGES))
    ties = ["_key", "doc_id", "size"]
    inside = ranked(counted, strata, "_u", ties, ranges, "_rank")
    spread = inside.withColumn("_fraction", (F.col("_rank") + F.col("_u")) / F.col("_of")).drop("_rank", "_of", "_u")
    total = sizes.agg(F.sum("_of")).first()[0] or 0
    whole = spread.withColumn("_total", F.lit(total).cast("bigint"))
    ranges = F.lit(max(1, min(-(-total // RANGE_ROWS), MOST_RANGES))).cast("bigint")
    placed = ranked(whole, [], "_fraction", ties, ranges, "_place")
    # Shard s holds the places from ceil(s * total / shards) on.
    shard = F.expr(f"(_place * {shards}L) div _total")
    first = F.expr(f"(shard * _total + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", F.when(~F.col("_no_source"), F.col("source")).alias("source"), "size", "text_crc32", "shard", (F.col("_place") - first).cast("bigint").alias("slot")
    )


def assignment(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; more shards would deal all rows anew."""
    return interleaved(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


# CRC-32 of the UTF-8 bytes, one byte after another; the table is made by its rule.
SQL = f"""
WITH RECURSIVE step AS (
    SELECT i AS byte, i AS c, 0 AS round FROM range(256) t(i)
    UNION ALL
    SELECT byte, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, round + 1 FROM step WHERE round < 8),
crc AS (SELECT list(c ORDER BY byte) AS crc_table FROM step WHERE round = 8),
doc AS (
    SELECT doc_id, source, (octet_length(encode(text)) + 1)::BIGINT AS size,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::BIGINT)),
               lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
    FROM documents, crc),
keyed AS (SELECT *, md5('{SEED}:' || doc_id || ':' || text_crc32) AS key FROM doc),
unit AS (SELECT *, ('0x' || substr(key, 1, 13))::BIGINT::DOUBLE / {float(2**52)!r} AS u FROM keyed),
spread AS (
    SELECT *, (row_number() OVER (PARTITION BY source ORDER BY u, key, doc_id, size) - 1 + u) / count(*) OVER (PARTITION BY source) AS fraction
    FROM unit),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, key, doc_id, size) - 1 AS place, count(*) OVER () AS total FROM spread),
cut AS (SELECT *, (place * {SHARDS}) // total AS shard FROM placed)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
       (place - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source
FROM cut"""
