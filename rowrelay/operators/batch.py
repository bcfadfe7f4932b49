"""Algebra on batch metadata: DataFrames of (batch_id, batch_index, address, fields)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rowrelay.functions.blocks import BLOCK, block_of, rank_by_block, with_group_size, with_keys
from rowrelay.functions.fieldmaps import extract_fields, is_ndarray, is_row_ready, is_tensor, merge_right
from rowrelay.schema import KEY, META, NOT_PRODUCED, READY

BATCH = ["batch_id"]


def from_samples(samples: DataFrame, order: str, batch: str = "batch_id") -> DataFrame:
    """Number the rows of each batch from 0 in the order of a BIGINT column unique in it."""
    return rank_by_block(samples, [batch], order, "batch_index")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], META)


def size(meta: DataFrame) -> DataFrame:
    return meta.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))


def global_indexes(meta: DataFrame, ordered: bool = False) -> DataFrame:
    """Index per batch position; the order is in ``batch_index``, one row per address."""
    out = meta.select("batch_id", "batch_index", "global_index")
    return out.orderBy("batch_id", "batch_index") if ordered else out


def field_names(meta: DataFrame) -> DataFrame:
    """Sorted field names of the first row of each batch."""
    first = meta.filter("batch_index = 0")
    return first.select("batch_id", F.array_sort(F.map_keys("fields")).alias("field_names"))


def is_ready(meta: DataFrame) -> DataFrame:
    """Whether all rows of each batch are ready."""
    return meta.groupBy("batch_id").agg(F.every(is_row_ready(F.col("fields"))).alias("is_ready"))


def batch_is_ready(meta: DataFrame) -> DataFrame:
    """One row for a single batch: ready unless some row is not; an empty batch is ready."""
    return meta.agg(F.coalesce(F.every(is_row_ready(F.col("fields"))), F.lit(True)).alias("is_ready"))


def batch_index_or_default(index: Column) -> Column:
    """Position of a row, -1 outside any batch."""
    return F.coalesce(index.cast("bigint"), F.lit(-1).cast("bigint"))


def extract_field_metas(data: DataFrame, fields: list[str], set_all_ready: bool = True) -> DataFrame:
    """Replace the data columns by one field map per row."""
    others = [c for c in data.columns if c not in fields]
    status = READY if set_all_ready else NOT_PRODUCED
    return data.select(*others, extract_fields(data.schema, fields, status).alias("fields"))


def add_fields(meta: DataFrame, data: DataFrame, fields: list[str], set_all_ready: bool = True) -> DataFrame:
    """Attach the fields of ``data`` by position; a field both have is replaced.

    A position only one side has fails the job: lengths must match.
    """
    on = ["batch_id", "batch_index"] if "batch_id" in data.columns else ["batch_index"]
    new = extract_field_metas(data.select(*on, *fields), fields, set_all_ready)
    new = new.withColumnRenamed("fields", "_new").withColumn("_r", F.lit(1))
    joined = meta.withColumn("_l", F.lit(1)).join(new, on, "full_outer")
    merged = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), merge_right(F.col("fields"), F.col("_new")))
    merged = merged.otherwise(F.raise_error(F.lit("a position is missing on one side of the new fields")).cast(meta.schema["fields"].dataType))
    return joined.select(*[merged.alias("fields") if c == "fields" else F.col(c) for c in meta.columns])


def union_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """(batch_id, address, surplus) of addresses the two sides do not hold equally often."""
    mine = left.select(*BATCH, *KEY, F.lit(1).alias("d"))
    theirs = right.select(*BATCH, *KEY, F.lit(-1).alias("d"))
    sums = mine.unionByName(theirs).groupBy(*BATCH, *KEY).agg(F.sum("d").alias("surplus"))
    return sums.filter("surplus <> 0")


def union(left: DataFrame, right: DataFrame, validate: bool = True) -> DataFrame:
    """Merge fields of two batches over the same rows; the right side wins, the left order stays.

    With ``validate`` differing rows are an error (one extra job); without it left rows
    that the right side lacks pass through.
    """
    if validate and not union_mismatch(left, right).isEmpty():
        raise ValueError("the two batches hold different rows")
    theirs = right.groupBy(*BATCH, *KEY).agg(F.max_by("fields", "batch_index").alias("_new"))
    joined = left.join(theirs, [*BATCH, *KEY], "left")
    merged = F.coalesce(merge_right(F.col("fields"), F.col("_new")), F.col("fields"))
    return joined.select(*[merged.alias("fields") if c == "fields" else F.col(c) for c in left.columns])


def concat(parts: list[DataFrame], validate: bool = True) -> DataFrame | None:
    """Rows of all parts in list order as one batch; field names must agree."""
    if not parts:
        return None
    if validate:
        names = reduce(DataFrame.unionByName, [_first_names(p) for p in parts])
        if names.distinct().limit(2).count() > 1:
            raise ValueError("the parts bring different fields")
    tagged = reduce(DataFrame.unionByName, [p.withColumn("part_no", F.lit(i).cast("bigint")) for i, p in enumerate(parts)])
    batch = F.lit(0).cast("bigint")
    return concat_parts(tagged.withColumn("batch_id", batch)).select(*[c for c in parts[0].columns])


def _first_names(part: DataFrame) -> DataFrame:
    """One row, for an empty part too."""
    first = part.filter("batch_index = 0").select(F.array_sort(F.map_keys("fields")).alias("names"))
    return first.agg(F.coalesce(F.first("names"), F.array().cast("array<string>")).alias("names"))


def concat_parts(meta: DataFrame, part: str = "part_no") -> DataFrame:
    """Concatenate the parts of each batch: rows are renumbered by (part, position)."""
    placed = with_keys(meta, ["batch_id", part], "batch_index").withColumn("_block", block_of("batch_index"))
    blocks = placed.groupBy("batch_id", part, "_block").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy("batch_id").orderBy(part, "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0))).drop("_n")
    joined = placed.join(offsets, ["batch_id", part, "_block"])
    # Positions are dense in a part, so the place inside the block is plain arithmetic.
    position = F.col("_before") + F.col("batch_index") - F.col("_block") * BLOCK
    return joined.withColumn("batch_index", position).drop("_block", "_before", part)


def chunk(meta: DataFrame, chunks: int) -> DataFrame:
    """Split each batch into ``chunks`` parts in order; the first ones are one row larger.

    ``chunk_id`` names the part and ``batch_index`` restarts in it.
    """
    sized = with_group_size(meta, BATCH, "batch_index", "_size")
    base = F.call_function("div", F.col("_size"), F.lit(chunks).cast("bigint"))
    rest = F.col("_size") - base * chunks
    big = rest * (base + 1)
    index = F.col("batch_index")
    in_big = index < big
    small_base = F.greatest(base, F.lit(1).cast("bigint"))
    chunk_id = F.when(in_big, F.call_function("div", index, base + 1)).otherwise(
        rest + F.call_function("div", index - big, small_base)
    )
    start = F.when(F.col("chunk_id") < rest, F.col("chunk_id") * (base + 1)).otherwise(
        big + (F.col("chunk_id") - rest) * base
    )
    out = sized.withColumn("chunk_id", chunk_id).withColumn("_start", start)
    return out.withColumn("batch_index", index - F.col("_start")).drop("_size", "_start")


def chunk_sizes(meta: DataFrame, chunks: int) -> DataFrame:
    """Rows of every chunk of every batch, empty chunks included."""
    base = F.call_function("div", F.col("size"), F.lit(chunks).cast("bigint"))
    rest = F.col("size") - base * chunks
    return (
        size(meta)
        .withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
        .select("batch_id", "chunk_id", (base + F.when(F.col("chunk_id") < rest, 1).otherwise(0)).alias("size"))
    )


def reorder(meta: DataFrame, order: DataFrame) -> DataFrame:
    """Rows renumbered by ``order`` (batch_id, batch_index = new, old_index = old position).

    ``order`` may leave out or repeat old positions; the batch has as many rows as ``order``.
    """
    old = meta.withColumnRenamed("batch_index", "old_index")
    return old.join(order, ["batch_id", "old_index"]).select(*meta.columns)


def reorder_list(meta: DataFrame, batch_id: int, indices: list[int]) -> DataFrame:
    """``reorder`` of one batch by a short list; negative positions count from the end."""
    spark = meta.sparkSession
    wanted = spark.createDataFrame(
        [(batch_id, i, old) for i, old in enumerate(indices)], "batch_id bigint, batch_index bigint, old_index bigint"
    )
    total = F.broadcast(size(meta.filter(F.col("batch_id") == batch_id)))
    known = wanted.join(total, "batch_id", "left")
    n = F.coalesce("size", F.lit(0))
    ok = (F.col("old_index") >= -n) & (F.col("old_index") < n)
    old = F.when(ok, F.pmod(F.col("old_index"), n)).otherwise(
        F.raise_error(F.lit("reorder index out of range")).cast("bigint")
    )
    order = known.select("batch_id", "batch_index", old.alias("old_index"))
    return reorder(meta.filter(F.col("batch_id") == batch_id), order)


def getitem(meta: DataFrame, item: int) -> DataFrame:
    """The row at position ``item`` of every batch as a batch of one; negative counts from the end."""
    if isinstance(item, bool) or not isinstance(item, int):
        raise TypeError(f"a batch position must be an int, not {type(item).__name__}")
    if item >= 0:
        at = meta.filter(F.col("batch_index") == item)
        short = size(meta).filter(F.col("size") <= item)
    else:
        sizes = size(meta)
        wanted = sizes.select("batch_id", (F.col("size") + item).alias("batch_index"))
        at = meta.join(wanted.filter("batch_index >= 0"), ["batch_id", "batch_index"], "left_semi")
        short = sizes.filter(F.col("size") < -item)
    failed = short.select(
        "batch_id", F.raise_error(F.lit("batch index out of range")).cast("bigint").alias("batch_index")
    )
    checked = at.withColumn("batch_index", F.lit(0).cast("bigint"))
    # `failed` has no rows unless a batch is too short; evaluating its row raises the error.
    return checked.unionByName(failed, allowMissingColumns=True)


def layout_report(data: DataFrame, fields: list[str], batch: str = "batch_id") -> DataFrame:
    """Per batch and field: dense (one shape), ragged (tensors of several shapes) or non-tensor."""
    types = {f.name: f.dataType for f in data.schema}
    aggregates = []
    for i, f in enumerate(fields):
        c, kind = F.col(f"`{f}`"), types[f]
        if not is_tensor(kind):
            aggregates.append(F.lit("non-tensor").alias(f"_l{i}"))
            continue
        if is_ndarray(kind):
            shape = F.array_join(c["shape"].cast("array<string>"), "x")
        elif isinstance(kind, T.ArrayType):
            shape = F.size(c)
        else:
            shape = F.lit(0)
        unset = F.max(c.isNull())
        same = F.min(F.when(c.isNotNull(), shape)) == F.max(F.when(c.isNotNull(), shape))
        aggregates.append(
            F.when(unset, "non-tensor").when(same, "dense").otherwise("ragged").alias(f"_l{i}")
        )
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"_l{i}").alias("layout")) for i, f in enumerate(fields)]
    report = data.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), *[a for a in aggregates])
    return report.select(batch, "rows", F.explode(F.array(*pairs)).alias("p")).select(batch, "rows", "p.*")


# --- attributes of a batch: expressions on MAP<STRING, STRING> ----------------------


def get_extra_info(info: Column, key: str, default: str | None = None) -> Column:
    return F.when(F.map_contains_key(info, key), F.try_element_at(info, F.lit(key))).otherwise(F.lit(default))


def set_extra_info(info: Column, key: str, value: Column | str) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return merge_right(info, F.create_map(F.lit(key), value.cast("string")))


def update_extra_info(info: Column, other: Column) -> Column:
    return merge_right(info, other)


def remove_extra_info(info: Column, key: str) -> Column:
    return F.map_filter(info, lambda k, _: k != key)


def clear_extra_info(info: Column) -> Column:
    return F.map_filter(info, lambda k, _: F.lit(False))


def has_extra_info(info: Column, key: str) -> Column:
    return F.map_contains_key(info, key)


# Attributes of batches as tables: (batch_id, extra_info), one row per batch.


def chunk_info(info: DataFrame, chunks: int) -> DataFrame:
    """Every chunk of a batch has the attributes of the batch."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))
    return info.withColumn("chunk_id", F.explode(numbers))


def concat_info(parts: DataFrame, part: str = "part_no") -> DataFrame:
    """Attributes of the concatenation of each batch's parts: the first part that has a key wins."""
    entries = parts.select("batch_id", part, F.explode_outer("extra_info").alias("key", "value"))
    first = entries.filter("key IS NOT NULL").groupBy("batch_id", "key").agg(F.min_by("value", part).alias("value"))
    merged = first.groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("extra_info"))
    none = F.create_map().cast("map<string,string>")
    batches = parts.select("batch_id").distinct()
    return batches.join(merged, "batch_id", "left").select("batch_id", F.coalesce("extra_info", none).alias("extra_info"))


def union_info(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attributes of the union of two batches: the right side wins."""
    theirs = right.select("batch_id", F.col("extra_info").alias("_other"))
    joined = left.join(theirs, "batch_id", "left")
    return joined.select("batch_id", F.coalesce(merge_right(F.col("extra_info"), F.col("_other")), F.col("extra_info")).alias("extra_info"))


def concat_extra_info(infos: list[Column]) -> Column:
    """Attributes of a concatenation: the first part that has a key wins."""
    return reduce(lambda kept, other: merge_right(other, kept), infos)


def union_extra_info(left: Column, right: Column) -> Column:
    """Attributes of a union: the other side wins."""
    return merge_right(left, right)
