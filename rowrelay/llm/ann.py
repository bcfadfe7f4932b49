"""Approximate nearest neighbours by cross-polytope hashing.

Each table has a pseudo-rotation: three rounds of random signs and a fast Hadamard transform. A vector
falls into the bin of the signed axis, among ``AXES`` axes at most, that is nearest to its rotated direction. A
query looks into the ``PROBES`` nearest axes of each table, and what it finds is reranked by the exact
inner product in double precision. The angles of neighbours grow with the dimension, so there are more tables for
more dimensions (``tables_for``).

For the largest inner product among vectors of any length, vectors are cut into ranges of norms, the longest
of a range about 1.4 times the shortest, and each range is hashed and searched by itself: a long vector has no part in where
others fall. In a range of few vectors the best need not be close in angle, so all queries meet all vectors of ranges
of up to ``FEW``, block by block.

Equal vectors are one class with its smallest ids (as many as a result may need), so a vector that
fills a third of the table is searched and found once. A bin is cut into blocks of points and of
queries, and every pair of blocks of a bin is one group: no bin is capped, and no task holds a whole bin.
A query that finds fewer neighbours than it must return is compared with all classes, block by block.

Defined results: rows without id and vectors that are NULL, empty, zero or hold NULL or non-finite
components take no part, as query or candidate. Shorter vectors count as filled up with zeros. Ties go
to the smaller id. Repeated rows of one id and vector count once. Empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowrelay.llm.common import written
from rowrelay.session import ship_package

TABLES, PROBES, AXES = 8, 32, 128
FEW = 1_024  # vectors of a range that are met without hashing
NEAREST = 20
POINT_BLOCK, QUERY_BLOCK = 4_096, 1_024


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, h = y.shape[1], 1
    while h < n:
        pairs = y.reshape(len(y), n // (2 * h), 2, h)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), n)
        h *= 2
    return y / math.sqrt(n)


def rotated(vectors: np.ndarray, table: int, seed: int = 5) -> np.ndarray:
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, vectors.shape[1]))
    for s in signs:
        vectors = hadamard(vectors * s)
    return vectors


def signed_axes(turned: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` signed axes nearest to every row, as 2 * axis + (1 where negative)."""
    values = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
    if probes == 1:
        return values.argmax(axis=1)[:, None]
    return np.argsort(-values, axis=1, kind="stable")[:, :probes]


def padded(dim: int) -> int:
    return 1 << dim.bit_length()


def tables_for(dim: int) -> int:
    """``TABLES`` up to 127 dimensions, three more each time the padded dimension doubles."""
    return TABLES + 3 * max(0, padded(dim).bit_length() - AXES.bit_length())


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row at length 1, and the number of its range of norms (norms around 1 share one)."""
    most = np.abs(x).max(axis=1, keepdims=True)
    unit = x / most
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    return unit / length, np.floor(2 * (np.log2(most) + np.log2(length)) + 0.5).ravel().astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _packed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vector in batch.column(1).to_pylist():
                row = np.zeros(dim)
                row[: len(vector)] = vector
                rows.append((row + 0.0).tobytes())
            vectors = pa.array(rows, pa.binary())
            norms = directions(matrix(vectors, dim))[1] if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(norms)], names=["vec_id", "vec", "range"])

    return run


def _binned(dim: int, ranges: list[int], asks: bool):
    """Rows (id, vec, range) to (bin, id, vec) for all tables; queries have several probes, in each of ``ranges``."""
    size, tables = padded(dim), tables_for(dim)
    axes_used = min(size, AXES)
    place = {number: i for i, number in enumerate(ranges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                if not batch.num_rows:
                    continue
                full = np.zeros((batch.num_rows, size))
                full[:, :dim] = directions(matrix(batch.column(1), dim))[0]
                own = None if asks else np.array([place[x] for x in batch.column(2).to_pylist()])
                for table in range(tables):
                    axes = signed_axes(rotated(full, table)[:, :axes_used], PROBES if asks else 1)
                    at = np.repeat(np.arange(len(full)), axes.shape[1])
                    take = pa.array(at)
                    ids, vectors = batch.column(0).take(take), batch.column(1).take(take)
                    for i in range(len(ranges)) if asks else [own]:
                        bins = pa.array((axes.ravel() + (table + i * tables) * 2 * axes_used).astype(np.int64))
                        yield pa.RecordBatch.from_arrays([bins, ids, vectors], names=["bin", "id", "vec"])

    return run


def _best(dim: int, most: int):
    """The ``most`` largest inner products of each query of a group among the points of the group, ties to the smaller id.

    Fast products choose: all that rounding may leave among the best. Equal ones thus stay until the ids decide.
    """

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not points.num_rows or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = points.column("id").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], matrix(points.column("vec").combine_chunks(), dim)[order]
        asked, q = queries.column("id").to_numpy(), matrix(queries.column("vec").combine_chunks(), dim)
        keep = min(len(ids), most)
        products = q @ x.T
        slack = 4 * dim * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        least = np.partition(products, len(ids) - keep, axis=1)[:, len(ids) - keep] - slack
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for vector, row, bound in zip(q, products, least, strict=True):
            picked = np.flatnonzero(~(row < bound))
            scores = (vector * x[picked]).sum(axis=1)  # the same order of additions wherever a vector stands
            best = np.argsort(-scores, kind="stable")[:keep]  # ids ascend
            out.append((ids[picked[best]], scores[best]))
        return pa.table({"query": np.repeat(asked, keep), "id": np.concatenate([i for i, _ in out]), "score": np.concatenate([x for _, x in out])})

    return run


def in_blocks(points: DataFrame, queries: DataFrame, dim: int, most: int) -> DataFrame:
    """(query, id, score) of every query among the points (bin, id, vec) of its bins."""
    n_points = points.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / POINT_BLOCK).alias("point_blocks"))
    n_queries = queries.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("query_blocks"))
    blocks = n_points.join(n_queries, "bin")

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(of))

    def others(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))

    left = points.join(blocks, "bin").withColumn("pb", block("point_blocks")).withColumn("qb", others("query_blocks"))
    right = queries.join(blocks, "bin").withColumn("qb", block("query_blocks")).withColumn("pb", others("point_blocks"))
    columns = ["bin", "pb", "qb", "id", "vec"]
    pairs = left.select(columns).groupBy("bin", "pb", "qb").cogroup(right.select(columns).groupBy("bin", "pb", "qb"))
    found = pairs.applyInArrow(_best(dim, most), "query bigint, id bigint, score double")
    return found.groupBy("query", "id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) where ``is_query`` holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    size = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    dim = int(size)
    members = rows.mapInArrow(_packed(dim), "vec_id bigint, vec binary, range bigint").distinct()
    members = written(members.withColumn("asks", is_query).withColumn("class", F.md5("vec")), "vectors")
    # Of a class: its smallest id, and as many of the smallest as one result may hold.
    place = F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))
    lowest = members.select("class", "vec_id").withColumn("place", place).filter(F.col("place") <= k + 1)
    ids = lowest.groupBy("class").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = written(members.join(ids, ["class", "vec_id"]).select("class", F.col("vec_id").alias("id"), "ids", "vec", "range"), "classes")
    asking = members.filter("asks").select("class", F.col("vec_id").alias("query_id"))
    asked = classes.join(asking.select("class").distinct(), "class", "left_semi")
    binned = "bin bigint, id bigint, vec binary"
    # A few thousand ranges at most, whatever the input: the exponents of doubles.
    ranges = sorted(r["range"] for r in classes.groupBy("range").count().filter(F.col("count") > FEW).collect())
    whole = F.lit(-1).cast("bigint").alias("bin")
    hashed = F.col("range").isin(ranges)
    few = classes.filter(~hashed).select(whole, "id", "vec")
    index = classes.filter(hashed).select("id", "vec", "range").mapInArrow(_binned(dim, ranges, False), binned)
    probes = asked.select("id", "vec", "range").mapInArrow(_binned(dim, ranges, True), binned)
    index, probes = written(index.union(few), "index"), written(probes.union(asked.select(whole, "id", "vec")), "probes")
    most = k + 1
    found = written(in_blocks(index, probes, dim, most), "found")
    # Too few ids found: those queries meet every class, in blocks.
    sizes = classes.select("id", F.size("ids").alias("n"))
    reach = found.join(sizes, "id").groupBy(F.col("query").alias("id")).agg(F.sum("n").alias("reached"))
    enough = min(k + 1, classes.agg(F.sum(F.size("ids"))).first()[0])
    short = asked.select("id", "vec").join(reach, "id", "left").filter(F.coalesce("reached", F.lit(0)) < enough)
    short = written(short.select(whole, "id", "vec"), "short")
    if short.limit(1).count():
        found = found.union(in_blocks(classes.select(whole, "id", "vec"), short, dim, most)).groupBy("query", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)
    spread = top.join(classes.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    spread = spread.withColumn("place", F.row_number().over(by_class)).filter(F.col("place") <= most)
    named = asking.join(classes.select("class", F.col("id").alias("query")), "class").select("query_id", "query")
    answers = named.join(spread, "query").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
