"""Hard negatives of anchors: cover trees over norm-augmented vectors, searched inside windows of scores.

A row's score is its inner product with the anchor, over components floor(256 * x). An anchor's
positives are the best other rows of its label; a negative of a positive has another label and a score
between 80 % and 100 % of the positive's.

1. A bounded sample (``SAMPLE_BYTES``) gives at most ``CELLS`` pivots, farthest first; they route only. Every row
   goes to its nearest pivot's cell. Cells have a covering radius, so they are the top level of the tree; a cell is
   cut into blocks by a hash of the id, so no cell is a task however hot.
2. A block builds its cover tree; all anchors sent to it descend together, each to its best leaf first,
   leave out nodes outside of their window, and score leaves exactly.
3. Anchors visit their best cell first; their fifth score there tells which other cells can still matter. Windows
   of negatives go to the cells they meet. Only the answers of blocks (``k`` a window) leave them.

Defined results: rows with a NULL vec_id, label or vector, or any NULL or non-finite component take no part. Shorter
vectors count as filled up with zeros; an empty one scores 0. Rows that share a vec_id are one row, the smallest by
(label, vector). Ties go to the smaller vec_id. A positive without negatives gives no rows. Vectors whose
scores might not fit 64 bits (a squared length of 2^63 or more) fail the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowrelay.llm.common import written
from rowrelay.llm.covertree import NONE, CoverTree, augmented, bounds, spread_centres
from rowrelay.session import ship_package

POSITIVES, NEGATIVES = 5, 5
SHARE = (80, 100)  # negatives have 80 * positive_score <= 100 * score <= 100 * positive_score
SCALE = 256
CELLS, PER_CELL = 256, 2_048
SAMPLE_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20

POINT = "cell bigint, apart double, vec_id bigint, label bigint, vec binary"
ASK = "cell bigint, block bigint, anchor_id bigint, label bigint, vec binary, windows array<struct<positive_id: bigint, low: bigint, high: bigint>>"
FOUND = "anchor_id bigint, positive_id bigint, vec_id bigint, score bigint"
FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "vec_id", "score")])
LOWEST, HIGHEST = NONE + 1, 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, one for each vec_id."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def whole_numbers(column: list[list[float]], dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for row, vector in zip(out, column, strict=True):
        row[: len(vector)] = vector
    return np.floor(out * SCALE) + 0.0


def unpacked(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _placed(pivots: np.ndarray, dim: int, longest2: float):
    """Rows to their nearest pivot's cell, with the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = whole_numbers(part.column(2).to_pylist(), dim)
                full = augmented(x, longest2)
                near = (np.einsum("ij,ij->i", pivots, pivots) - 2 * full @ pivots.T).argmin(axis=1)
                apart = np.linalg.norm(full - pivots[near], axis=1)
                vectors = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near, pa.int64()), pa.array(apart), part.column(0), part.column(1), vectors], names=["cell", "apart", "vec_id", "label", "vec"]
                )

    return run


class Cells:
    """The top level: pivots, covering radii and the number of blocks of each cell."""

    def __init__(self, rows: DataFrame):
        ship_package(rows.sparkSession)
        norm2 = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0)))
        n, dim, longest2 = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm2)).first()
        self.dim, self.longest2 = max(1, dim or 0), (longest2 or 0.0) * (1 + 1e-9)
        if self.longest2 >= 2.0**63:
            raise OverflowError("the vectors are too long for scores of 64 bits")
        sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE_BYTES // (8 * self.dim), 16 * CELLS)))
        sample = whole_numbers([r["v"] for r in sampled.select("v").collect()] or [[0.0]], self.dim)
        full = augmented(sample, self.longest2)
        self.pivots = full[spread_centres(full, min(CELLS, max(1, math.ceil(n / PER_CELL))), math.inf)[0]]
        placed = rows.select("vec_id", "label", "v").mapInArrow(_placed(self.pivots, self.dim, self.longest2), POINT)
        points = written(placed, "points")
        per_block = max(64, BLOCK_BYTES // (8 * self.dim))
        stats = {r["cell"]: r for r in points.groupBy("cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
        self.radii = np.array([stats[i]["radius"] if i in stats else -1.0 for i in range(len(self.pivots))])
        self.blocks = [math.ceil(stats[i]["n"] / per_block) if i in stats else 0 for i in range(len(self.pivots))]
        self.raw = points
        cuts = F.create_map(*[F.lit(x) for i, b in enumerate(self.blocks) for x in (i, max(1, b))])
        self.points = points.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(cuts, F.col("cell").cast("int"))))

    def routed(self, asks: DataFrame, home: int) -> DataFrame:
        """Asks (anchor_id, label, vec, windows) to the blocks they must meet.

        ``home`` 1: only the best cell of each; -1: all others that meet a window; 0: all that meet a window.
        """
        pivots, dim, longest2, blocks = self.pivots, self.dim, self.longest2, self.blocks
        full, radii = np.flatnonzero(self.radii >= 0), np.maximum(0.0, self.radii) * (1 + 1e-12)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    q = unpacked(part.column(2), dim)
                    least, most = bounds(q, pivots[full], radii[full], longest2)
                    best = (q @ pivots[full][:, :-1].T).argmax(axis=1)
                    rows, cells, numbers = [], [], []
                    for i, windows in enumerate(part.column(3).to_pylist()):
                        for j, cell in enumerate(full.tolist()):
                            meets = any(most[i, j] >= w["low"] and least[i, j] <= w["high"] for w in windows)
                            if (home != 1 or j == best[i]) and (home != -1 or j != best[i]) and meets:
                                rows += [i] * blocks[cell]
                                cells += [cell] * blocks[cell]
                                numbers += range(blocks[cell])
                    sent = [c.take(pa.array(rows, pa.int64())) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(numbers, pa.int64()), *sent], names=["cell", "block", "anchor_id", "label", "vec", "windows"])

        return asks.select("anchor_id", "label", "vec", "windows").mapInArrow(run, ASK)

    def search(self, asks: DataFrame, same: bool, k: int, home: int = 0) -> DataFrame:
        """(anchor_id, positive_id, vec_id, score): the ``k`` best of every window in every block it meets."""
        points = self.points.select("cell", "block", "vec_id", "label", "vec")
        pairs = points.groupBy("cell", "block").cogroup(self.routed(asks, home).groupBy("cell", "block"))
        return pairs.applyInArrow(_descend(self.dim, self.longest2, same, k), FOUND)


def _descend(dim: int, longest2: float, same: bool, k: int):
    def run(points: pa.Table, asks: pa.Table) -> pa.Table:
        if not points.num_rows or not asks.num_rows:
            return FOUND_ARROW.empty_table()
        tree = CoverTree(unpacked(points.column("vec"), dim), points.column("vec_id").to_numpy(), points.column("label").to_numpy(), longest2)
        q, own, labels = unpacked(asks.column("vec"), dim), asks.column("anchor_id").to_numpy(), asks.column("label").to_numpy()
        windows = asks.column("windows").to_pylist()
        row = np.repeat(np.arange(len(q)), [len(w) for w in windows])
        positive = np.array([w["positive_id"] for ws in windows for w in ws], object)
        low, high = (np.array([w[c] for ws in windows for w in ws], np.int64) for c in ("low", "high"))
        out: list[list] = [[], [], [], []]
        for start in range(0, len(row), 4096):
            part = slice(start, start + 4096)
            at = row[part]
            scores, ids = tree.best(q[at], own[at], labels[at], same, low[part], high[part], k)
            i, j = np.nonzero(scores > NONE)
            for column, values in zip(out, (own[at][i], positive[part][i], ids[i, j], scores[i, j]), strict=True):
                column += values.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=FOUND_ARROW)

    return run


def window(low: Column, high: Column, positive: Column) -> Column:
    return F.struct(positive.cast("bigint").alias("positive_id"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def first_k(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, embedding).

    ``is_anchor`` and ``label`` (a row's label as it counts) may use vec_id and label.
    """
    rows = usable(vectors)
    if label is not None:
        rows = rows.withColumn("label", label.cast("bigint"))
    cells = Cells(rows)
    anchors = cells.raw.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    every = window(F.lit(LOWEST), F.lit(HIGHEST), F.lit(None))
    near = written(cells.search(anchors.withColumn("windows", F.array(every)), True, POSITIVES, home=1), "near")
    # Elsewhere only what reaches the last score of a full list matters.
    full = first_k(near, ["anchor_id"], POSITIVES).filter(F.col("rank") == POSITIVES).select("anchor_id", F.col("score").alias("reached"))
    onward = anchors.join(full, "anchor_id", "left").withColumn("windows", F.array(window(F.coalesce("reached", F.lit(LOWEST)), F.lit(HIGHEST), F.lit(None))))
    far = cells.search(onward, True, POSITIVES, home=-1)
    positives = written(first_k(near.union(far), ["anchor_id"], POSITIVES).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.ceil(F.col("positive_score").cast("decimal(20,0)") * SHARE[0] / SHARE[1])
    windows = positives.filter("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(window(least, F.col("positive_score"), F.col("positive_id"))).alias("windows"))
    negatives = first_k(cells.search(anchors.join(windows, "anchor_id"), False, NEGATIVES), ["anchor_id", "positive_id"], NEGATIVES)
    return negatives.join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = f"""
WITH usable AS (
    SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) AS n FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
point AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM usable WHERE n = 1),
pair AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
    FROM point a JOIN point b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND {SHARE[0]} * positive_score <= {SHARE[1]} * score AND {SHARE[1]} * score <= {SHARE[1]} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
