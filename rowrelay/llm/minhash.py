"""Near-duplicate documents by b-bit MinHash.

Every document is the set of its distinct 5-word shingles. ``HASHES`` minima give the band keys
(``ROWS`` minima each); of each minimum only the ``BITS`` lowest bits are kept, packed into longs. Two
sets of similarity J share a band with probability 1 - (1 - J**ROWS)**BANDS, that is 0.999995 at 0.75.
Bit counts of two signatures estimate the similarity, corrected for chance agreement of low bits;
what the estimate leaves is confirmed on the full sets.

Groups of any size stay linear. Equal sets are one class, found by their digest. In each band bucket
classes are paired with one centre only, and with another centre in every band; of the centres that share
most bands with a class the best by the estimate is confirmed, and the links are joined to components. Buckets that then still hold
several components compare the classes outside their largest component with the others, on
full sets, block by block, so that no link inside a bucket is lost. Nothing is capped.

Defined results: NULL text, empty text and text of white space have no shingles, link with nothing
and are kept. Fewer than five words are one shingle. A row without ``doc_id`` links with nothing
(component NULL) and is kept. Rows of one ``doc_id`` with equal text get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowrelay.llm.common import WordHashes, map_batches, mixed, odd_numbers, slices, window_hashes, written
from rowrelay.llm.components import components
from rowrelay.session import ship_package

SHINGLE = 5
SHARE = (75, 100)  # links have 100 * intersection >= 75 * union
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
PER_LONG = 64 // BITS
CHANCE = 2.0**-BITS
ESTIMATED = 3  # centres of a class whose similarity is estimated
BLOCK = 512  # sets of a block that are compared at once
# Six standard deviations of the estimate at similarity 0.75: lower estimates are no links.
SLACK = 6 * (0.75 * 0.25 / HASHES) ** 0.5 / (1 - CHANCE)

FACTORS = odd_numbers(HASHES, 11).astype(np.uint32) | np.uint32(1)
SHIFTS = odd_numbers(HASHES, 12).astype(np.uint32)
WORDS = WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII space splits
    return np.unique(window_hashes(WORDS.of(words), min(SHINGLE, len(words)) or 1))


def minima(shingles: np.ndarray) -> np.ndarray:
    low = shingles.astype(np.uint32)
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for start in range(0, len(low), 512):
        values = low[start : start + 512, None] * FACTORS + SHIFTS
        values ^= values >> np.uint32(15)
        np.minimum(best, (values * np.uint32(0x2C1B3C6D)).min(axis=0), out=best)
    return best


def signature(best: np.ndarray) -> np.ndarray:
    """The lowest bits of all minima, PER_LONG of them in a long."""
    low = (best & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, PER_LONG)
    return (low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sizes, digests, packed, bands = [], [], [], []
        for text in part.column(1).to_pylist():
            found = shingle_set(text)
            sizes.append(len(found))
            if len(found):
                best = minima(found)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                packed.append(signature(best))
                bands.append(band_keys(best))
            else:
                digests.append(None)
                packed.append(None)
                bands.append(None)
        longs = pa.list_(pa.int64())
        columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, longs), pa.array(bands, longs)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bits", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bits, bands) of every document."""
    schema = "doc_id bigint, n_shingles bigint, digest binary, bits array<bigint>, bands array<bigint>"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), _sketched, schema)


def estimate(left: str, right: str) -> Column:
    """Similarity by bit counts of two packed signatures, corrected for low bits that agree by chance."""
    ones = F.lit(int("1" * PER_LONG, 16) if BITS == 4 else sum(1 << (BITS * i) for i in range(PER_LONG)))
    unequal = None
    for i in range(HASHES // PER_LONG):
        x = F.col(left)[i].bitwiseXOR(F.col(right)[i])
        folded = x
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        count = F.bit_count(folded.bitwiseAND(ones))
        unequal = count if unequal is None else unequal + count
    return (1 - unequal / F.lit(float(HASHES)) - F.lit(CHANCE)) / F.lit(1 - CHANCE)


def similar(common: np.ndarray | int, size_a: np.ndarray | int, size_b: np.ndarray | int):
    return SHARE[1] * common >= SHARE[0] * (size_a + size_b - common)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        packed = [shingle_set(t).tobytes() for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["node", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "set_b"):
        found_a, found_b = [], []
        for a, b, packed_a, packed_b in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
            set_a, set_b = np.frombuffer(packed_a, np.uint64), np.frombuffer(packed_b, np.uint64)
            if similar(len(np.intersect1d(set_a, set_b, assume_unique=True)), len(set_a), len(set_b)):
                found_a.append(a)
                found_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold on full sets (node, shingles)."""
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    joined = joined.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    return map_batches(joined.select("a", "b", "set_a", "set_b"), _confirmed, "a bigint, b bigint")


def _links_across(rest: pa.Table, others: pa.Table) -> pa.Table:
    """Links between two blocks that join different labels: as many as join what these blocks can join."""
    out: tuple[list[int], list[int]] = ([], [])
    joined: dict[int, int] = {}

    def root(label: int) -> int:
        while (to := joined.get(label, label)) != label:
            joined[label] = label = joined.get(to, to)
        return label

    if rest.num_rows and others.num_rows:
        sets = [np.frombuffer(x, np.uint64) for x in others.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, holder = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
        nodes, labels = others.column("node").to_numpy(), others.column("label").to_numpy()
        for node, label, packed in zip(*[rest.column(c).to_pylist() for c in ("node", "label", "shingles")], strict=True):
            own = np.frombuffer(packed, np.uint64)
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            count = high - low
            at = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            common = np.bincount(holder[at], minlength=len(sets))
            linked = np.flatnonzero(similar(common, len(own), sizes) & (labels != label))
            _, first = np.unique(labels[linked], return_index=True)
            for i in linked[first].tolist():
                mine, other = root(label), root(int(labels[i]))
                if mine != other:
                    joined[mine] = other
                    out[0].append(node)
                    out[1].append(int(nodes[i]))
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def across_components(mixed_up: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join components inside of buckets: (a, b).

    ``mixed_up`` (node, label, centre, rest) has the members of buckets with several components.
    Buckets that share members form clusters. The nodes that are outside the largest component of some bucket
    are compared with all nodes of their cluster, exactly, in pairs of blocks; only links leave a block.
    """
    # The centres of a node belong together: the node is linked to the least of them, the others to that one.
    least = mixed_up.groupBy("node").agg(F.min("centre").alias("least"))
    centres = mixed_up.join(least, "node").select(F.col("least").alias("a"), F.col("centre").alias("b"))
    reached = components(least.toDF("a", "b").union(centres).distinct())
    nodes = mixed_up.groupBy("node").agg(F.first("label").alias("label"), F.max("rest").alias("rest"))
    nodes = nodes.join(reached.select("node", F.col("label").alias("cluster")), "node")
    sizes = nodes.groupBy("cluster").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.ceil(F.sum(F.col("rest").cast("int")) / BLOCK).alias("rest_blocks")
    )
    nodes = written(nodes.join(sizes, "cluster").join(sets, "node"), "clusters")
    spread = F.xxhash64("node", F.lit(1))
    rest = nodes.filter("rest").withColumn("rb", F.pmod(spread, "rest_blocks")).withColumn("ob", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    others = nodes.withColumn("ob", F.pmod(spread, "blocks")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rest_blocks") - 1)))
    columns, key = ["cluster", "rb", "ob", "node", "label", "shingles"], ["cluster", "rb", "ob"]
    ship_package(nodes.sparkSession)
    # Columns of one table on both sides get names of their own: a cogroup does not tell them apart.
    others = others.select(*[F.col(c).alias(c) for c in columns])
    pairs = rest.select(columns).groupBy(*key).cogroup(others.groupBy(*key))
    return pairs.applyInArrow(_links_across, "a bigint, b bigint")


def links(sketch: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, label): components of the classes of equal sets; ``sketch`` must be a written table."""
    classes = sketch.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    nodes = written(
        sketch.join(classes, ["digest", "doc_id"]).dropDuplicates(["digest"]).select(F.col("doc_id").alias("node"), "n_shingles", "bits", "bands"),
        "classes",
    )
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # Another order of nodes in each band: the centre is the smallest node after flipping some bits.
    flip = F.xxhash64("band").bitwiseAND(F.lit(2**62 - 1))
    buckets = (
        keys.groupBy("band", "key").agg(F.min(F.col("node").bitwiseXOR(flip)).alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    members = written(
        keys.join(buckets.select("band", "key", F.col("_least").bitwiseXOR(flip).alias("centre")), ["band", "key"]), "buckets"
    )
    # The full sets of all that have a candidate: texts are moved once.
    needed = members.select("node").distinct()
    texts = docs.join(needed.hint("shuffle_hash"), F.col("doc_id") == F.col("node")).select("node", "text").dropDuplicates(["node"])
    sets = written(map_batches(texts, _sets, "node bigint, shingles binary"), "sets")
    bits = nodes.select("node", "bits", "n_shingles")
    # Of a node's centres those with most bands in common are estimated; what they miss is found below.
    shared = members.filter("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("bands"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("bands"), "centre"))
    stars = shared.withColumn("place", place).filter(F.col("place") <= ESTIMATED)
    stars = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    scored = (
        stars.join(bits.toDF("a", "bits_a", "n_a"), "a")
        .join(bits.toDF("b", "bits_b", "n_b"), "b")
        .filter(SHARE[1] * F.least("n_a", "n_b") >= SHARE[0] * F.greatest("n_a", "n_b"))
        .select("a", "b", estimate("bits_a", "bits_b").alias("score"))
        .filter(F.col("score") >= 0.75 - SLACK)
    )
    scored = written(scored, "stars")
    # The best pair of every node by the estimate joins most of what belongs together.
    ends = scored.select(F.col("a").alias("node"), "a", "b", "score").union(scored.select(F.col("b").alias("node"), "a", "b", "score"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), "score").alias("_p")).select("_p.a", "_p.b").distinct()
    found = written(confirm(best, sets), "found")
    labels = components(found)
    # Buckets with several components: members outside the largest one against all others.
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tally = labelled.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = tally.groupBy("band", "key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("parts"))
    several = labelled.join(largest.filter("parts > 1"), ["band", "key"])
    mixed_up = written(several.select("node", "label", "centre", (F.col("label") != F.col("most")).alias("rest")), "mixed")
    return components(found.union(across_components(mixed_up, sets)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    sketch = written(sketches(docs), "sketches")
    labels = links(sketch, docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    narrow = sketch.select("doc_id", "n_shingles", "digest")
    classes = narrow.filter("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"))
    named = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component"))
    alone = F.col("doc_id").isNull() | F.col("component").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return narrow.join(named, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns: one of each component.

    Rows that repeat a kept ``doc_id`` with the same text are all kept.
    """
    dropped = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
