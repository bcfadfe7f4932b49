"""What several text operators share: words, Arrow mapping, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rowrelay.session import drop_dir, shared_dir, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

# Rows are handed to numpy in slices of about this many text bytes, whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII white space; none for NULL text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


# Shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    schema, before = df.schema, spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    table = spark.read.schema(schema).parquet(path)
    table._folder = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has made, once nothing reads them any more."""
    for table in tables:
        drop_dir(table.sparkSession, table._folder)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has about ``most`` bytes of ``text``; a longer text is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if stop > start:
                yield batch.slice(start, stop - start)


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered up to a bounded number of words."""

    MOST = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i, factor in enumerate(odd_numbers(size, seed)):
        total += hashes[i : i + n] * factor
    return mixed(total)
