"""Token counts from flat token files by a separator scan.

A token file is a plain run of little-endian unsigned 16-bit ids: the tokens of a document, then the
end-of-document id, then the next document; there is no index and no length anywhere. ``write`` makes
such files from texts, next to where the rows are, without a shuffle. ``scan`` finds the documents
again: each file is searched block by block for the separator, by vectorised comparison; a block
yields its separators, and documents that cross blocks are stitched by a prefix scan over the blocks
of a file: the number of separators before a block, and the place of the last of them.

The files may carry the document's id: the last ``DIGITS`` ids before the separator, taken from the
ids that the vocabulary leaves free. They are not counted as tokens. Files written elsewhere have
none; then documents are known by file and number.

Defined results: NULL and empty texts have no tokens and are still one document; a NULL id is kept;
repeated rows are repeated documents; ids after the last separator of a file are one more
document, if there are any; an empty file has no documents. Spark reads a file as one value, so a
file has at most 2 GB; ``write`` makes one for each input partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowrelay.llm.bpe import encoder
from rowrelay.llm.common import map_batches, slices
from rowrelay.session import shared_dir

BLOCK = 1 << 20  # ids
DIGITS, DIGIT_BITS = 5, 13


def separator(vocabulary: int) -> bytes:
    return vocabulary.to_bytes(2, "little")


def id_digits(doc_id: int | None, vocabulary: int) -> np.ndarray:
    """A 64-bit id, or its absence, as DIGITS ids above the separator's."""
    if doc_id is None:
        return np.full(DIGITS, vocabulary + 1 + (1 << DIGIT_BITS), "<u2")
    digits = [(doc_id & (2**64 - 1)) >> (DIGIT_BITS * i) & ((1 << DIGIT_BITS) - 1) for i in range(DIGITS)]
    return np.array(digits, "<u2") + np.uint16(vocabulary + 1)


def id_of(digits: np.ndarray, vocabulary: int) -> int | None:
    values = digits.astype(np.int64) - (vocabulary + 1)
    if len(values) < DIGITS or values.min() < 0 or values.max() >= 1 << DIGIT_BITS:
        return None
    number = sum(int(v) << (DIGIT_BITS * i) for i, v in enumerate(values)) & (2**64 - 1)
    return number - 2**64 if number >= 2**63 else number


def write(docs: DataFrame, path: str, ranks: str, pattern: str, vocabulary: int) -> None:
    """Write ``docs`` (doc_id, text) as token files in the folder ``path``; the separator is the id ``vocabulary``."""
    if vocabulary + 2 + (1 << DIGIT_BITS) > 1 << 16:
        raise ValueError("the vocabulary leaves too few of the 16-bit ids free")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks, pattern)
        for part in slices(batches, "text"):
            ids = code.encode(part.column(1).to_pylist())
            rows = [
                np.frombuffer(x, "<u4").astype("<u2").tobytes() + id_digits(doc_id, vocabulary).tobytes()
                for x, doc_id in zip(ids, part.column(0).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    rows = map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "ids binary")
    # The text writer puts bytes and separator down as they are.
    end = separator(vocabulary).decode("iso-8859-1")
    rows.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", end).text(path)


def scan(spark: SparkSession, path: str, vocabulary: int, block: int = BLOCK) -> DataFrame:
    """(file, number, start, n_tokens, doc_id) of every document in the token files of a folder.

    ``number`` counts from 0 in each file, ``start`` is the place of the document's first id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer() or b"", "<u2")
                for number, at in enumerate(range(0, len(ids), block)):
                    ends = np.flatnonzero(ids[at : at + block] == vocabulary) + at
                    named = [id_of(ids[max(0, e - DIGITS) : e], vocabulary) for e in ends.tolist()]
                    marks = [bool(e >= DIGITS and ids[e - 1] > vocabulary) for e in ends.tolist()]
                    rest = at + block >= len(ids) and (not len(ends) or ends[-1] < len(ids) - 1)
                    if rest:  # what stands after the last separator of the file
                        ends, named, marks = np.append(ends, len(ids)), [*named, None], [*marks, False]
                    columns = [
                        pa.array([name]), pa.array([number], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64())),
                        pa.array([named], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.bool_())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "ends", "ids", "marks"])

    files = spark.read.format("binaryFile").load(path)  # without names that begin with _ or .
    blocks = map_batches(files.select("path", "content"), run, "file string, block bigint, ends array<bigint>, ids array<bigint>, marks array<boolean>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.select(
        "file",
        F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(earlier), F.lit(-1)).alias("last"),
        "ends",
        F.arrays_zip("ends", "ids", "marks").alias("docs"),
    )
    # A generator in the select above would be planned below the window.
    stitched = stitched.select("file", "before", "last", "ends", F.posexplode("docs").alias("i", "doc"))
    start = F.coalesce(F.get("ends", F.col("i") - 1), F.col("last")) + 1
    length = F.col("doc.ends") - start - F.when(F.col("doc.marks"), DIGITS).otherwise(0)
    return stitched.select("file", (F.col("before") + F.col("i")).alias("number"), start.alias("start"), length.alias("n_tokens"), F.col("doc.ids").alias("doc_id"))


def token_counts(docs: DataFrame, ranks: str, pattern: str, vocabulary: int) -> DataFrame:
    """(doc_id, n_tokens) of every document, by way of token files in the shared folder."""
    path = shared_dir(docs.sparkSession, "tokens")
    write(docs, path, ranks, pattern, vocabulary)
    return scan(docs.sparkSession, path, vocabulary).select("doc_id", "n_tokens")
