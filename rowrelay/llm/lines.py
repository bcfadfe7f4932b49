"""Line dedup: repeated multi-line chunks with content-defined boundaries. DataFrame functions only.

Each line has a hash; a rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is
divisible by ``DIVISOR``. A boundary depends on the lines just before it only, so text that is
inserted or removed elsewhere does not move it. A chunk of two lines or more that occurs again, in
any document, keeps its first occurrence by (doc_id, place in the document); later ones are removed
after their bytes have been compared with the first one's. Single lines always stay.

Only keys travel to find repeats: (doc_id, place, digest), with a hot chunk reduced before the shuffle.
The texts are dealt by doc_id once for both uses: taking out the bytes of repeated chunks, and
cutting the confirmed ones.

Defined results: NULL text stays NULL and has no lines; empty text is one empty line; a document
that loses everything becomes empty text, not a missing row. Rows without ``doc_id`` are left as they
are and count as no occurrence. Rows that share a ``doc_id`` are one document: their chunks of equal
place and bytes are one occurrence. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 3
FACTOR = 31
PRIME = 1_000_003
DIVISOR = 4
LEAST_LINES = 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint")


def ends_chunk(value: Column, i: Column) -> Column:
    """The number of the line (from 1) where a chunk ends, else NULL; the line hashes are in _hashes."""
    rolling = value
    for back in range(1, WINDOW):
        rolling = rolling + F.lit(FACTOR**back) * F.coalesce(F.get("_hashes", i - back), F.lit(0))
    return F.when((i == F.size("_hashes") - 1) | (rolling % PRIME % DIVISOR == 0), i + 1)


def with_chunks(df: DataFrame) -> DataFrame:
    """Add _lines and _chunks, an array of (place, first, n), for the column _text."""
    hashed = df.withColumn("_lines", lines_of(F.col("_text"))).withColumn("_hashes", F.transform("_lines", line_hash))
    ended = hashed.withColumn("_ends", F.filter(F.transform("_hashes", ends_chunk), lambda end: end.isNotNull())).drop("_hashes")

    def chunk(end: Column, i: Column) -> Column:
        before = F.coalesce(F.get("_ends", i - 1), F.lit(0))
        return F.struct(i.alias("place"), (before + 1).alias("first"), (end - before).alias("n"))

    return ended.withColumn("_chunks", F.transform("_ends", chunk)).drop("_ends")


def chunk_text(chunk: Column) -> Column:
    return F.array_join(F.slice("_lines", chunk["first"], chunk["n"]), "\n")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(_id, _repeats): for each document the places of chunks whose digest occurs more than once.

    A repeat is (place, digest, first), ``first`` true for the occurrence that stays.
    """
    keyed = with_chunks(docs.filter("_id IS NOT NULL").select("_id", "_text")).select(
        "_id",
        F.explode(
            F.transform(
                F.filter("_chunks", lambda c: c["n"] >= LEAST_LINES),
                lambda c: F.struct(c["place"].alias("place"), F.unhex(F.md5(chunk_text(c).cast("binary"))).alias("digest")),
            )
        ).alias("c"),
    ).select("_id", "c.place", "c.digest")
    first = keyed.groupBy("digest").agg(F.min(F.struct("_id", "place")).alias("first"), F.max(F.struct("_id", "place")).alias("last"))
    first = first.filter("first < last").select("digest", "first")
    marked = keyed.join(first, "digest").select(
        "_id", F.struct("place", "digest", (F.struct("_id", "place") == F.col("first")).alias("first")).alias("_r")
    )
    return marked.groupBy("_id").agg(F.collect_set("_r").alias("_repeats"))


def confirmed_chunks(located: DataFrame) -> DataFrame:
    """(_id, _cut): places of each document whose bytes equal the first occurrence's."""
    found = with_chunks(located.filter("_repeats IS NOT NULL")).select("_id", "_lines", "_chunks", F.explode("_repeats").alias("r"))
    found = found.select("_id", "r.place", "r.digest", "r.first", chunk_text(F.get("_chunks", F.col("r.place"))).alias("bytes"))
    first = found.filter("first").select("digest", F.col("bytes").alias("first_bytes")).distinct()
    later = found.filter("NOT first").join(first, "digest").filter("bytes = first_bytes")
    return later.groupBy("_id").agg(F.collect_set("place").alias("_cut"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as the struct ``row``, with the kept ``text``, ``n_lines`` and ``n_removed`` of every row."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    # Dealt by id once; Spark reuses this exchange below.
    dealt = packed.repartition("_id")
    located = dealt.join(repeated_chunks(packed).hint("shuffle_hash"), "_id", "left")
    cut = with_chunks(dealt.join(confirmed_chunks(located).hint("shuffle_hash"), "_id", "left"))
    stays = F.filter("_chunks", lambda c: ~F.array_contains("_cut", c["place"]))
    kept = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stays, chunk_text), "\n"))
    lost = F.aggregate(F.filter("_chunks", lambda c: F.array_contains("_cut", c["place"])), F.lit(0), lambda a, c: a + c["n"])
    return cut.select(
        "row",
        kept.alias("text"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("_cut").isNull(), 0).otherwise(lost).cast("bigint").alias("n_removed"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with later repeats of chunks taken out of their text."""
    done = without_repeats(docs)
    return done.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document."""
    return without_repeats(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


SQL = f"""
WITH line AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM line),
ended AS (
    SELECT *, (h + {FACTOR} * lag(h, 1, 0) OVER w + {FACTOR**2} * lag(h, 2, 0) OVER w) % {PRIME} % {DIVISOR} = 0 AS ends
    FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (
    SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM ended),
chunk AS (SELECT doc_id, place, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes FROM placed GROUP BY doc_id, place),
judged AS (
    SELECT *, n >= {LEAST_LINES} AND row_number() OVER (PARTITION BY bytes, n >= {LEAST_LINES} ORDER BY doc_id, place) > 1 AS gone
    FROM chunk)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(bytes, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id
GROUP BY d.doc_id"""
