"""Phrase collocations: phrases of 2 to 4 words that stick together, in each language.

Each word occurrence leads one window: itself and the next three words of its piece, padded with empty
words. Only these longest windows are counted; Spark's ROLLUP over (lang, w1, w2, w3, w4) sums them to the
counts of all shorter prefixes, down to the number of words of a language. A phrase of k words is a prefix of
exactly the windows that its occurrences lead, so nothing is counted twice.

Windows go to Spark as far as their prefixes are frequent only; what is cut off is padding, and no loss:

1. Equal texts of a batch become one with a number, and go to slices of about ``SLICE_BYTES`` by their hash;
   Spark deals them once and reuses that exchange.
2. A slice sends the hashes of the prefixes of its windows, with counts (up to ``LEAST``, more is not
   needed), packed by range of hashes. Back come those that reach ``LEAST`` over all slices.
3. A window ends before the first word whose prefix did not come back. Hashes that collide keep a
   window longer, never shorter.

A slice sends each prefix and window once, however often it stands there, so very frequent ones are
small everywhere. Counts, cuts and scores are exact (the product of a score has 38 digits).

Defined results: NULL text is empty, NULL lang is ``und``; rows without words give nothing; repeated rows count
each. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowrelay.llm.common import LOWER, UPPER, slices, window_hashes, written
from rowrelay.llm.substrings import code_of, member
from rowrelay.session import ship_package

ORDER = 4  # words of the longest phrases
LEAST = 30  # occurrences of a candidate
SHARE = (80, 100)  # a candidate goes when a longer one around it has 100 * f >= 80 * a
SCALE = 2_000_000
KEPT = 2_000  # phrases of a language in the report
SLICE_BYTES = 8 << 20

MARK = b"\xff"  # ends a piece; no byte of UTF-8 text
CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(UPPER.encode() + CUTS, LOWER.encode() + MARK * len(CUTS))

DEALT = "slice bigint, lang string, text binary, n bigint"
KEYS = pa.schema([("slice", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
KEYS_DDL = "slice bigint, range bigint, keys binary, counts binary"
WORDS = [f"w{i + 1}" for i in range(ORDER)]
WINDOWS = pa.schema([("lang", pa.string()), *[(w, pa.string()) for w in WORDS], ("n", pa.int64())])
WINDOWS_DDL = ", ".join(["lang string", *[f"{w} string" for w in WORDS], "n bigint"])


def _combined(n_slices: int):
    """Equal texts of a batch become one row with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            seen = Counter(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            number = [xxhash.xxh64_intdigest(text, seed=len(lang)) % n_slices for lang, text in seen]
            columns = [number, [lang for lang, _ in seen], [text for _, text in seen], list(seen.values())]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["slice", "lang", "text", "n"])

    return run


class Tokens:
    """The words of the texts of one language: codes (0 ends a piece), weights, and the words of the codes."""

    def __init__(self, lang: str, texts: list[bytes], numbers: list[int]):
        tokens: list[bytes] = []
        lengths = []
        for text in texts:
            own = text.translate(TABLE).replace(MARK, b" \xff ").split()
            own.append(MARK)
            tokens += own
            lengths.append(len(own))
        numbered: dict[bytes, int] = {MARK: 0}
        self.codes = np.fromiter((numbered.setdefault(w, len(numbered)) for w in tokens), np.int64, len(tokens))
        self.weights = np.repeat(np.array(numbers, np.int64), lengths)
        self.words = list(numbered)
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in self.words), np.uint64, len(self.words))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``size`` words begin that lie in one piece, and their hashes."""
        whole = np.ones(max(0, len(self.codes) - size + 1), bool)
        for i in range(size):
            whole &= self.codes[i : i + len(whole)] > 0
        start = np.flatnonzero(whole)
        return start, window_hashes(self.hashes[self.codes], size, seed=size)[start]


def by_lang(docs: pa.Table) -> Iterator[tuple[str, Tokens]]:
    groups: dict[str, tuple[list[bytes], list[int]]] = {}
    for lang, text, n in zip(*[docs.column(c).to_pylist() for c in ("lang", "text", "n")], strict=True):
        texts, numbers = groups.setdefault(lang, ([], []))
        texts.append(text)
        numbers.append(n)
    for lang, (texts, numbers) in sorted(groups.items()):
        yield lang, Tokens(lang, texts, numbers)


def totals(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(weights[order], starts)


def send_keys(ranges: int):
    """The prefixes of a slice's windows, packed by range of hashes."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        parts = []
        for _, t in by_lang(docs):
            for size in range(1, ORDER + 1):
                start, hashes = t.prefixes(size)
                parts.append(totals(hashes, t.weights[start]))
        codes = code_of(np.concatenate([np.empty(0, np.uint64), *[k for k, _ in parts]]), ranges)
        codes, counts = totals(codes, np.concatenate([np.empty(0, np.int64), *[n for _, n in parts]]))
        counts = np.minimum(counts, LEAST).astype(np.uint8)
        number = (codes >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        bounds = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(number)], strict=True)) if len(cuts) else []
        low = codes.astype("<u4")
        columns = [[key[0].as_py()] * len(cuts), number[cuts].tolist(), [low[a:b].tobytes() for a, b in bounds], [counts[a:b].tobytes() for a, b in bounds]]
        return pa.table(columns, schema=KEYS)

    return run


def meet_keys(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a range: for each slice those of its keys that are frequent over all slices."""
    parts = [np.frombuffer(x, "<u4") for x in rows.column("keys").to_pylist()]
    everything = np.concatenate(parts)
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).astype(np.int64)
    distinct, sums = totals(everything, counts)
    often = member(everything.astype(np.uint64), distinct[sums >= LEAST].astype(np.uint64))
    out, start = [], 0
    for part in parts:
        out.append(part[often[start : start + len(part)]].tobytes())
        start += len(part)
    filled = [i for i, x in enumerate(out) if x]
    numbers = rows.column("slice").to_numpy()
    return pa.table([numbers[filled].tolist(), [key[0].as_py()] * len(filled), [out[i] for i in filled], [b""] * len(filled)], schema=KEYS)


def send_windows(ranges: int):
    """The padded windows of a slice with their numbers, as far as their prefixes are frequent."""

    def run(key: tuple, docs: pa.Table, frequent: pa.Table) -> pa.Table:
        pairs = zip(frequent.column("range").to_pylist(), frequent.column("keys").to_pylist(), strict=True)
        known = [np.frombuffer(keys, "<u4").astype(np.uint64) | np.uint64(number) << np.uint64(32) for number, keys in pairs]
        known = np.sort(np.concatenate([np.empty(0, np.uint64), *known]))
        return pa.concat_tables([WINDOWS.empty_table(), *[cut_windows(lang, t, known, ranges) for lang, t in by_lang(docs)]])

    return run


def cut_windows(lang: str, t: Tokens, known: np.ndarray, ranges: int) -> pa.Table:
    lead, _ = t.prefixes(1)
    goes_on, columns = np.ones(len(t.codes), bool), []
    padded = np.append(t.codes, np.zeros(ORDER, np.int64))
    for size in range(1, ORDER + 1):
        start, hashes = t.prefixes(size)
        often = np.zeros(len(t.codes), bool)
        often[start[member(code_of(hashes, ranges), known)]] = True
        goes_on &= often
        columns.append(np.where(goes_on, padded[size - 1 : size - 1 + len(t.codes)], 0))
    # Code 0 ends a piece and is the padding now. Windows as pairs of pairs: every step keeps the numbers below 64 bits.
    columns, n_words = [c[lead] for c in columns], len(t.words)
    first, first_of = np.unique(columns[0] * n_words + columns[1], return_inverse=True)
    last, last_of = np.unique(columns[2] * n_words + columns[3], return_inverse=True)
    window, n = totals(first_of * max(1, len(last)) + last_of, t.weights[lead])
    a, b = first[window // max(1, len(last))], last[window % max(1, len(last))]
    made = [a // n_words, a % n_words, b // n_words, b % n_words]
    used, at = np.unique(np.concatenate(made), return_inverse=True)
    names = pa.array([t.words[i].decode("utf-8", "replace") if i else "" for i in used.tolist()], pa.string())
    return pa.table([pa.array([lang] * len(n), pa.string()), *[names.take(pa.array(c)) for c in np.split(at, ORDER)], pa.array(n, pa.int64())], schema=WINDOWS)


def windows(docs: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, w4, n): padded longest windows with their numbers, several rows of each."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    docs = docs.filter(F.octet_length("text") > 0)
    n_slices = max(1, math.ceil((docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) / SLICE_BYTES))
    dealt = docs.mapInArrow(_combined(n_slices), DEALT).repartition(n_slices, "slice")
    keys = dealt.groupBy("slice").applyInArrow(send_keys(n_slices), KEYS_DDL)
    frequent = keys.groupBy("range").applyInArrow(meet_keys, KEYS_DDL)
    return dealt.groupBy("slice").cogroup(frequent.groupBy("slice")).applyInArrow(send_windows(n_slices), WINDOWS_DDL)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, size, phrase, f): frequent phrases up to ``ORDER`` words; size 0 has the number of all words."""
    level = F.grouping_id()
    # The rows of slices are summed first: ROLLUP writes every window once for each level.
    whole = windows(docs).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    summed = whole.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), level.alias("_level"))
    # The bits of the level are the columns that are summed over, the last column lowest.
    size = F.lit(ORDER) - F.bit_count("_level").cast("int")
    last = F.element_at(F.array(*WORDS), F.greatest(size, F.lit(1)))
    found = summed.withColumn("size", size).filter((F.col("size") == 0) | ((F.col("size") > 0) & (F.col("f") >= LEAST) & (last != "")))
    return found.select("lang", "size", F.concat_ws(" ", *WORDS).alias("phrase"), "f")


def part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``kept`` phrases."""
    counted = written(counts(docs), "phrases")
    candidates = counted.filter("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    parts = counted.filter(f"size BETWEEN 1 AND {ORDER - 1}")
    k, words = F.col("k"), F.col("words")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", part(words, F.lit(1), k).alias("first"), part(words, k + 1, F.col("size") - k).alias("rest"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) DIV CAST(l + r AS DECIMAL(20, 0))")
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst"))
    # Parts of longer candidates, with the most frequent one around them.
    around = candidates.filter("size >= 3").select("lang", "words", "size", "a").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    around = around.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    around = around.groupBy("lang", part(words, F.col("first"), F.col("n")).alias("phrase")).agg(F.max("a").alias("around"))
    alone = worst.join(around, ["lang", "phrase"], "left").filter(F.coalesce(F.col("around") * SHARE[1] < F.col("a") * SHARE[0], F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score").withColumn("rank", F.row_number().over(order).cast("bigint"))
    everything = counted.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.filter(F.col("rank") <= kept).join(everything, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
word AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM piece),
gram AS (
    SELECT lang, size, array_to_string(ws[p : p + size - 1], ' ') AS phrase, count(*) AS f
    FROM word, unnest(range(1, {ORDER + 1})) AS s(size), unnest(range(1, len(ws) - size + 2)) AS r(p)
    GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM gram WHERE size = 1 GROUP BY lang),
candidate AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM gram WHERE size > 1 AND f >= {LEAST}),
cut AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a // (x.f + y.f))::BIGINT AS score
    FROM candidate c, unnest(range(1, size)) AS u(k)
    JOIN gram x ON x.lang = c.lang AND x.phrase = array_to_string(ws[:k], ' ')
    JOIN gram y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
    SELECT lang, array_to_string(ws[i : i + n - 1], ' ') AS phrase, max(a) AS most
    FROM candidate, unnest(range(2, size)) AS s(n), unnest(range(1, size - n + 2)) AS r(i) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst JOIN total USING (lang) LEFT JOIN around USING (lang, phrase)
WHERE most IS NULL OR {SHARE[1]} * most < {SHARE[0]} * a
QUALIFY rank <= {KEPT}"""
