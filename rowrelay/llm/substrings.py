"""Substring dedup: suffix automata of reference shards give the spans that earlier documents have, too.

A word goes when it lies in ``LEAST`` consecutive words that also start in a document with a smaller
``doc_id``, judged on the input. The reference of a document is thus every earlier document. An automaton of
all of it has no bound and would be larger than the corpus, so the reference is first reduced, without loss,
to the passages that occur in several documents, and these are cut into shards:

1. Documents are dealt once into slices by a hash of ``doc_id``; every later step works on slices, and
   Spark reuses that exchange.
2. Each window of 13 words chooses a seed, the least hash among its 5-word runs. Equal windows choose
   equal seeds. A slice sends its seeds as packed 32-bit values by range of hashes; back come those that
   occur in more than one document.
3. Windows with such a seed send their 64-bit hash and smallest document; back come the owner, which is the
   smallest document of all, and the number of documents, for those in more than one.
4. Owners send the passages of their windows, other documents the runs of words that they seem to
   share, both to the shard of the owner. The shard builds a suffix automaton of its passages, each state with the
   smallest owner, and streams the runs for matching statistics. What is matched word by word over 13
   words or more by a smaller owner is removed; hashes only route.
5. The spans return to their slices and are cut.

Hot passages stay small: seeds, windows and runs are combined in each slice before they are sent, and the
runs of a passage with very many documents are spread over salts, with the passage sent to each (one for
every ``PER_SALT`` documents). No step holds more than a slice, a range or a shard.

Defined results: NULL and empty texts have no words; a NULL ``doc_id`` is neither smaller nor larger than
another: such rows keep all words and own nothing. Rows that share a ``doc_id`` are one document and do not
remove each other's words. Text with fewer than 13 words stays whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowrelay.llm.automata import SuffixAutomaton
from rowrelay.llm.common import WordHashes, window_hashes
from rowrelay.session import ship_package

LEAST = 13
SEED = 5
PER_SALT = 4_096
SLICES, SHARDS = 4, 16  # for each shuffle partition
WORDS = WordHashes()
U32, U64 = np.uint64(32), np.uint64


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes: cut at ASCII white space only


@dataclass
class SliceWords:
    """The words of a slice's documents one after another, as far as they can have windows.

    ``valid`` tells which of the windows (numbered by their first word) lie in one document, ``doc``
    the document of each word.
    """

    ids: np.ndarray
    texts: list[bytes]
    words: list[bytes]
    first: np.ndarray
    hashes: np.ndarray
    valid: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, docs: pa.Table) -> SliceWords:
        ids, texts, words, stops = [], [], [], []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            own = split_words(text) if doc_id is not None else []
            if len(own) >= LEAST:
                ids.append(doc_id)
                texts.append(text)
                words += own
                stops.append(len(words))
        ends = np.array(stops, np.int64)
        valid = np.ones(max(0, len(words) - LEAST + 1), bool)
        over = (ends[:, None] + np.arange(1 - LEAST, 0)).ravel()
        valid[over[over < len(valid)]] = False
        first = np.append(0, ends[:-1]) if len(ends) else ends
        doc = np.repeat(np.arange(len(ends)), ends - first)
        return cls(np.array(ids, np.int64), texts, words, first, WORDS.of(words), valid, doc)

    def seeds(self) -> np.ndarray:
        """The least hash among the 5-word runs of every window."""
        runs = window_hashes(self.hashes, SEED)
        if not len(runs):
            return runs
        least, width = runs, 1
        while 2 * width <= LEAST - SEED + 1:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        rest = LEAST - SEED + 1 - width
        return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least

    def windows(self) -> np.ndarray:
        return window_hashes(self.hashes, LEAST, seed=2)


def code_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range number above, 32 bits of the hash below."""
    return (hashes >> U32) % U64(ranges) << U32 | hashes & U64(0xFFFFFFFF)


def packed_by_range(number: np.ndarray, columns: dict[str, np.ndarray], slice_no: int, schema: pa.Schema) -> pa.Table:
    """One row for each range number in ``number`` (sorted), with the bytes of its part of each column."""
    if not len(number):
        return schema.empty_table()
    cuts = np.flatnonzero(np.diff(number, prepend=-1))
    stops = np.append(cuts[1:], len(number))
    data = {"slice": np.full(len(cuts), slice_no, np.int64), "range": number[cuts]}
    data |= {k: [v[a:b].tobytes() for a, b in zip(cuts, stops, strict=True)] for k, v in columns.items()}
    return pa.table(data, schema=schema)


def rows_of(table: pa.Table, *columns: str):
    return zip(*[table.column(c).to_pylist() for c in columns], strict=True)


SEEDS = pa.schema([("slice", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])
WINDOWS = pa.schema([("slice", pa.int64()), ("range", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])
TEXTS = pa.schema(
    [("shard", pa.int64()), ("salt", pa.int64()), ("passage", pa.bool_()), ("slice", pa.int64()), ("owner", pa.int64()), ("words", pa.binary()), ("docs", pa.binary())]
)
SPANS = pa.schema([("slice", pa.int64()), ("doc", pa.int64()), ("print", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
DDL = {pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def send_seeds(ranges: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        part = SliceWords.of(docs)
        seeds, doc = part.seeds()[part.valid], part.doc[: len(part.valid)][part.valid]
        # Neighbouring windows mostly have one seed in common.
        new = np.flatnonzero((np.diff(seeds) != 0) | (np.diff(doc) != 0)) + 1 if len(seeds) else np.empty(0, np.int64)
        new = np.append(0, new) if len(seeds) else new
        codes, _, counts = least_owner(code_of(seeds[new], ranges), doc[new], None)
        columns = {"keys": codes.astype("<u4"), "many": (counts > 1).astype(np.uint8)}
        return packed_by_range((codes >> U32).astype(np.int64), columns, key[0].as_py(), SEEDS)

    return run


def meet_seeds(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a range: for each slice its seeds that some other document has, too."""
    slices = rows.column("slice").to_numpy()
    parts = [np.frombuffer(x, "<u4") for x in rows.column("keys").to_pylist()]
    many = np.frombuffer(b"".join(rows.column("many").to_pylist()), np.uint8).astype(bool)
    _, group, sizes = np.unique(np.concatenate([*parts, np.empty(0, "<u4")]), return_inverse=True, return_counts=True)
    again = (sizes > 1) | (np.bincount(group, many, len(sizes)) > 0)
    flags, out, start = again[group], [], 0
    for keys in parts:
        out.append(keys[flags[start : start + len(keys)]].tobytes())
        start += len(keys)
    filled = [i for i, x in enumerate(out) if x]
    columns = [pa.array(slices[filled]), pa.array([key[0].as_py()] * len(filled), pa.int64()), pa.array([out[i] for i in filled], pa.binary()), pa.array([b""] * len(filled), pa.binary())]
    return pa.Table.from_arrays(columns, schema=SEEDS)


def send_windows(ranges: int):
    def run(key: tuple, docs: pa.Table, seeds: pa.Table) -> pa.Table:
        known = [np.frombuffer(keys, "<u4").astype(U64) | U64(number) << U32 for number, keys in rows_of(seeds, "range", "keys")]
        if not known or not docs.num_rows:
            return WINDOWS.empty_table()
        part = SliceWords.of(docs)
        seeds = code_of(part.seeds(), ranges)
        if not len(seeds):
            return WINDOWS.empty_table()
        new = np.append(0, np.flatnonzero(np.diff(seeds)) + 1)
        known_seed = member(seeds[new], np.unique(np.concatenate(known)))
        hit = np.repeat(known_seed, np.diff(np.append(new, len(seeds)))) & part.valid
        value, owner, count = least_owner(part.windows()[hit], part.ids[part.doc[: len(hit)][hit]], None)
        number = ((value >> U32) % U64(ranges)).astype(np.int64)
        order = np.argsort(number, kind="stable")
        columns = {"hashes": value[order], "owners": owner[order], "counts": count[order].astype("<i8")}
        return packed_by_range(number[order], columns, key[0].as_py(), WINDOWS)

    return run


def member(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which of the hashes are among the sorted ones; most that are not fail a look at their low bits."""
    out = np.zeros(len(values), bool)
    if len(sorted_values):
        low = U64((1 << 20) - 1)
        bits = np.zeros(1 << 20, bool)
        bits[(sorted_values & low).astype(np.int64)] = True
        maybe = np.flatnonzero(bits[(values & low).astype(np.int64)])
        at = np.searchsorted(sorted_values, values[maybe])
        at[at == len(sorted_values)] = 0
        out[maybe] = sorted_values[at] == values[maybe]
    return out


def least_owner(hashes: np.ndarray, owners: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the smallest owner and the number of documents (pairs that repeat count once)."""
    if not len(hashes):
        return hashes, owners, np.empty(0, np.int64)
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    first = np.append(True, hashes[1:] != hashes[:-1])
    if counts is None:
        counts = (first | np.append(True, owners[1:] != owners[:-1])).astype(np.int64)
    else:
        counts = counts[order]
    starts = np.flatnonzero(first)
    return hashes[starts], owners[starts], np.add.reduceat(counts, starts)


def meet_windows(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a range: for each slice its windows in more than one document, with owner and count."""
    slices = rows.column("slice").to_numpy()
    parts = [np.frombuffer(x, U64) for x in rows.column("hashes").to_pylist()]
    owners = np.frombuffer(b"".join(rows.column("owners").to_pylist()), np.int64)
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<i8")
    everything = np.concatenate(parts)
    value, owner, count = least_owner(everything, owners, counts)
    at = np.searchsorted(value, everything)
    keep, out, start = count[at] > 1, [], 0
    for part in parts:
        chosen = start + np.flatnonzero(keep[start : start + len(part)])
        out.append([x.tobytes() for x in (everything[chosen], owner[at[chosen]], count[at[chosen]])])
        start += len(part)
    filled = [i for i, x in enumerate(out) if x[0]]
    columns = [pa.array(slices[filled]), pa.array([key[0].as_py()] * len(filled), pa.int64()), *[pa.array([out[i][j] for i in filled], pa.binary()) for j in range(3)]]
    return pa.Table.from_arrays(columns, schema=WINDOWS)


def fingerprint(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def send_texts(shards: int):
    """Passages of owners and runs of the others, for the shard of the owner and the spread of the passage."""

    def run(key: tuple, docs: pa.Table, windows: pa.Table) -> pa.Table:
        if not docs.num_rows or not windows.num_rows:
            return TEXTS.empty_table()
        slice_no = key[0].as_py()
        value, owner, count = (np.frombuffer(b"".join(windows.column(c).to_pylist()), t) for c, t in (("hashes", U64), ("owners", np.int64), ("counts", "<i8")))
        order = np.argsort(value)
        value, owner, spread = value[order], owner[order], np.ceil(np.log2(np.maximum(1, count[order] / PER_SALT))).astype(np.int64)
        passages: dict[tuple[int, int, bytes], None] = {}
        runs: dict[tuple[int, int, bytes], list[int]] = {}
        part = SliceWords.of(docs)
        hashes = part.windows()
        places = np.flatnonzero(member(hashes, value) & part.valid)
        if len(places):
            at = np.searchsorted(value, hashes[places])
            who, wide, doc = owner[at], spread[at], part.doc[places]
            # Windows of two documents never are neighbours: the last ones of a document are not valid.
            breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(who) != 0) | (np.diff(wide) != 0)) + 1
            starts, stops = np.append(0, breaks), np.append(breaks, len(places)) - 1
            marks: dict[int, int] = {}
            for d, first, last, o, w in zip(doc[starts].tolist(), places[starts].tolist(), (places[stops] + LEAST).tolist(), who[starts].tolist(), wide[starts].tolist(), strict=True):
                name = (o, w, b" ".join(part.words[first:last]))
                if o == part.ids[d]:
                    passages[name] = None
                else:
                    if d not in marks:
                        marks[d] = fingerprint(part.texts[d])
                    runs.setdefault(name, []).extend((int(part.ids[d]), marks[d], first - int(part.first[d])))
        columns: list[list] = [[] for _ in TEXTS]

        def add(name: tuple[int, int, bytes], salt: int, passage: bool, where: bytes) -> None:
            shard = xxhash.xxh64_intdigest(b"%d:%d" % name[:2]) % shards
            for column, x in zip(columns, (shard, salt, passage, slice_no, name[0], name[2], where), strict=True):
                column.append(x)

        for name in passages:
            for salt in range(1 << name[1]):
                add(name, salt, True, b"")
        for name, places in runs.items():
            add(name, slice_no % (1 << name[1]), False, np.array(places, "<i8").tobytes())
        return pa.table(columns, schema=TEXTS)

    return run


def match_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """Build the automaton of a shard's passages, stream its runs, return the spans of their documents."""
    kinds = np.array(rows.column("passage").to_pylist(), bool)
    if kinds.all() or not kinds.any():
        return SPANS.empty_table()
    automaton = SuffixAutomaton()
    for owner, words in sorted(set(rows_of(rows.filter(pa.array(kinds)), "owner", "words"))):
        automaton.add(owner, words.split(b" "))
    automaton.finish()
    out: list[list[int]] = [[] for _ in SPANS]
    for slice_no, owner, words, docs in rows_of(rows.filter(pa.array(~kinds)), "slice", "owner", "words", "docs"):
        spans = automaton.matched_spans(words.split(b" "), LEAST, owner + 1)
        for doc, mark, first in np.frombuffer(docs, "<i8").reshape(-1, 3).tolist():
            for start, stop in spans:
                for column, x in zip(out, (slice_no, doc, mark, first + start, first + stop), strict=True):
                    column.append(x)
    return pa.table(out, schema=SPANS)


def cut(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
    """The kept words of every document of a slice."""
    by_doc: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, mark, start, stop in rows_of(spans, "doc", "print", "start", "stop"):
        by_doc.setdefault((doc, mark), []).append((start, stop))
    out: list[list] = [[] for _ in RESULT]
    for doc_id, text in rows_of(docs, "doc_id", "text"):
        words = split_words(text)
        stays = np.ones(len(words), bool)
        for start, stop in by_doc.get((doc_id, fingerprint(text)), ()) if by_doc and doc_id is not None and text is not None else ():
            stays[start:stop] = False
        kept = b" ".join(words if stays.all() else [words[i] for i in np.flatnonzero(stays).tolist()])
        for column, x in zip(out, (doc_id, len(words), int(len(words) - stays.sum()), kept), strict=True):
            column.append(x)
    return pa.table(out, schema=RESULT)


def _hashed(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
    done = cut(key, docs, spans)
    digests = [hashlib.sha256(x).hexdigest().encode() for x in done.column("kept").to_pylist()]
    return done.set_column(3, "kept", pa.array(digests, pa.binary()))


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` holds the words that stay, joined by spaces, or their SHA-256."""
    spark = docs.sparkSession
    ship_package(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, slices, shards = partitions, SLICES * partitions, SHARDS * partitions
    doc_id = F.col("doc_id").cast("bigint")
    dealt = docs.select(
        F.pmod(F.xxhash64(doc_id), F.lit(slices)).alias("slice"), doc_id.alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    ).repartition(partitions, "slice")

    def by_slice(df: DataFrame, other: DataFrame):
        return df.groupBy("slice").cogroup(other.groupBy("slice"))

    seeds = dealt.groupBy("slice").applyInArrow(send_seeds(ranges), ddl(SEEDS))
    repeated = seeds.groupBy("range").applyInArrow(meet_seeds, ddl(SEEDS))
    windows = by_slice(dealt, repeated).applyInArrow(send_windows(ranges), ddl(WINDOWS))
    owned = windows.groupBy("range").applyInArrow(meet_windows, ddl(WINDOWS))
    texts = by_slice(dealt, owned).applyInArrow(send_texts(shards), ddl(TEXTS))
    spans = texts.groupBy("shard", "salt").applyInArrow(match_shard, ddl(SPANS))
    return by_slice(dealt, spans).applyInArrow(_hashed if digest else cut, ddl(RESULT))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    done = without_repeats(docs, digest=True)
    return done.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))


SQL = rf"""
WITH doc AS (
    SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
win AS (
    SELECT doc_id, p, array_to_string(words[p : p + {LEAST - 1}], ' ') AS gram
    FROM doc, unnest(range(1, greatest(1, len(words) - {LEAST - 2}))) AS r(p)),
judged AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) < doc_id AS gone FROM win),
removed AS (
    SELECT DISTINCT doc_id, i FROM judged, unnest(range(p, p + {LEAST})) AS r(i) WHERE gone),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM doc),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
    FROM word ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_words, (coalesce(len(words), 0) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)"""
