"""Byte-level BPE encoding and decoding with a public rank file.

Text is cut by a pattern; every piece is encoded on its own. Pieces of similar length form padded
matrices of token ids. In each round every row looks up the ranks of its neighbouring pairs in a hash
table and merges its leftmost pair of minimum rank; rows without a mergeable pair are taken out, and
the others are compacted. Words repeat, so each distinct piece of a slice is encoded once, and a
bounded number of pieces is remembered between slices.

Defined results: NULL and empty text give no tokens and empty bytes. Rows are independent, so
repeated rows give repeated results. Other columns are kept; the new ones replace columns of the
same name. A piece of any length is encoded whole: pieces above ``LONGEST`` bytes, which would need a
round for each merge of one row, merge the same pairs in the same order from a heap.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from rowrelay.llm.common import mixed, ship_package, slices

NONE = np.int32(2**31 - 1)
LONGEST = 512
REMEMBERED = 150_000
SLICE = 1 << 20  # bytes of text whose pieces are held at once
ROWS = 8_192  # rows of one matrix


class PairTable:
    """Pair of token ids -> id of the joined token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (ranks[a] << 32 | ranks[b], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := token[:i]) in ranks and (b := token[i:]) in ranks
        ]
        keys = np.array([p[0] for p in pairs], np.uint64)
        values = np.array([p[1] for p in pairs], np.int32)
        self.mask = (1 << max(10, (4 * len(pairs)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, 2**64 - 1, np.uint64)
        self.values = np.full(self.mask + 1, NONE, np.int32)
        self.probes = 0
        while len(keys):  # every round places one key in each free slot that is asked for
            slots = self._slots(keys, self.probes)
            free = self.keys[slots] == np.uint64(2**64 - 1)
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values = keys[~placed], values[~placed]
            self.probes += 1

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((mixed(keys) + np.uint64(probe)) & np.uint64(self.mask)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every joined pair, NONE where the pair does not merge (ids below 0 are padding)."""
        keys = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        out = np.full(keys.shape, NONE, np.int32)
        flat, result = keys.ravel(), out.ravel()
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        for probe in range(self.probes):
            if not len(todo):
                break
            slots = self._slots(flat[todo], probe)
            found = self.keys[slots] == flat[todo]
            result[todo[found]] = self.values[slots[found]]
            todo = todo[~found & (self.keys[slots] != np.uint64(2**64 - 1))]
        return out


class Encoder:
    """Pieces (bytes) to little-endian unsigned 32-bit token ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONGEST:
                out[i] = self._merge_long(piece)
            else:
                widths.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in widths.items():
            step = max(64, ROWS * 16 // width)
            for start in range(0, len(rows), step):
                self._merge_rows(pieces, rows[start : start + step], width, out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        lengths = np.array([len(pieces[i]) for i in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        flat = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)
        ids[np.arange(width) < lengths[:, None]] = self.bytes[flat]
        places = np.array(rows)
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(places):
            at = ranks.argmin(axis=1)  # the first of equal minima is the leftmost
            line = np.arange(len(places))
            best = ranks[line, at]
            done = best == NONE
            if done.any():
                raw, size = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (place, length) in enumerate(zip(places[done].tolist(), lengths[done].tolist(), strict=True)):
                    out[place] = raw[k * size : k * size + 4 * length]
                live = ~done
                ids, ranks, places, lengths, at, best = ids[live], ranks[live], places[live], lengths[live], at[live], best[live]
                if not len(places):
                    return
                line = np.arange(len(places))
            # The merged id takes the pair's place; what stands to the right moves one to the left.
            width = ids.shape[1]
            columns = np.arange(width)
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > at[:, None]), width - 1), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), width - 2), axis=1)
            ids[:, -1], ranks[:, -1], ids[line, at] = -1, NONE, best
            lengths = lengths - 1
            for left in (at - 1, at):
                ok = np.flatnonzero((left >= 0) & (left < width - 1))
                ranks[ok, left[ok]] = self.pairs.ranks(ids[ok, left[ok]], ids[ok, left[ok] + 1])
            if (longest := max(2, int(lengths.max()))) < width:
                ids, ranks = ids[:, :longest], ranks[:, : longest - 1]

    def _merge_long(self, piece: bytes) -> bytes:
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(parts):
                rank = self.ranks.get(parts[i] + parts[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j))

        for i in range(len(parts)):
            offer(i)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return np.array([self.ranks[p] for p in parts if p is not None], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; pieces seen before are not merged again."""
        cut = [self.find(t) if t else [] for t in texts]
        known = self.known
        fresh = {p for pieces in cut for p in pieces if p not in known}
        if fresh:
            order = list(fresh)
            if len(known) + len(order) > REMEMBERED:
                known.clear()
                order = list({p for pieces in cut for p in pieces})
            known.update(zip(order, self.encode_pieces([p.encode("utf-8", "replace") for p in order]), strict=True))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker and rank file."""
    return Encoder(path, pattern)


def _with_binary(df: DataFrame, source: str, targets: list[str], make) -> DataFrame:
    """Add binary columns made from ``source`` by ``make``, a function of a list of values."""
    ship_package(df.sparkSession)
    new = {t.lower() for t in targets}
    keep = [c for c in df.columns if c.lower() not in new]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{source}`").alias("value"))
    kind = packed.schema["row"].dataType.simpleString()
    names = [f"made{i}" for i in range(len(targets))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "value", SLICE):
            made = [pa.array(x, pa.binary()) for x in make(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["row", *names])

    out = packed.mapInArrow(run, ", ".join([f"row {kind}", *[f"{n} binary" for n in names]]))
    return out.select("row.*", *[F.col(n).alias(t) for n, t in zip(names, targets, strict=True)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add ``ids``: the tokens of the whole text as little-endian unsigned 32-bit integers."""
    return _with_binary(df, text, [ids], lambda texts: [encoder(path, pattern).encode(texts)])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes that the ids stand for."""
    return _with_binary(df, ids, [decoded], lambda rows: [list(map(encoder(path, pattern).decode, rows))])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` and what they decode to, in one pass of the Python workers."""

    def both(texts: list[str | None]) -> list[list[bytes]]:
        code = encoder(path, pattern)
        packed = code.encode(texts)
        return [packed, list(map(code.decode, packed))]

    return _with_binary(df, text, [ids, decoded], both)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of a round trip through both directions."""
    return round_trip(df.select("doc_id", "text"), path, pattern).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
