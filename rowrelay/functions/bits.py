"""Sets of small integers as BIGINT words, built by ``bit_or``.

A set of required cells is tested with a fixed-size aggregation state: partial
aggregation shrinks every duplicate before the shuffle and the final test is a
comparison of longs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

WORD_BITS = 62


def position_in(value: Column, names: list[str]) -> Column:
    """0-based place of ``value`` in ``names``, NULL when absent."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(place > 0, place - 1)


def collect_bits(position: Column, n_bits: int, prefix: str) -> list[Column]:
    """Aggregates holding the set of all ``position`` values below ``n_bits``."""
    one = F.lit(1).cast("bigint")
    words = []
    for number, low in enumerate(range(0, n_bits, WORD_BITS)):
        inside = (position >= low) & (position < low + WORD_BITS)
        bit = F.call_function("shiftleft", one, (position - low).cast("int"))
        words.append(F.coalesce(F.bit_or(F.when(inside, bit)), F.lit(0)).alias(f"{prefix}{number}"))
    return words


def has_all(n_bits: int, prefix: str, positions: list[int] | None = None) -> Column:
    """True when every one of ``positions`` (all ``n_bits`` by default) is in the set."""
    wanted = range(n_bits) if positions is None else positions
    masks: dict[int, int] = {}
    for p in wanted:
        masks[p // WORD_BITS] = masks.get(p // WORD_BITS, 0) | 1 << p % WORD_BITS
    tests = [F.col(f"{prefix}{w}").bitwiseAND(F.lit(m).cast("bigint")) == F.lit(m) for w, m in masks.items()]
    return reduce(lambda a, b: a & b, tests)
