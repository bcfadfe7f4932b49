"""Small inputs with all odd cases at once."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that operators might use inside
    "row string, _text string, _id bigint, slice int, digest string, words string, hash int, class string, label string, "
    "made string, shard string, token_ids string, _leaked int, rejected string, score string, kept string"
)
EXTRA = 16


def sentence(rnd: random.Random, words: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(words))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and white text, one word, ties, repeated rows, copies, near copies, a long text."""
    rnd = random.Random(seed)
    base = sentence(rnd, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rnd, 30)
    lines = "\n".join(sentence(rnd, 8) for _ in range(12))
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "word"), (8, "word"),
        (9, "one two three"), (10, "One  TWO\tthree"), (11, f"{sentence(rnd, 20)} {passage} {sentence(rnd, 15)}"),
        (12, f"{sentence(rnd, 9)} {passage}"), (13, lines), (14, f"{sentence(rnd, 5)}\n{lines}\n{sentence(rnd, 4)}"),
        (15, "é ß 日本語   x\u0085y"), (16, "x" * 3000), (17, sentence(rnd, 30_000)), (18, "!!! ... 123"),
        (None, base), (None, None), (19, f"{lines}\n{lines}"), (20, passage), (20, passage), (-5, base + " tail"), (21, "a\x0bb\x0cc\rd"),
    ]
    rows = []
    for i, (doc_id, text) in enumerate(texts):
        lang = None if i % 5 == 4 else ("en", "de")[i % 2]
        source = None if i % 7 == 3 else f"s{i % 3}"
        rows.append((doc_id, text, lang, source, None if text is None else len(text), *["x" if n % 2 else None for n in range(EXTRA)]))
    kinds = SCHEMA.split(", ")
    fixed = []
    for row in rows:
        fixed.append(tuple(v if not isinstance(v, str) or "string" in kinds[i] else 1 for i, v in enumerate(row)))
    return fixed


def odd_docs(spark, seed: int = 1):
    return spark.createDataFrame(odd_rows(seed), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
