"""Parts that need no Spark."""

import random

import numpy as np

from rowrelay.llm import ann, bpe, langid
from rowrelay.llm.automata import SuffixAutomaton
from rowrelay.llm.queries import PATTERN, RANKS
from tests.llm import brute


def test_bpe_equals_tiktoken():
    rnd = random.Random(5)
    texts = ["", "a" * 2000, "ab" * 900, " " * 700, "日本語テキスト" * 200, "a\r\n\n b", "it's we'll"]
    for letters, n in (("abcdefé日 \n\t1", 5000), ("eatinsr", 3000), ("eatinsr", 500), ("eatinsr", 333), ("theando ", 4000)):
        texts += ["".join(rnd.choice(letters) for _ in range(n)) for _ in range(5)]
    coder, own = brute.tiktoken_encoding(RANKS, PATTERN), bpe.Encoder(RANKS, PATTERN)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_automaton_equals_search():
    rnd = random.Random(3)
    for _ in range(400):
        least, letters = rnd.choice([1, 2, 3, 4]), [b"a", b"b", b"c"][: rnd.choice([1, 2, 3])]
        refs = [(rnd.randrange(9), [rnd.choice(letters) for _ in range(rnd.randrange(12))]) for _ in range(rnd.randrange(6))]
        text, below = [rnd.choice([*letters, b"z"]) for _ in range(rnd.randrange(15))], rnd.randrange(10)
        automaton = SuffixAutomaton()
        for owner, words in refs:
            automaton.add(owner, words)
        got = set()
        for start, stop in automaton.finish().matched_spans(text, least, below):
            got |= set(range(start, stop))
        want = set()
        for i in range(len(text) - least + 1):
            if any(o < below and any(w[j : j + least] == text[i : i + least] for j in range(len(w) - least + 1)) for o, w in refs):
                want |= set(range(i, i + least))
        assert got == want


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(50, 64))
    y = ann.rotated(x, 3)
    assert np.allclose(x @ x.T, y @ y.T)
    assert not np.allclose(y, ann.rotated(x, 4))


def test_language_model_is_calibrated():
    rng = np.random.default_rng(0)
    counts = np.zeros((200, langid.BUCKETS))
    for i in range(200):
        counts[i, rng.integers(0, 50, 40) + 100 * (i % 2)] += 1
    model = langid.train(counts.copy(), ["ab"[i % 2] for i in range(200)])
    assert model.languages == ("a", "b")
    assert all(model.languages[int(model.scores(c).argmax())] == "ab"[i % 2] for i, c in enumerate(counts))
    assert 0 < model.reject_below <= 0.75
    assert abs(model.scores(np.zeros(langid.BUCKETS)).sum() - 1) < 1e-9
