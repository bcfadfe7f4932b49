"""Plain versions of the operators, one document after another."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import tiktoken

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def grams(items: list[str], k: int) -> list[tuple[str, ...]]:
    k = min(k, len(items))
    return [tuple(items[i : i + k]) for i in range(len(items) - k + 1)] if k else []


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs: list[tuple[int | None, str | None]], k: int = 5, share: int = 75) -> dict[int, tuple]:
    """doc_id -> (doc_id, n_shingles, component_id, kept); rows of one id must have one text."""
    sets = {i: set(grams(words((t or "").translate(UPPER)), k)) for i, t in docs if i is not None}
    holders, links = defaultdict(list), []
    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in holders[g])
        links += [(i, j) for j, n in common.items() if 100 * n >= share * (len(sets[i]) + len(sets[j]) - n)]
        for g in sets[i]:
            holders[g].append(i)
    root = roots(sets, links)
    return {i: (i, len(s), root[i], root[i] == i) for i, s in sets.items()}


def leaks(docs, bench) -> dict[tuple[int, int], float]:
    """(doc_id, item_id) -> score of the best of all windows of the item's size."""
    found = {}
    for i, t in docs:
        w = words((t or "").lower())
        for item, text in bench:
            own = words((text or "").lower())
            if not own or i is None:
                continue
            k = min(5, len(own))
            want = Counter(grams(own, k))
            seen = set(grams(w, k)) & set(want) if len(w) >= k else set()
            if not seen:
                continue
            for start in range(max(1, len(w) - len(own) + 1)):
                have = Counter(grams(w[start : start + len(own)], k))
                common = sum((have & want).values())
                if common and 100 * common >= 75 * sum((have | want).values()):
                    found[i, item] = max(found.get((i, item), 0.0), common / sum((have | want).values()))
    return found


def line_dedup(docs) -> dict[int, str | None]:
    seen, out = set(), {}
    for i, t in sorted(docs):
        if t is None:
            out[i] = None
            continue
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        chunks, first = [], 0
        for n in range(len(lines)):
            rolling = h[n] + 31 * (h[n - 1] if n > 0 else 0) + 961 * (h[n - 2] if n > 1 else 0)
            if n == len(lines) - 1 or rolling % 1_000_003 % 4 == 0:
                chunks.append(lines[first : n + 1])
                first = n + 1
        kept = []
        for c in chunks:
            text = "\n".join(c)
            if len(c) < 2 or text not in seen:
                kept.append(text)
            if len(c) >= 2:
                seen.add(text)
        out[i] = "\n".join(kept)
    return out


def substrings(docs) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_words, n_removed, kept text)."""
    least = {}
    for i, t in docs:
        if i is not None:
            for g in grams(words(t), 13) if len(words(t)) >= 13 else []:
                least[g] = min(i, least.get(g, i))
    out = {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        if i is not None and len(w) >= 13:
            for p, g in enumerate(grams(w, 13)):
                if least[g] < i:
                    gone[p : p + 13] = [True] * 13
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").translate(UPPER))


def licenses(text: str | None, templates) -> set[str]:
    """Licenses of which some window of the right size holds three quarters of the shingles."""
    found, w = set(), plain_words(text)
    for name, template in templates:
        own = plain_words(template)
        k = min(5, len(own))
        want = set(grams(own, k))
        size = 8
        while size < 2 * len(want):
            size *= 2
        have = grams(w, k) if len(w) >= k else []
        for start in range(0, max(1, len(have)), size // 2):
            if 100 * len(want & set(have[start : start + size])) >= 75 * len(want):
                found.add(name)
    return found


def tiktoken_encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def digests(ids: list[int], text: str | None) -> tuple[str, str]:
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def collocations(docs: list[tuple[str | None, str | None]], least: int = 30, kept: int = 2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) for rows (lang, text)."""
    f: dict[str, Counter] = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            own = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for size in range(1, 5):
                f["und" if lang is None else lang].update(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
    out = []
    for lang, count in f.items():
        n = sum(a for p, a in count.items() if len(p) == 1)
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(a, around[p[i : i + size]])
        ranked = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            if not (around[p] and 100 * around[p] >= 80 * a):
                ranked.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:kept])]
    return sorted(out)
