"""Suffix automata over word sequences, each state with the smallest owner of its occurrences."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of several word sequences; ``owner[state]`` is the smallest owner that has the state's substrings."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner: list[int | None] = [None]

    def add(self, owner: int, words: Iterable[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word, owner)

    def _state(self, length: int, transitions: dict[bytes, int], link: int, owner: int | None) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes, owner: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another sequence has brought this far already
            if self.length[known] == self.length[last] + 1:
                self._claim(known, owner)
                return known
            copy = self._split(last, word, known)
            self._claim(copy, owner)
            return copy
        fresh = self._state(self.length[last] + 1, {}, 0, owner)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = fresh
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[fresh] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return fresh

    def _split(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.owner[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _claim(self, state: int, owner: int) -> None:
        if self.owner[state] is None or owner < self.owner[state]:
            self.owner[state] = owner

    def finish(self) -> SuffixAutomaton:
        """Hand the smallest owners down the suffix links: a shorter suffix occurs wherever a longer one does."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            owner, to = self.owner[state], self.link[state]
            if to > 0 and owner is not None and (self.owner[to] is None or owner < self.owner[to]):
                self.owner[to] = owner
        return self

    def matched_spans(self, words: Sequence[bytes], least: int, below: int) -> list[tuple[int, int]]:
        """Maximal spans covered by ``least`` words in a row that an owner smaller than ``below`` has, too.

        Streams the words for matching statistics: the longest suffix so far that the automaton knows.
        """
        spans: list[tuple[int, int]] = []
        state, matched = 0, 0
        for end, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched < least:
                continue
            at = state  # the state that holds the last ``least`` words
            while self.length[self.link[at]] >= least:
                at = self.link[at]
            owner = self.owner[at]
            if owner is not None and owner < below:
                start = end - least
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((start, end))
        return spans
