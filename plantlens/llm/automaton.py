"""Generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Recognises every substring of the sequences added; ``link`` and ``length``
    are the suffix links and longest lengths of its states, state 0 is the root."""

    def __init__(self, sequences: Iterable[Sequence[Hashable]] = ()) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for s in sequences:
            self.add(s)

    def _new(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: Hashable, q: int) -> int:
        """Clone q for the suffixes that reach it from p, and return the clone."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, seq: Sequence[Hashable]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None:  # another sequence went this way
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            cur, p = self._new(length[last] + 1, 0, {}), last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def states(self, seq: Iterable[Hashable]):
        """(state, matched length) after each symbol: the longest suffix read that occurs."""
        nxt, link, length = self.next, self.link, self.length
        v = l = 0
        for c in seq:
            t = nxt[v].get(c)
            while t is None and v:
                v = link[v]
                l = length[v]
                t = nxt[v].get(c)
            if t is not None:
                v = t
                l += 1
            yield v, l
