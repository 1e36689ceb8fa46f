"""A suffix automaton over words, with the smallest owner of every run of words, and matching statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """Recognises every run of words that stands in one of the sequences added, and knows the smallest owner it was added with.

    settle() must be called between the last add() and the first firsts().
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner: list = [None]

    def _new(self, length: int, edges: dict, link: int, owner) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q for the suffixes that p's edge leads to."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], None)
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: Iterable, owner=0) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                if self.owner[last] is None or owner < self.owner[last]:
                    self.owner[last] = owner
                continue
            new = self._new(self.length[last] + 1, {}, 0, owner)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def settle(self) -> None:
        """Owners go down the suffix links: a run stands wherever a longer one that ends in it does."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            link, own = self.link[state], self.owner[state]
            if link > 0 and (self.owner[link] is None or own < self.owner[link]):
                self.owner[link] = own

    def states(self, words: Iterable) -> Iterator[tuple[int, int]]:
        """At each word: the length of the longest run ending there that some sequence holds, and its state."""
        state = n = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            nxt = self.next[state].get(w)
            if nxt is None:
                n = 0
            else:
                state, n = nxt, n + 1
            yield n, state

    def statistics(self, words: Iterable) -> list[int]:
        return [n for n, _ in self.states(words)]

    def firsts(self, words: Iterable, window: int) -> Iterator[tuple[int, object]]:
        """(end, owner) of each run of `window` words that some sequence holds: the smallest owner it was added with."""
        link, length = self.link, self.length
        for end, (n, state) in enumerate(self.states(words), 1):
            if n >= window:
                while length[link[state]] >= window:
                    state = link[state]
                yield end, self.owner[state]
