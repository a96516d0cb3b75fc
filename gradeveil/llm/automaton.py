"""A suffix automaton over sequences of integers that knows, for each run of k elements, the least label of the
sequences that hold it."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.label = [0]

    def _state(self, length: int, link: int, edges: dict[int, int], label: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.label.append(label)
        return len(self.length) - 1

    def add(self, sequence: Sequence[int], label: int) -> None:
        """Adds one sequence. Labels must not fall from one call to the next: a state keeps its first label."""
        nexts, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            known = nexts[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:  # split, and go on from the copy
                copy = self._state(length[last] + 1, link[known], dict(nexts[known]), self.label[known])
                link[known] = copy
                p = last
                while p >= 0 and nexts[p].get(c) == known:
                    nexts[p][c] = copy
                    p = link[p]
                last = copy
                continue
            new = self._state(length[last] + 1, 0, {}, label)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = self._state(length[p] + 1, link[q], dict(nexts[q]), self.label[q])
                    link[q] = link[new] = copy
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
            last = new

    def matches(self, sequence: Sequence[int], k: int) -> list[int | None]:
        """Matching statistics cut at k: for each start of a run of k elements in sequence, the least label of a
        sequence that holds the run, or None."""
        nexts, link, length, label = self.next, self.link, self.length, self.label
        out: list[int | None] = []
        state, size = 0, 0
        for i, c in enumerate(sequence):
            while state and c not in nexts[state]:
                state = link[state]
                size = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                size += 1
            while link[state] >= 0 and length[link[state]] >= k:
                state = link[state]
                size = length[state]
            if i + 1 >= k:
                out.append(label[state] if size >= k else None)
        return out
