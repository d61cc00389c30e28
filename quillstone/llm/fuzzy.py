"""Bounded edit distance: a Levenshtein automaton (adjacent swaps included) run over tries.

The automaton is universal: its states hold positions relative to the word's base, so transitions depend only on the
characteristic vector of the next character and are computed once for all words of a process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class LevenshteinAutomaton:
    """Accepts what lies within ``k`` edits (insert, delete, replace, swap neighbours) of a word."""

    def __init__(self, k: int):
        self.k = k
        self.width = 2 * k + 2
        self._ids: dict[tuple, int] = {}
        self._all: list[tuple] = []
        self.table: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.start = self._intern(((0, 0, 0),))

    def _intern(self, state: tuple) -> int:
        if state not in self._ids:
            self._ids[state] = len(self._all)
            self._all.append(state)
        return self._ids[state]

    def step(self, state: int, chi: int, left: int) -> tuple[int, int]:
        """Next state and how far the base moves; state -1 is the sink. ``left``: letters from the base to the end, clipped."""
        key = (state, chi, left)
        hit = self.table.get(key)
        if hit is None:
            hit = self.table[key] = self._step(state, chi, left)
        return hit

    def _step(self, state: int, chi: int, left: int) -> tuple[int, int]:
        out: set[tuple[int, int, int]] = set()
        for i, e, swap in self._all[state]:
            if swap:
                if chi >> i & 1:
                    out.add((i + 2, e, 0))
                continue
            if chi >> i & 1 and i < left:
                out.add((i + 1, e, 0))
                continue
            if e == self.k:
                continue
            out.add((i, e + 1, 0))
            if i < left:
                out.add((i + 1, e + 1, 0))
            for j in range(1, self.k - e + 1):
                if i + j < left and chi >> (i + j) & 1:
                    out.add((i + j + 1, e + j, 0))
            if i + 1 < left and chi >> (i + 1) & 1:
                out.add((i, e + 1, 1))
        kept = [p for p in out if not any(q != p and q[2] == 0 and p[1] - q[1] >= abs(p[0] - q[0]) + p[2] and (p[1] > q[1]) for q in out)]
        if not kept:
            return -1, 0
        base = min(i for i, _, _ in kept)
        return self._intern(tuple(sorted((i - base, e, s) for i, e, s in kept))), base

    def distance(self, state: int, left: int) -> int | None:
        """Edits of the text read so far if it may end here."""
        best = min((e + left - i for i, e, s in self._all[state] if not s and i <= left), default=self.k + 1)
        return best if best <= self.k else None


class Trie:
    """Strings sharing their prefixes; ``None`` marks an end."""

    def __init__(self, words: Iterable[str] = ()):
        self.root: dict = {}
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node[None] = word

    def neighbours(self, word: str, automaton: LevenshteinAutomaton) -> Iterator[tuple[str, int]]:
        """Every stored word within the automaton's bound of ``word``, with its distance."""
        n, width = len(word), automaton.width
        masks: dict[str, int] = {}
        for p, ch in enumerate(word):
            masks[ch] = masks.get(ch, 0) | 1 << p
        clip = (1 << width) - 1
        step, stack = automaton.step, [(self.root, automaton.start, 0)]
        while stack:
            node, state, base = stack.pop()
            for ch, child in node.items():
                if ch is None:
                    d = automaton.distance(state, n - base)
                    if d is not None:
                        yield child, d
                    continue
                nxt, moved = step(state, masks.get(ch, 0) >> base & clip, min(n - base, width))
                if nxt >= 0:
                    stack.append((child, nxt, base + moved))


def osa(a: str, b: str, bound: int) -> int:
    """Edit distance with adjacent swaps, or ``bound + 1`` once it must exceed ``bound``."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    if a == b:
        return 0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i] + [0] * len(b)
        low = i
        for j, y in enumerate(b, 1):
            c = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                c = min(c, before[j - 2] + 1)
            row[j] = c
            low = min(low, c)
        if low > bound:
            return bound + 1
        before = prev
    return min(row[-1], bound + 1)
