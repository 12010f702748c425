"""BK-tree under the Levenshtein metric."""

from __future__ import annotations

from collections.abc import Iterable


def profile(word: str) -> dict[str, int]:
    """Bit positions of each character, for :func:`distance`."""
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(bits: dict[str, int], size: int, other: str) -> int:
    """Levenshtein distance of the profiled word of ``size`` letters to ``other``, a machine word of cells at a time."""
    if not size:
        return len(other)
    mask, top = (1 << size) - 1, 1 << size - 1
    plus, minus, score = mask, 0, size
    for c in other:
        eq = bits.get(c, 0)
        vertical = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(eq | plus)
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) | 1
        down <<= 1
        plus = (down | ~(vertical | up)) & mask
        minus = up & vertical & mask
    return score


def levenshtein(a: str, b: str) -> int:
    return distance(profile(a), len(a), b)


class BKTree:
    """Every key within a radius of a query; subtrees are left out by the triangle inequality only."""

    def __init__(self, items: Iterable[tuple[str, object]]):
        self.keys: list[str] = []
        self.values: list[list] = []
        self.children: list[dict[int, int]] = []
        for key, value in items:
            self.add(key, value)

    def add(self, key: str, value: object) -> None:
        if not self.keys:
            self._new(key, value)
            return
        bits, at = profile(key), 0
        while True:
            d = distance(bits, len(key), self.keys[at])
            if d == 0:
                self.values[at].append(value)
                return
            if d not in self.children[at]:
                self.children[at][d] = self._new(key, value)
                return
            at = self.children[at][d]

    def _new(self, key: str, value: object) -> int:
        self.keys.append(key)
        self.values.append([value])
        self.children.append({})
        return len(self.keys) - 1

    def within(self, query: str, radius: int) -> list[tuple[int, object]]:
        """(distance, value) of every entry at most ``radius`` away."""
        out, todo, bits = [], [0] if self.keys else [], profile(query)
        while todo:
            at = todo.pop()
            d = distance(bits, len(query), self.keys[at])
            if d <= radius:
                out += [(d, v) for v in self.values[at]]
            todo += [child for e, child in self.children[at].items() if d - radius <= e <= d + radius]
        return out
