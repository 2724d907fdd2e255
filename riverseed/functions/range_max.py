"""Maxima over ranges of an ordered set of places that items enter and leave."""

from __future__ import annotations


class RangeMaxima:
    """A tree over ``n`` ordered places. An item is held at a place with a worth; the best
    item of a closed range is that of the largest worth, of equal ones the least number.
    Entering and leaving stop where a node has a better item anyway."""

    def __init__(self, n: int):
        self.size = 1 << max(n - 1, 1).bit_length()
        self.top = [-1] * (2 * self.size)
        self.worth: dict[int, float] = {}

    def _better(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        x, y = self.worth[a], self.worth[b]
        return a if x > y or (x == y and a < b) else b

    def __len__(self) -> int:
        return len(self.worth)

    def __contains__(self, item: int) -> bool:
        return item in self.worth

    def insert(self, item: int, place: int, worth: float) -> None:
        """Hold ``item`` at a free ``place``."""
        self.worth[item] = worth
        at = self.size + place
        while at and self._better(item, self.top[at]) == item:
            self.top[at] = item
            at >>= 1

    def drop(self, item: int, place: int) -> None:
        at = self.size + place
        self.top[at] = -1
        at >>= 1
        while at and self.top[at] == item:
            self.top[at] = self._better(self.top[2 * at], self.top[2 * at + 1])
            at >>= 1
        del self.worth[item]

    def best(self, lo: int, hi: int) -> int:
        """The best item at the places ``lo`` to ``hi``, both included; -1 if there is none."""
        a, b, found = self.size + lo, self.size + hi + 1, -1
        while a < b:
            if a & 1:
                found = self._better(found, self.top[a])
                a += 1
            if b & 1:
                b -= 1
                found = self._better(found, self.top[b])
            a, b = a >> 1, b >> 1
        return found
