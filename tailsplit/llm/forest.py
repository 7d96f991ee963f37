"""Groups of linked items inside one task: whatever is linked ends up under its smallest number."""

from __future__ import annotations

import numpy as np


class Groups:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, items: np.ndarray) -> np.ndarray:
        found = self.parent[items]
        while True:
            up = self.parent[found]
            if (up == found).all():
                self.parent[items] = found
                return found
            found = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def join_where(self, linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] and b[j] wherever linked[i, j]; of many links between the same groups it follows few."""
        while True:
            linked = linked & (self.roots(a)[:, None] != self.roots(b)[None, :])
            rows = np.flatnonzero(linked.any(1))
            if not len(rows):
                return
            self.join(a[rows], b[linked[rows].argmax(1)])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(item, smallest item of its group) where they differ."""
        root = self.roots(np.arange(len(self.parent)))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return moved, root[moved]
