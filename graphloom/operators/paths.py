"""Forests that answer for the paths between their vertices while edges come and go."""

from __future__ import annotations


class PathForest:
    """Trees over the nodes 0 to n - 1, of which each has a value; the largest value on a path, and edges set and
    taken away, in amortised logarithmic time.

    Each tree is cut into paths, each path a splay tree ordered by depth; ``up`` of a path's root is the
    path's parent. An edge whose weight matters is a node of its own between its ends.
    """

    def __init__(self, values: list[int]) -> None:
        n = len(values)
        self.value, self.most = values, [*values]
        self.up, self.kids, self.turned = [-1] * n, [[-1, -1] for _ in range(n)], [False] * n

    def _tops(self, x: int) -> bool:
        return self.up[x] < 0 or x not in self.kids[self.up[x]]

    def _settle(self, x: int) -> None:
        if self.turned[x]:
            self.kids[x].reverse()
            for kid in self.kids[x]:
                if kid >= 0:
                    self.turned[kid] = not self.turned[kid]
            self.turned[x] = False

    def _sum(self, x: int) -> None:
        self.most[x] = max([self.value[x]] + [self.most[kid] for kid in self.kids[x] if kid >= 0])

    def _rotate(self, x: int) -> None:
        p = self.up[x]
        g, side = self.up[p], int(self.kids[p][1] == x)
        if not self._tops(p):
            self.kids[g][int(self.kids[g][1] == p)] = x
        inner = self.kids[x][1 - side]
        self.kids[p][side], self.kids[x][1 - side] = inner, p
        if inner >= 0:
            self.up[inner] = p
        self.up[x], self.up[p] = g, x
        self._sum(p)

    def _splay(self, x: int) -> None:
        chain = [x]
        while not self._tops(chain[-1]):
            chain.append(self.up[chain[-1]])
        for y in reversed(chain):
            self._settle(y)
        while not self._tops(x):
            p = self.up[x]
            if not self._tops(p):
                g = self.up[p]
                self._rotate(p if (self.kids[g][1] == p) == (self.kids[p][1] == x) else x)
            self._rotate(x)
        self._sum(x)

    def _expose(self, x: int) -> None:
        """Makes the path from the root to x one splay tree with x on top."""
        below, y = -1, x
        while y >= 0:
            self._splay(y)
            self.kids[y][1] = below
            self._sum(y)
            below, y = y, self.up[y]
        self._splay(x)

    def _root(self, x: int) -> None:
        self._expose(x)
        self.turned[x] = not self.turned[x]
        self._settle(x)

    def link(self, x: int, y: int) -> None:
        """An edge between nodes of two trees."""
        self._root(x)
        self.up[x] = y

    def cut(self, x: int, y: int) -> None:
        """Takes the edge between x and y away."""
        self._root(x)
        self._expose(y)
        self.kids[y][0] = self.up[x] = -1
        self._sum(y)

    def largest(self, x: int, y: int) -> int:
        """The largest value on the path between two nodes of one tree."""
        self._root(x)
        self._expose(y)
        return self.most[y]
