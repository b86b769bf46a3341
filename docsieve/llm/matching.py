"""Matching of greatest total weight in any graph (Edmonds), one record's search at a time.

Weights are whole numbers, so there is no rounding. Every record has a price, at
first its greatest weight; an edge is tight when the prices of its ends add up to
twice its weight, never less. Edges that are best for both ends are matched. Each
record that is still alone and has a price grows a tree of tight edges, in which
prices move until it finds a partner or the one that gains least by being matched
is let go. Odd rings of tight edges (blossoms) are one node until they are entered.
A search touches its tree only, so the cost follows the trees and not the graph.
"""

from __future__ import annotations


class _Matching:
    def __init__(self, adj: list[list[tuple[int, int]]]):
        n = len(adj)
        self.n, self.adj, self.price = n, adj, [max((w for _, w in a), default=0) for a in adj]
        self.mate, self.top, self.parent = [-1] * n, list(range(n)), dict.fromkeys(range(n))
        self.base = dict(enumerate(range(n)))
        self.ring: dict[int, list[int]] = {}
        self.links: dict[int, list[tuple[int, int]]] = {}
        self.z: dict[int, int] = {}
        self.next = n

    def run(self) -> list[int]:
        """The partner of each record, -1 without one."""
        best = ((-w, u, v) for u, a in enumerate(self.adj) for v, w in a if u < v and self.price[u] == w == self.price[v])
        for _, u, v in sorted(best):
            if self.mate[u] < 0 and self.mate[v] < 0:
                self.mate[u], self.mate[v] = v, u
        for s in range(self.n):
            if self.mate[s] < 0 and self.price[s] > 0:
                self._search(s)
        return self.mate

    def _leaves(self, b: int) -> list[int]:
        out, todo = [], [b]
        while todo:
            x = todo.pop()
            if x < self.n:
                out.append(x)
            else:
                todo.extend(self.ring[x])
        return out

    # ------------------------------------------------------------ one tree

    def _search(self, root: int) -> None:
        price, mate, top = self.price, self.mate, self.top
        self.outer: dict[int, bool] = {}  # nodes of the tree: even distance from the root, or odd
        self.via: dict[int, tuple[int, int] | None] = {}
        self.todo: list[int] = []
        self._enter(root, None)
        while True:
            while self.todo:
                v = self.todo.pop()
                for w, weight in self.adj[v]:
                    b = top[w]
                    if b == top[v] or price[v] + price[w] > 2 * weight:
                        continue
                    if b not in self.outer:
                        if mate[self.base[b]] < 0:
                            if b >= self.n:
                                self._rebase(b, w)
                            mate[w] = v
                            return self._flip(v, w)
                        self._odd(v, w)
                    elif self.outer[b]:
                        self._shrink(v, w)
            # the least move of prices that makes an edge tight, opens a ring or lets a record go
            least, what = None, None
            even = [v for b, outer in self.outer.items() if outer for v in self._leaves(b)]
            for v in even:
                p, b = price[v], top[v]
                for w, weight in self.adj[v]:
                    c = top[w]
                    if c == b:
                        continue
                    outer = self.outer.get(c)
                    if outer is False:
                        continue
                    slack = p + price[w] - 2 * weight
                    if outer:
                        slack //= 2
                    if least is None or slack < least:
                        least, what = slack, (0, v)
            for b, outer in self.outer.items():
                if not outer and b >= self.n and (least is None or self.z[b] < least):
                    least, what = self.z[b], (1, b)
            v = min(even, key=lambda x: (price[x], x))
            if least is None or price[v] < least:
                least, what = price[v], (2, v)
            if least:
                for b, outer in self.outer.items():
                    step = -least if outer else least
                    for x in self._leaves(b):
                        price[x] += step
                    if b >= self.n:
                        self.z[b] -= step
            if what[0] == 2:
                return self._flip(what[1], -1)
            if what[0] == 1:
                self._open(what[1])
            else:
                self.todo.append(what[1])

    def _enter(self, v: int, via: tuple[int, int] | None) -> None:
        b = self.top[v]
        self.outer[b], self.via[b] = True, via
        self.todo += self._leaves(b)

    def _odd(self, v: int, w: int) -> None:
        """The node of w is reached from v; its partner is entered."""
        b = self.top[w]
        self.outer[b], self.via[b] = False, (v, w)
        x = self.base[b]
        self._enter(self.mate[x], (x, self.mate[x]))

    def _up(self, b: int) -> int | None:
        return None if self.via[b] is None else self.top[self.via[b][0]]

    def _shrink(self, v: int, w: int) -> None:
        """A tight edge between two even nodes closes an odd ring: it becomes one node."""
        a, c, above = self.top[v], self.top[w], set()
        x = c
        while x is not None:
            above.add(x)
            x = self._up(x)
        path, links, x = [], [(v, w)], a
        while x not in above:
            path.append(x)
            links.append(self.via[x])
            x = self._up(x)
        stem = x
        path.append(stem)
        path.reverse()
        links.reverse()
        x = c
        while x != stem:
            path.append(x)
            links.append(self.via[x][::-1])
            x = self._up(x)
        b, self.next = self.next, self.next + 1
        self.base[b], self.ring[b], self.links[b], self.z[b], self.parent[b] = self.base[stem], path, links, 0, None
        via = self.via[stem]
        for x in path:
            self.parent[x] = b
            inner = self._leaves(x)
            if not self.outer.pop(x):
                self.todo += inner
            del self.via[x]
            for y in inner:
                self.top[y] = b
        self.outer[b], self.via[b] = True, via

    def _open(self, b: int) -> None:
        """An odd node without a price falls apart; the even way through it stays in the tree."""
        ring, links, (v, w) = self.ring.pop(b), self.links.pop(b), self.via.pop(b)
        del self.outer[b], self.z[b], self.base[b], self.parent[b]
        for x in ring:
            self.parent[x] = None
            for y in self._leaves(x):
                self.top[y] = x
        j = ring.index(self.top[w])
        step = 1 if j & 1 else -1
        if j & 1:
            j -= len(ring)
        while j:
            self._odd(v, w)
            j += step
            v, w = links[j] if step == 1 else links[j - 1][::-1]
            j += step
        self.outer[ring[0]], self.via[ring[0]] = False, (v, w)
        # those that are left out may have tight edges to the tree: they are seen at the next move of prices

    # ------------------------------------------------------------- matching

    def _rebase(self, b: int, v: int) -> None:
        """Match the records of a ring so that v is the one that is left for a partner outside."""
        todo = [(b, v)]
        while todo:
            b, v = todo.pop()
            x = v
            while self.parent[x] != b:
                x = self.parent[x]
            if x >= self.n:
                todo.append((x, v))
            ring, links = self.ring[b], self.links[b]
            i = j = ring.index(x)
            step = 1 if i & 1 else -1
            if i & 1:
                j -= len(ring)
            while j:
                j += step
                p, q = links[j] if step == 1 else links[j - 1][::-1]
                for c, y in ((ring[j], p), (ring[j + step], q)):
                    if c >= self.n:
                        todo.append((c, y))
                j += step
                self.mate[p], self.mate[q] = q, p
            self.ring[b], self.links[b], self.base[b] = ring[i:] + ring[:i], links[i:] + links[:i], v

    def _flip(self, s: int, j: int) -> None:
        """Give s the partner j (-1: none) and swap matched and other edges up to the root."""
        while True:
            b = self.top[s]
            if b >= self.n:
                self._rebase(b, s)
            self.mate[s] = j
            if self.via[b] is None:
                return
            c = self.top[self.via[b][0]]
            s, j = self.via[c]
            if c >= self.n:
                self._rebase(c, j)
            self.mate[j] = s


def greatest_matching(n: int, edges: list[tuple[int, int, int]]) -> list[int]:
    """Partner of each of n records, -1 without one, of greatest total weight. edges: each two records once, weights above 0."""
    adj: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        adj[a].append((b, w))
        adj[b].append((a, w))
    return _Matching(adj).run()
