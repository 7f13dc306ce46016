"""Self-join of 64-bit fingerprints within a Hamming budget, on an implicit binary trie."""

from __future__ import annotations

import numpy as np

#: Node pairs with at most this many fingerprint pairs are compared outright.
LEAF = 4096


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self, lo: int, hi: int) -> np.ndarray:
        up, x = self.up, self.up[lo:hi]
        while True:
            y = up[x]
            if np.array_equal(x, y):
                up[lo:hi] = x
                return x
            x = y


def trie_links(values: np.ndarray, budget: int, agree=None, more: np.ndarray | None = None, links: list | None = None, sift=None) -> np.ndarray:
    """Root position of each of the sorted uint64 values: values within the budget of each other are joined, if agree(i, j).

    more: a second word of each value, whose differing bits count towards the budget as well. links: receives the pairs
    that joined two groups, the nearest of a block first. sift(i, j): which of the pairs, given as two arrays, agree is
    asked for at all.

    Nodes are ranges of the sorted array that share their leading bits. Pairs of nodes are walked together from the
    root; the bits in which their prefixes differ add up, and a pair is left once they pass the budget. Pairs whose
    members all are in one group already have nothing to add and are left as well.
    """
    n = len(values)
    groups = Groups(n)
    stack = [(0, n, 0, n, 63, 0)]
    while stack:
        a, b, c, d, bit, spent = stack.pop()
        if b <= a or d <= c:
            continue
        same = a == c
        if (b - a) * (d - c) <= LEAF or bit < 0:
            if same and b - a == 1:
                continue
            apart = np.bitwise_count(values[a:b, None] ^ values[None, c:d])
            if more is not None:
                apart = apart + np.bitwise_count(more[a:b, None] ^ more[None, c:d])
            at = np.nonzero(apart <= budget)
            if links is not None:
                order = np.argsort(apart[at], kind="stable")
                at = at[0][order], at[1][order]
            r, s = groups.roots(a, b)[at[0]], groups.roots(c, d)[at[1]]
            open_ = np.flatnonzero(r != s)
            if agree is None:  # of pairs between the same two groups, one is enough
                open_ = open_[np.sort(np.unique(r[open_] * n + s[open_], return_index=True)[1])]
            if sift is not None and len(open_):
                open_ = open_[sift(a + at[0][open_], c + at[1][open_])]
            for i, j in zip(at[0][open_], at[1][open_], strict=True):
                i, j = a + int(i), c + int(j)
                if (not same or i < j) and (agree is None or (groups.find(i) != groups.find(j) and agree(i, j))):
                    if links is not None and groups.find(i) != groups.find(j):
                        links.append((i, j))
                    groups.join(i, j)
            continue
        r = groups.roots(a, b)
        if r[0] == r[-1] and (r == r[0]).all():
            s = r if same else groups.roots(c, d)
            if (s == r[0]).all():
                continue
        mask = np.uint64(1 << bit)
        high = values[a] & ~(mask - np.uint64(1))
        m = a + int(np.searchsorted(values[a:b], high | mask)) if not values[a] & mask else a
        if same:
            k = m
        else:
            high = values[c] & ~(mask - np.uint64(1))
            k = c + int(np.searchsorted(values[c:d], high | mask)) if not values[c] & mask else c
        # the crossed pairs last on the stack would come first: push them first, so that joined parts prune them
        if spent < budget:
            stack.append((a, m, k, d, bit - 1, spent + 1))
            if not same:
                stack.append((m, b, c, k, bit - 1, spent + 1))
        stack.append((a, m, c, k, bit - 1, spent))
        stack.append((m, b, k, d, bit - 1, spent))
    return groups.roots(0, n).copy()
