"""A double-array trie over bytes, built and walked with numpy.

Node s has a child by symbol c if ``check[base[s] + c] == s``; the child is
node ``base[s] + c``.  ``accept`` gives the number of the key that ends in a node,
or -1.
"""

from __future__ import annotations

import numpy as np

ROOT = 0
_FREE = -1
#: Nodes that look for room at once.
_AT_ONCE = 1 << 18


def _nodes(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct keys: each node's parent and symbol, and the node where each key ends (0 is the root)."""
    begin = np.cumsum(lengths) - lengths
    node = np.zeros(len(lengths), np.int32)
    parents, own, made = [np.full(1, -1, np.int32)], [np.zeros(1, np.uint8)], 1
    for depth in range(int(lengths.max(initial=0))):
        active = np.flatnonzero(lengths > depth)
        parent, symbol = node[active], symbols[begin[active] + depth]
        fresh = np.ones(len(active), bool)  # keys are sorted, so those of one prefix follow each other
        fresh[1:] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
        node[active] = made - 1 + np.cumsum(fresh, dtype=np.int32)
        parents.append(parent[fresh])
        own.append(symbol[fresh])
        made += int(fresh.sum())
    return np.concatenate(parents), np.concatenate(own), node


class DoubleArray:
    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, seed: int = 7):
        """The bytes of all keys one after another, sorted, distinct, none empty; key i is accepted as i."""
        parent, symbol, ends = _nodes(symbols, np.asarray(lengths, np.int64))
        count = len(parent)
        size = max(1024, 2 * count) + 512
        rng = np.random.default_rng(seed)
        # nodes are made level by level in the order of their parents, so children of a node lie together
        begins = np.ones(count - 1, bool)
        begins[1:] = parent[2:] != parent[1:-1]
        first = (np.flatnonzero(begins) + 1).astype(np.int32)
        owners, degree = parent[first], np.diff(np.append(first, np.int32(count))).astype(np.int32)
        base, claim, taken = np.zeros(count, np.int32), np.full(size, _FREE, np.int32), np.zeros(size, bool)
        taken[ROOT] = True
        place = np.zeros(count, np.int32)
        # nodes with many children look for room first, many nodes of about one number at once
        bands = np.searchsorted([2, 3, 5, 9, 17, 65], degree, "right").astype(np.int8)
        for band in range(6, -1, -1):
            waiting = np.flatnonzero(bands == band).astype(np.int32)
            while len(waiting):
                left, waiting = waiting[:_AT_ONCE], waiting[_AT_ONCE:]
                tried = rng.integers(1, size - 256, len(left), dtype=np.int32)
                spread = degree[left]
                rows = np.repeat(np.arange(len(left), dtype=np.int32), spread)
                child = np.repeat(first[left] - (np.cumsum(spread, dtype=np.int32) - spread), spread) + np.arange(len(rows), dtype=np.int32)
                slot = tried[rows] + symbol[child]
                claim[slot] = rows  # of several that want a slot, the last has it
                fits = np.bincount(rows, taken[slot] | (claim[slot] != rows), minlength=len(left)) == 0
                good = fits[rows]
                taken[slot[good]] = True
                place[child[good]] = slot[good]
                base[owners[left[fits]]] = tried[fits]
                waiting = np.concatenate([waiting, left[~fits]])
        self.base, self.check, self.accept = np.zeros(size, np.int32), np.full(size, _FREE, np.int32), np.full(size, _FREE, np.int32)
        # a node without children leads to slots that are no children of its
        self.base[place] = base
        self.check[place[1:]] = place[parent[1:]]
        self.accept[place[ends]] = np.arange(len(ends), dtype=np.int32)

    @classmethod
    def of_bytes(cls, keys: list[bytes]) -> DoubleArray:
        return cls(np.frombuffer(b"".join(keys), np.uint8), np.array([len(k) for k in keys], np.int64))

    def find(self, key: bytes, state: int = ROOT) -> int:
        """The node that ``key`` leads to, or -1."""
        for c in key:
            at = int(self.base[state]) + c
            if self.check[at] != state:
                return -1
            state = at
        return state

    def matches(self, codes: np.ndarray, starts: np.ndarray, states: np.ndarray, boundary: np.ndarray, times: np.ndarray | None = None):
        """Numbers of all keys that begin at ``starts`` and end before a boundary byte.

        All starts advance by one byte in each step, and those without a
        child drop out.  ``codes`` ends with a boundary byte.  With ``times``, one for
        each start, also those of the starts whose keys were found.
        """
        found, often, at, state = [], [], starts, states
        while len(at):
            symbol = codes[at]
            ends = boundary[symbol]
            number = self.accept[state[ends]]
            found.append(number[number >= 0])
            after = self.base[state] + symbol
            alive = self.check[after] == state
            if times is not None:
                often.append(times[ends][number >= 0])
                times = times[alive]
            at, state = at[alive] + 1, after[alive]
        numbers = np.concatenate(found) if found else np.empty(0, np.int32)
        if times is None:
            return numbers
        return numbers, np.concatenate(often) if often else np.empty(0, np.int64)
