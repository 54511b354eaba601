"""Byte-pair merging by a pair occurrence index over the distinct words of a partition.

All words stand in one linked sequence of symbols.  An index maps each
mergeable pair, by its rank, to the positions where it occurs.  Ranks are taken
in ascending order, each over its whole position list, and a merge updates only
the lists of the pairs beside it.  That order equals merging word by word
because a merge's product is always learnt before any merge that uses it
(checked when the merges are read).

A list of many positions is applied with whole-array steps, one of few
positions in a loop over the same memory, so a partition's worth of words costs
far less than the same words in small batches.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterable

import numpy as np

#: Positions of a pair from which it is merged with whole-array steps.
VECTOR_ROWS = 32
#: Symbols merged together; bounds the index, about 40 bytes a symbol.
MERGE_SYMBOLS = 1 << 22


def words(known: Iterable[str] = ()) -> defaultdict:
    """Numbers of distinct words, in order of appearance; looking one up numbers it."""
    given = {w: n for n, w in enumerate(known)}
    return defaultdict(itertools.count(len(given)).__next__, given)


class PairIndex:
    """Merges (left, right, made) in order of rank, over token ids below 2**20."""

    def __init__(self, merges: list[tuple[int, int, int]], base: set[int]):
        known = set(base)
        for left, right, made in merges:
            if left not in known or right not in known or made in known:
                raise ValueError("merges must make each token once, after its parts")
            known.add(made)
        self.merges = merges
        self.rank = {left << 20 | right: r for r, (left, right, _) in enumerate(merges)}
        keys = np.array(list(self.rank), np.int64).reshape(-1)
        order = np.argsort(keys)
        self._keys, self._ranks = np.append(keys[order], np.int64(1) << 62), np.append(order, -1).astype(np.int32)
        self._small = np.uint16 if len(merges) <= 1 << 16 else np.int32  # short numbers sort by their digits

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 for those that no merge makes."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, tokens of each word) of words given by their base symbols, one after the other."""
        out, counts = [], []
        ends = np.cumsum(lengths)
        first = 0
        while first < len(lengths):
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + MERGE_SYMBOLS, "right")))
            ids, count = self._merge(symbols[done : int(ends[last - 1])], lengths[first:last])
            out.append(ids)
            counts.append(count)
            first = last
        return np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(symbols)
        # Position n is a fence on both sides of every word; it holds no symbol.
        sym = np.append(symbols, -1).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        stop = np.cumsum(lengths)
        after[stop - 1] = n
        before[stop - lengths] = n
        few: dict[int, list[int]] = defaultdict(list)
        many: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []
        small = self._small
        waiting: set[int] = set()

        def file(rank: np.ndarray, place: np.ndarray) -> None:
            """Enter positions under the ranks of their pairs."""
            hit = rank >= 0
            rank, place = rank[hit], place[hit]
            if not len(rank):
                return
            order = np.argsort(rank.astype(small), kind="stable")
            rank, place = rank[order], place[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for r, a, b in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:]):  # noqa: B905
                many[r].append(place[a:b])
                if r not in waiting:
                    waiting.add(r)
                    heapq.heappush(active, r)

        here = np.flatnonzero(after[:n] != n).astype(np.int32)
        file(self._rank_of(sym[here], sym[here + 1]), here)
        cell, nexts, prevs = memoryview(sym), memoryview(after), memoryview(before)
        rank_of = self.rank.get
        while active:
            r = heapq.heappop(active)
            waiting.discard(r)
            left, right, made = self.merges[r]
            lists, rows = many.pop(r, ()), few.pop(r, [])
            size = len(rows) + sum(map(len, lists))
            if size >= VECTOR_ROWS and left != right:
                p = np.concatenate([*lists, np.array(rows, np.int32)]) if rows or len(lists) > 1 else lists[0]
                q = after[p]
                fits = (sym[p] == left) & (sym[q] == right)
                p, q = p[fits], q[fits]
                sym[p], sym[q] = made, -1
                beyond = after[q]
                after[p] = beyond
                before[beyond] = p
                back = before[p]
                a, b = sym[beyond], sym[back]
                x, y = np.flatnonzero(a >= 0), np.flatnonzero(b >= 0)
                new = np.full(len(x) + len(y), made, np.int32)
                file(self._rank_of(np.concatenate([new[: len(x)], b[y]]), np.concatenate([a[x], new[len(x) :]])), np.concatenate([p[x], back[y]]))
                continue
            for part in lists:
                rows += part.tolist()
            if left == right:
                rows.sort()
            for p in rows:
                if cell[p] != left:
                    continue
                q = nexts[p]
                if cell[q] != right:
                    continue
                cell[p], cell[q] = made, -1
                beyond = nexts[p] = nexts[q]
                if beyond != n:
                    prevs[beyond] = p
                    new = rank_of(made << 20 | cell[beyond])
                    if new is not None:
                        few[new].append(p)
                        if new not in waiting:
                            waiting.add(new)
                            heapq.heappush(active, new)
                back = prevs[p]
                if back != n:
                    new = rank_of(cell[back] << 20 | made)
                    if new is not None:
                        few[new].append(back)
                        if new not in waiting:
                            waiting.add(new)
                            heapq.heappush(active, new)
        alive = sym[:n] >= 0
        count = np.add.reduceat(alive.astype(np.int64), stop - lengths) if len(lengths) else np.zeros(0, np.int64)
        return sym[:n][alive], count


def gathered(flat: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[offsets[k]:offsets[k + 1]]`` of each ``k`` in ``pick``, joined, and their lengths."""
    length = offsets[pick + 1] - offsets[pick]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[pick] - ends + length, length) + np.arange(total)], length
