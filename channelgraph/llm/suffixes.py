"""Common prefixes of neighbouring suffixes, up to a threshold, from a Burrows-Wheeler transform.

Intervals of the sorted suffixes are extended to the left breadth first: the suffixes that begin with a string w are one
interval, and for each byte c before them so are those that begin with cw. Where an interval of w (length l) leads to an
interval that ends at row r, rows r and r + 1 have exactly l bytes in common, if that was not known yet: values come out in
increasing order. After the round for l = threshold - 1 the rows left without a value share the threshold at least.
"""

from __future__ import annotations

import numpy as np

FIRST = 7


def sorted_suffixes(data: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and its inverse. ``rest``: bytes up to the end mark of each position's text, 0 at the mark itself;
    marks sort before all bytes, and earlier marks before later ones."""
    n = len(data)
    room = np.concatenate([data, np.zeros(FIRST, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(FIRST):
        key |= np.where(rest > j, room[j : j + n], 0).astype(np.uint64) << np.uint64(8 * (FIRST - j))
    key |= np.minimum(rest, FIRST).astype(np.uint64)
    active = np.argsort(key)
    key = key[active]
    rank = np.zeros(n, dtype=np.int64)
    old = np.zeros(n, dtype=np.int64)  # rank of the group that a position was in so far
    h = FIRST
    while True:
        # positions of a group stand together; a group's rank is the row of its first
        at = np.arange(len(active))
        new = np.ones(len(active), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        outer = np.ones(len(active), dtype=bool)
        outer[1:] = old[1:] != old[:-1]
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = old + begin - np.maximum.accumulate(np.where(outer, at, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        active = active[~alone]
        if not len(active) or h > int(rest[active].max()):
            break
        old = rank[active]
        ahead = np.minimum(active + h, n - 1)
        key = old * (n + 2) + np.where(rest[active] >= h, rank[ahead] + 1, 0)
        order = np.argsort(key)
        active, key, old = active[order], key[order], old[order]
        h *= 2
    if len(active):  # equal to their ends: in the order of their marks
        order = np.lexsort((active, rank[active]))
        active = active[order]
        old = rank[active]
        outer = np.ones(len(active), dtype=bool)
        outer[1:] = old[1:] != old[:-1]
        at = np.arange(len(active))
        rank[active] = old + at - np.maximum.accumulate(np.where(outer, at, 0))
    suffix = np.empty(n, dtype=np.int64)
    suffix[rank] = np.arange(n)
    return suffix, rank


def sharing(texts: list[bytes], least: int) -> np.ndarray:
    """For each position of the texts put end to end with a mark after each: whether the ``least`` bytes from there also
    start at another position."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    n = len(data)
    marks = np.cumsum(sizes + 1) - 1
    rest = np.repeat(marks, sizes + 1) - np.arange(n)
    suffix, rank = sorted_suffixes(data, rest)
    # the byte before each suffix, none where it begins a text, and the row one step to the left
    before = suffix - 1
    inner = (suffix > 0) & (rest[before] != 0)
    symbol = np.where(inner, data[before].astype(np.int16), -1)
    left = rank[before]
    by_symbol = np.argsort(symbol, kind="stable")
    later, earlier = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    same = symbol[by_symbol[1:]] == symbol[by_symbol[:-1]]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])
    for length in range(least):
        size = high - low + 1
        row = np.arange(int(size.sum())) + np.repeat(low - np.cumsum(size) + size, size)
        real = symbol[row] >= 0
        last = real & (later[row] > np.repeat(high, size))
        first = real & (earlier[row] < np.repeat(low, size))
        # intervals are apart, so their sorted ends belong to their sorted beginnings
        new_low, new_high = np.sort(left[row[first]]), np.sort(left[row[last]])
        if length == 0:  # end marks are letters of their own, each in one place
            ends = rank[marks]
            new_low, new_high = np.sort(np.concatenate([new_low, ends])), np.sort(np.concatenate([new_high, ends]))
        fresh = ~known[new_high + 1]
        low, high = new_low[fresh], new_high[fresh]
        known[high + 1] = True
        if not len(low):
            break
    deep = np.flatnonzero(~known)  # rows deep - 1 and deep share the threshold
    found = np.zeros(n, dtype=bool)
    found[suffix[deep]] = True
    found[suffix[deep - 1]] = True
    return found
