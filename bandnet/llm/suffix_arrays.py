"""Suffix arrays of byte strings in numpy, and what they say about repeated stretches."""

from __future__ import annotations

import numpy as np


def prefix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` bytes (equal prefixes have equal ranks), the end being smallest.

    Larsson and Sadakane's refinement: suffixes are ordered by 8 bytes, then groups that are not yet settled are
    ordered by the rank of the suffix h places on, h doubling; a group of one takes no part any more.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    if depth < 8:
        raise ValueError("depth must be at least 8")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").reshape(-1).astype(np.uint64)
    order = np.argsort(key)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    unsettled = _settle(order, key[order], np.zeros(n, np.int64), rank)
    # Zeros past the end look like zeros in the text: the last 8 suffixes are told apart by their length
    for i in range(max(0, n - 7), n):
        same = np.flatnonzero(rank[:n] == rank[i])
        if len(same) > 1:
            by_length = sorted(same.tolist(), key=lambda j: (min(8, n - j), j >= n - 7))
            base, place = rank[i], 0
            for k, j in enumerate(by_length):
                if k and min(8, n - j) != min(8, n - by_length[k - 1]):
                    place = k
                rank[j] = base + place
    unsettled = np.flatnonzero(np.bincount(rank[:n], minlength=n)[rank[:n]] > 1)
    done = 8
    while done < depth and len(unsettled):
        step = min(done, depth - done)
        following = rank[np.minimum(unsettled + step, n)]
        old = rank[unsettled]
        place = np.argsort(old * (n + 2) + following + 1)
        order = unsettled[place]
        unsettled = _settle(order, following[place], old[place], rank)
        done += step
    return rank[:n]


def _settle(order: np.ndarray, key: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rank ordered suffixes anew within their groups; return those that still share a rank."""
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    heads = np.concatenate([[True], group[1:] != group[:-1]])
    at = np.arange(len(order))
    base = np.maximum.accumulate(np.where(heads, at, 0))
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    rank[order] = group + first - base
    alone = fresh & np.concatenate([fresh[1:], [True]])
    return order[~alone]


def common_prefixes(data: np.ndarray, starts: np.ndarray, ranks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts in suffix order, and the length each shares with the one before it, counted up to the ends of both.

    Kasai's argument: if i shares h bytes with the suffix before it, i + 1 shares h - 1 with one before it. So only
    starts are compared whose preceding bytes differ or are no neighbours as well; the others follow.
    """
    order = starts[np.argsort(ranks[starts], kind="stable")]
    if not len(order):
        return order, np.empty(0, np.int64)
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    i = np.sort(starts)
    j = before[i]
    limit = np.where(j >= 0, np.minimum(ends[i] - i, ends[j] - j), 0)
    follows = np.concatenate([[False], (np.diff(i) == 1) & (j[1:] > 0) & (j[1:] == j[:-1] + 1)])
    follows &= data[np.maximum(i - 1, 0)] == data[np.maximum(j - 1, 0)]
    length = np.zeros(len(i), dtype=np.int64)
    compare = np.flatnonzero(~follows & (j >= 0))
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    while len(compare):
        a, b = i[compare] + length[compare], j[compare] + length[compare]
        same = words[np.minimum(a, n)] == words[np.minimum(b, n)]
        more = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        length[compare] += more
        compare = compare[(more == 8) & (length[compare] < limit[compare])]
    # A start that follows shares one byte less than the start before it
    at = np.arange(len(i))
    source = np.maximum.accumulate(np.where(follows, 0, at))
    length = np.minimum(np.maximum(length[source] - (at - source), 0), limit)
    shared = np.zeros(n, dtype=np.int64)
    shared[i] = length
    return order, shared[order]


def repeated_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """For each start whether its ``size`` bytes also begin at another of the starts; ``ends`` bounds each position's text."""
    ranks = prefix_ranks(data, size)
    order, shared = common_prefixes(data, starts, ranks, ends)
    flags = np.zeros(len(data), dtype=bool)
    meet = np.flatnonzero(shared >= size)
    flags[order[meet]] = True
    flags[order[meet - 1]] = True
    return flags[starts]
