"""Periodic runs of words: stretches in which a short sequence of words comes again and again.

The suffixes of a text that share at least ``l`` words form a class. Classes are united by decreasing ``l`` as Kruskal's
algorithm unites trees: the edges are the neighbours in suffix order with the number of words they share, a union-find
holds the classes, and each class keeps its positions in order. Two positions at distance ``p`` that become neighbours in
a class at level ``l >= p`` begin a stretch of ``p + l`` words with period ``p``; it is a run if the word before does not
continue it. No position lies between the two, so no smaller period fits, and every run is found at its own start, once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.llm.storage import fresh_name
from bandnet.llm.suffix_arrays import common_prefixes
from bandnet.llm.textbytes import column_bytes, give_back, keyed, mix, slices, windows

MIN_LENGTH, MIN_EXPONENT = 24, 3
_RUN = "struct<start: long, length: long, period: long>"
RESULT = f"n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string"
_WINDOW_LIMIT = 64


def word_ranks(ids: np.ndarray, row: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of the rows' words, row by row; ``ends`` has the end of each position's row.

    Groups of suffixes that agree in ``span`` words are ordered by the group of the suffix ``span`` words on, and the
    span doubles; a suffix alone in its group takes no part any more.
    """
    n = len(ids)
    rank = np.empty(n, dtype=np.int64)
    order = np.lexsort((ids, row))
    fresh = np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(row[order]) != 0)])
    span = 1
    base = np.zeros(n, dtype=np.int64)
    while len(order):
        at = np.arange(len(order))
        rank[order] = base + np.maximum.accumulate(np.where(fresh, at, 0))
        alone = fresh & np.concatenate([fresh[1:], [True]])
        active = order[~alone]
        after = active + span
        following = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[active]
        place = np.lexsort((following, group))
        order, following, group = active[place], following[place], group[place]
        head = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
        fresh = head | np.concatenate([[True], following[1:] != following[:-1]])[: len(group)]
        # The members of a group follow one another: the head's place is taken off again
        base = group - np.maximum.accumulate(np.where(head, np.arange(len(group)), 0)) if len(group) else group
        span *= 2
    return rank


def adjacent_pairs(order: np.ndarray, shared: np.ndarray, floor: int, copies: int) -> list[tuple[int, int, int]]:
    """Pairs ``(i, j, level)`` that become neighbours in a class at a level of at least ``copies * (j - i)``.

    ``order`` are positions in suffix order, ``shared`` the words each has in common with the one before it. Levels below
    ``floor`` are not visited.
    """
    joints = np.flatnonzero(shared >= floor)
    joints = joints[np.argsort(-shared[joints], kind="stable")]
    parent = list(range(len(order)))
    members: list[list[int]] = [[p] for p in order.tolist()]
    found: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for joint, level in zip(joints.tolist(), shared[joints].tolist(), strict=True):
        a, b = root(joint - 1), root(joint)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        parent[b] = a
        large, small = members[a], members[b]
        members[b] = []
        places = [bisect_left(large, x) for x in small]
        last = len(small) - 1
        for k, (x, at) in enumerate(zip(small, places, strict=True)):
            # Neighbours that come from the same part were neighbours before
            if at and (k == 0 or places[k - 1] != at) and (x - large[at - 1]) * copies <= level:
                found.append((large[at - 1], x, level))
            if at < len(large) and (k == last or places[k + 1] != at) and (large[at] - x) * copies <= level:
                found.append((x, large[at], level))
        if len(small) * 16 < len(large):
            for x, at in zip(reversed(small), reversed(places), strict=True):
                large.insert(at, x)
        else:
            large += small
            large.sort()
    return found


def find_runs(ids: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
    """Starts, lengths and periods of the runs in rows of word numbers, by start and period.

    ``bounds`` are the first words of the rows and one more. A run has at least ``min_length`` words and ``min_exponent``
    (two or more) periods.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("runs have two periods and one word at least")
    none = np.empty(0, np.int64)
    # A run of length n and period p shares n - p words with itself p words on: at least this many
    floor = -(-max(min_length, min_exponent) * (min_exponent - 1) // min_exponent)
    found, starts = windows(mix(ids.astype(np.uint64) + np.uint64(1)), bounds, min(floor, _WINDOW_LIMIT))
    if not len(starts):
        return none, none, none
    row = np.searchsorted(bounds, starts, side="right") - 1
    found = keyed(found, 11) ^ keyed(row.astype(np.uint64), 13)  # of one row only
    order = np.argsort(found)
    same = found[order][1:] == found[order][:-1]
    again = np.zeros(len(found), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    rows = np.unique(row[again])
    if not len(rows):
        return none, none, none
    # From here on only the rows with a window that comes again, end to end
    sizes = bounds[rows + 1] - bounds[rows]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.repeat(bounds[rows] - cuts[:-1], sizes)
    words = ids[np.arange(cuts[-1]) + shift]
    row_of, ends = np.repeat(np.arange(len(rows)), sizes), np.repeat(cuts[1:], sizes)
    back = cuts[:-1] - bounds[rows]
    candidates = starts[again] + back[np.searchsorted(rows, row[again])]
    order, shared = common_prefixes(words, candidates, word_ranks(words, row_of, ends), ends)
    first = row_of[order]
    shared = np.where(np.concatenate([[False], first[1:] == first[:-1]]), shared, 0)
    pairs = adjacent_pairs(order, shared, floor, min_exponent - 1)
    if not pairs:
        return none, none, none
    i, j, level = np.array(pairs, dtype=np.int64).T
    period, length = j - i, j - i + level
    begins = (i == cuts[row_of[i]]) | (words[np.maximum(i - 1, 0)] != words[j - 1])
    real = begins & (length >= min_length)
    i, period, length = i[real] + shift[i[real]], period[real], length[real]
    order = np.lexsort((period, i))
    return i[order], length[order], period[order]


def _measurer(min_length: int, min_exponent: int):
    def measure(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for column in columns:
            data, cuts = column_bytes(column)
            counts, runs_out, best_out, texts = [], [], [], []
            for a, b in slices(cuts):
                split = [data[cuts[k] : cuts[k + 1]].tobytes().split() for k in range(a, b)]
                bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64, bounds[-1])
                start, length, period = find_runs(ids, bounds, min_length, min_exponent)
                of_row = np.searchsorted(start, bounds)
                for k, words in enumerate(split):
                    low, high = of_row[k], of_row[k + 1]
                    own = list(zip((start[low:high] - bounds[k]).tolist(), length[low:high].tolist(), period[low:high].tolist(), strict=True))
                    best = None
                    for s, n, p in own:
                        if best is None or n * best[2] > best[1] * p:
                            best = (s, n, p)
                    if own:
                        change = np.zeros(len(words) + 1, dtype=np.int64)
                        for s, n, p in own:
                            change[s + p] += 1
                            change[s + n] -= 1
                        stays = np.cumsum(change[:-1]) == 0
                        words = [w for w, kept in zip(words, stays.tolist(), strict=True) if kept]
                    runs_out.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    best_out.append(best and {"start": best[0], "length": best[1], "period": best[2]})
                    texts.append(b" ".join(words).decode())
                counts.append(np.diff(bounds))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                    pa.array(runs_out, pa.list_(run_type)),
                    pa.array(best_out, run_type),
                    pa.array(texts, pa.string()),
                ],
                names=["n_words", "runs", "strongest", "collapsed"],
            )
        give_back()

    measure.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return measure


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Add the number of words, the periodic runs, the strongest of them, and the text without the repeats.

    Words are what white space of ASCII separates, numbered from 0. ``runs`` lists every maximal stretch of at least
    ``min_length`` words and ``min_exponent`` smallest periods, by start and period; ``strongest`` has the most periods
    (ties: smallest start, then period) or is null; ``collapsed`` joins by a space the words that no run contains after
    its first period. Null and empty texts have no words, no runs and an empty ``collapsed``. A very long text is
    worked on whole, with memory in proportion to it. Repeated rows give equal results, an empty table an empty one;
    columns named like the new ones are replaced, all others stay.
    """
    names = ["n_words", "runs", "strongest", "collapsed"]
    docs = docs.drop(*names)
    (found,) = fresh_name(docs, "found")
    udf = F.arrow_udf(_measurer(min_length, min_exponent), RESULT).asNondeterministic()
    out = docs.withColumn(found, udf(F.col(text).cast("string")))
    return out.select(*docs.columns, *[F.col(f"{found}.{n}").alias(n) for n in names])
