"""Spelling variants: words one edit apart, and the frequent form that each stands for.

Two words one edit apart are alike in front of the edit and behind it, so they meet in a list of words with the same head
or in one with the same tail. Each list is sorted and scanned against itself: for every word the row of the edit matrix
(three cells wide, as one edit is allowed) is carried along the sorted list, computed once for all neighbours that share
a prefix, and as soon as a row has no cell of at most one edit the whole range with that prefix is left out. A list that
is too long is divided: the edit is in the first or in the second half of what its words do not share, and one half more
is shared in either case.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.llm.storage import release, stored
from bandnet.llm.textbytes import give_back

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Longest list that is scanned undivided, and words whose counts a task holds at once
LIST_ROWS, HELD_WORDS = 4096, 200_000
_SCAN_CELLS, _SCAN_STATES = 1 << 21, 1 << 19

#: What becomes of a word in the row with a key; None leaves it out
Rewrite = Callable[[object, str], str | None]


def word_counts(
    docs: DataFrame, pattern: str, text: str = "text", key: str | None = None, rewrite: Rewrite | None = None
) -> DataFrame:
    """``(word, n)``: how often each match of ``pattern`` occurs in the texts, of which A-Z are lower-cased first.

    ``rewrite`` may replace a word, knowing the row's ``key``. Every task adds up its own words and sends them on
    whenever it holds ``HELD_WORDS``. Null and empty texts have no words; empty words are left out; rows that are equal
    count each; other columns do not matter; an empty table gives an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        held: dict[str, int] = {}

        def batch_of() -> pa.RecordBatch:
            words = [w for w in held if w]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, said in zip(part["k"].to_pylist(), pc.ascii_lower(part["t"]).to_pylist(), strict=True):
                    if not said:
                        continue
                    for word, n in Counter(find(said)).items():
                        if rewrite is not None:
                            word = rewrite(name, word)
                        if word is not None:
                            held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield batch_of()
        if held:
            yield batch_of()
        give_back()

    texts = docs.select((F.col(key) if key else F.lit(0)).alias("k"), F.col(text).cast("string").alias("t"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_in_lists(zones: list[str], lists: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs of rows of one list whose strings differ by one edit, the shorter being of the list's length.

    ``lists`` are ascending list numbers, ``zones`` sorted within each list and different there; ``roles`` is 0 for
    strings of the list's length and 1 for those one longer. Pairs of two longer ones belong to another list.
    """
    n = len(zones)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none
    size = np.array([len(z) for z in zones], dtype=np.int64)
    width = int(size.max())
    # Two columns on either side that match nothing: the band looks one character ahead and one back
    codes = np.full((n, width + 3), -1, dtype=np.int32)
    flat = np.frombuffer("".join(zones).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    codes[:, 1 : width + 1][np.arange(width) < size[:, None]] = flat
    begins = np.concatenate([[True], lists[1:] != lists[:-1]])
    alike = codes[1:, 1 : width + 1] == codes[:-1, 1 : width + 1]
    differs = np.concatenate([~alike, np.ones((n - 1, 1), dtype=bool)], axis=1)
    lcp = np.concatenate([[0], np.minimum(np.argmax(differs, axis=1), np.minimum(size[1:], size[:-1]))])
    lcp[begins] = 0
    stop = np.searchsorted(lists, lists, side="right")
    first = np.searchsorted(lists, lists, side="left")
    # A state is a word, a range of the sorted list with one prefix, and the row's cells one before, at and one behind
    word, low, high = np.arange(n), first, stop
    band = np.stack([np.full(n, 2, np.int8), np.zeros(n, np.int8), np.where(size >= 1, 1, 2).astype(np.int8)])
    out_word, out_near = [], []
    todo = [(0, word, low, high, band)]
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while todo:
        depth, word, low, high, band = todo.pop()
        ended = size[low] == depth
        if ended.any():
            # The word that ends here comes first in its range
            w, t = word[ended], low[ended]
            off = size[w] - depth
            distance = np.where(np.abs(off) <= 1, band[np.clip(off, -1, 1) + 1, np.flatnonzero(ended)], 2)
            hit = (distance == 1) & (roles[w] + roles[t] < 2)
            out_word.append(w[hit])
            out_near.append(t[hit])
            low = low + ended
        more = low < high
        word, low, high, band = word[more], low[more], high[more], band[:, more]
        if not len(word):
            continue
        if depth not in heads:
            head = (size > depth) & (begins | (lcp <= depth))
            head_at = np.flatnonzero(head)
            heads[depth] = np.cumsum(head) - 1, np.append(head_at, n)
        node, head_at = heads[depth]
        c0 = node[low]
        # The last row of the range is longer than the prefix: ended words come first
        count = node[high - 1] - c0 + 1
        cuts = np.cumsum(count)
        blocks = np.searchsorted(cuts, np.arange(0, cuts[-1], _SCAN_STATES), side="right")
        blocks = np.unique(np.append(blocks, len(word)))
        for a, b in zip(blocks[:-1], blocks[1:], strict=True):
            parent = np.repeat(np.arange(a, b), count[a:b])
            child = np.arange(len(parent)) - np.repeat(cuts[a:b] - count[a:b] - (cuts[a - 1] if a else 0), count[a:b]) + c0[parent]
            start = head_at[child]
            end = np.minimum(head_at[child + 1], high[parent])
            w, old = word[parent], band[:, parent]
            said = codes[start, depth + 1]
            # Columns of the row are shifted by one: q[depth - 1], q[depth], q[depth + 1]
            at = np.minimum(np.arange(depth, depth + 3)[:, None], width + 2)
            differ = (codes[w, at] != said) | (codes[w, at] < 0)
            before = np.minimum(old[1] + 1, old[0] + differ[0])
            here = np.minimum(np.minimum(old[2], before) + 1, old[1] + differ[1])
            behind = np.minimum(here + 1, old[2] + differ[2])
            new = np.stack([before, here, behind])
            new[np.arange(depth, depth + 3)[:, None] > size[w]] = 2
            new = np.minimum(new, 2).astype(np.int8)
            alive = new.min(axis=0) < 2
            if alive.any():
                todo.append((depth + 1, w[alive], start[alive], end[alive], new[:, alive]))
    if not out_word:
        return none, none
    return np.concatenate(out_word), np.concatenate(out_near)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    cells = longest = 0

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        number, lists = -1, []
        for i, r in enumerate(rows):
            number += i == 0 or r[:3] != rows[i - 1][:3]
            lists.append(number)
        of = np.array(lists, dtype=np.int64)
        roles = np.array([len(r[4]) - r[0] for r in rows], dtype=np.int64)
        # A list of one word, or of longer words only, has no pair
        use = (np.bincount(of)[of] > 1) & (np.bincount(of[roles == 0], minlength=number + 1)[of] > 0) if rows else np.empty(0, bool)
        rows = [r for r, u in zip(rows, use.tolist(), strict=True) if u]
        w, t = near_in_lists([r[3] for r in rows], of[use], roles[use])
        w, t = w.tolist(), t.tolist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][4] for i in w], pa.string()),
                pa.array([rows[j][4] for j in t], pa.string()),
                pa.array([rows[j][5] for j in t], pa.int64()),
            ],
            names=["word", "near", "near_n"],
        )

    for batch in batches:
        columns = [batch[name].to_pylist() for name in ("m", "head", "tail", "zone", "word", "n")]
        for row in zip(*columns, strict=True):
            if held and row[:3] != held[-1][:3] and (len(held) + 1) * max(longest, len(row[3])) > _SCAN_CELLS:
                yield pairs(held)
                held, longest = [], 0
            held.append(row)
            longest = max(longest, len(row[3]))
    if held:
        yield pairs(held)
    give_back()


def _lists(words: DataFrame, min_length: int) -> DataFrame:
    """Each word in the lists of its first and its last half, once as the shorter and once as the longer of a pair."""
    m = F.explode(F.filter(F.array("l", F.col("l") - 1), lambda x: x >= min_length)).alias("m")
    roles = words.withColumn("l", F.char_length("word")).select("word", "n", "l", m)
    return _halves(roles.select("word", "n", "m", F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("zone")))


def _halves(lists: DataFrame) -> DataFrame:
    """The rows of lists, each in the two lists that share half of the rest as well."""
    free = lists.withColumn("free", F.col("m") - F.char_length("head") - F.char_length("tail"))
    front = F.ceil(F.col("free") / 2).cast("int")
    free = free.withColumn("front", front).withColumn("back", F.col("free") - F.col("front"))
    long = F.char_length("zone")
    first = F.struct(
        F.concat("head", F.substring("zone", F.lit(1), F.col("front"))).alias("head"),
        F.col("tail"),
        F.substring("zone", F.col("front") + 1, long).alias("zone"),
    )
    second = F.struct(
        F.col("head"),
        F.concat(F.substring("zone", long - F.col("back") + 1, F.col("back")), F.col("tail")).alias("tail"),
        F.substring("zone", F.lit(1), long - F.col("back")).alias("zone"),
    )
    return free.select("word", "n", "m", F.explode(F.array(first, second)).alias("x")).select("word", "n", "m", "x.head", "x.tail", "x.zone")


def near_words(words: DataFrame, min_length: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(word, near, near_n)`` for all ordered pairs of different words one edit apart; ``words`` has ``(word, n)``.

    Both must have at least ``min_length`` code points. A pair may come more than once.
    """
    key = ["m", "head", "tail"]
    lists = _lists(words, min_length)
    steps: list[DataFrame] = []
    while True:
        # A list whose words share all but one place is bounded by the alphabet
        free = F.col("m") - F.char_length("head") - F.char_length("tail")
        long = stored(lists.where(free > 1).groupBy(*key).count().where(F.col("count") > list_rows).select(*key), "long-lists")
        if long.isEmpty():
            release(long)
            break
        divided = _halves(lists.join(long, key, "left_semi").select("word", "n", *key, "zone"))
        kept, lists_before = lists.join(long, key, "left_anti").select("word", "n", *key, "zone"), lists
        lists = stored(kept.unionByName(divided), "lists")
        release(lists_before)
        steps.append(long)
    ordered = lists.select(*key, "zone", "word", "n").repartition(*key).sortWithinPartitions(*key, "zone")
    pairs = stored(ordered.mapInArrow(_scan, "word string, near string, near_n long"), "near-words")
    release(lists, *steps)
    return pairs


def spelling_groups(
    counts: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, list_rows: int = LIST_ROWS
) -> DataFrame:
    """For each word of ``(word, n)`` its near words, the form it is a variant of, and the root of its group.

    Words of at least ``min_length`` code points and ``min_count`` occurrences take part; counts of equal words are
    added up, null words and counts left out. Near words differ by one inserted, deleted or replaced code point. The form
    is the near word of largest count (ties: smallest in code-point order) if that is at least ``ratio`` times (more
    than once) the word's own, else null; ``root`` follows the forms to the last. Returns ``word, n, n_near, form,
    form_n, root``; other columns do not matter and no words give an empty table.
    """
    if ratio < 2 or min_length < 2:
        raise ValueError("ratio and min_length must be at least 2")
    words = counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = stored(words.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length)), "words")
    pairs = near_words(words, min_length, list_rows)
    # At most a few thousand near words per word: its length times the alphabet
    near = pairs.groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("less"), "near")).alias("found"))
    near = near.select("word", F.size("found").cast("long").alias("n_near"), F.array_min("found").alias("best"))
    best_n = -F.col("best.less")
    is_form = best_n >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, best_n).alias("form_n"),
    )
    judged = stored(judged, "forms")
    release(words, pairs)
    # Counts grow by the ratio from form to form, so the largest count bounds the way to the root
    most = judged.agg(F.max("n")).first()[0]
    steps = 0 if most is None else math.floor(math.log(max(most, 1), ratio)) + 1
    links = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links, before = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots"), links
        release(before)
    found = judged.join(links, "word", "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
