"""Benchmark decontamination: Wu-Manber search for many windows of benchmark words at once.

Texts and benchmark items become rows of word hashes. A shift table over blocks of two words tells how far a cursor can
move on without passing the end of any window; where the shift is 0, the hash of the window's words picks the bucket of
test windows, and the words themselves are compared. All cursors of a slice of texts move together in numpy. Windows of
other lengths (items shorter than a window) have tables of their own.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.llm.storage import fresh_name, stored
from bandnet.llm.textbytes import byte_table, column_bytes, keyed, mix, run_hashes, runs, slices, windows

# Fixed value: ASCII digits and letters and everything beyond ASCII make words
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK_WORDS = 256


def text_words(text: str | None) -> list[str]:
    """The lower-cased words of a text, as the search sees them."""
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(WORD_PATTERN, lowered)


class WindowTables:
    """Shift table and buckets for all windows of one length.

    Items are arrays of word numbers end to end, of which a window is a place: it costs a few numbers, whatever its
    length. The shift table has 16 slots for each word of a window and 2^26 at most; beyond that shifts get shorter and
    the search slower, not other.
    """

    def __init__(self, length: int, vocabulary: list[str], hashes: np.ndarray, items: list[tuple[int, np.ndarray]]):
        self.length, self.block, self.vocabulary = length, min(2, length), vocabulary
        self.words = np.concatenate([w for _, w in items])
        bounds = np.concatenate([[0], np.cumsum([len(w) for _, w in items])])
        words = hashes[self.words]
        found, self.starts = windows(words, bounds, length)
        self.owners = np.array([n for n, _ in items], dtype=np.int64)[np.searchsorted(bounds, self.starts, side="right") - 1]
        bits = max(12, int(np.ceil(np.log2(16 * len(self.starts) * length + 1))))
        self.mask = np.uint64((1 << min(bits, 26)) - 1)
        self.shift = np.full(int(self.mask) + 1, length - self.block + 1, dtype=np.int8 if length < 127 else np.int32)
        for end in range(self.block - 1, length):
            slots = self._slot(words[self.starts + end - self.block + 1], words[self.starts + end])
            np.minimum.at(self.shift, slots, length - 1 - end)
        self.order = np.argsort(found, kind="stable")
        self.hashes = found[self.order]

    def said(self, number: int) -> list[str]:
        """The words of a window."""
        start = self.starts[number]
        return [self.vocabulary[i] for i in self.words[start : start + self.length].tolist()]

    def _slot(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        both = keyed(first, 1) + last if self.block == 2 else last
        return (mix(both) & self.mask).astype(np.int64)

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows whose hash is in a bucket, with the place of the bucket's first entry."""
        first, stop = bounds[:-1] + self.length - 1, bounds[1:]  # where windows can end
        pieces = np.maximum(0, -(-(stop - first) // CHUNK_WORDS))
        row = np.repeat(np.arange(len(pieces)), pieces)
        step = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cursor = first[row] + step * CHUNK_WORDS
        limit = np.minimum(stop[row], cursor + CHUNK_WORDS)
        found = []
        while len(cursor):
            jump = self.shift[self._slot(words[cursor - self.block + 1], words[cursor])].astype(np.int64)
            zero = jump == 0
            if zero.any():
                found.append(cursor[zero])
                jump[zero] = 1
            cursor = cursor + jump
            alive = cursor < limit
            cursor, limit = cursor[alive], limit[alive]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.sort(np.concatenate(found)) - self.length + 1
        gathered = words[starts[:, None] + np.arange(self.length)].reshape(-1)
        hashes, _ = windows(gathered, np.arange(0, len(gathered) + 1, self.length), self.length)
        bucket = np.searchsorted(self.hashes, hashes)
        hit = (bucket < len(self.hashes)) & (self.hashes[np.minimum(bucket, len(self.hashes) - 1)] == hashes)
        return starts[hit], bucket[hit]


def build_tables(texts: list[str], window: int) -> list[WindowTables]:
    """Tables for each window length that occurs; owners are positions in ``texts``."""
    numbers: dict[str, int] = {}
    by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for number, text in enumerate(texts):
        words = text_words(text)
        if words:
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
            by_length[min(window, len(words))].append((number, ids))
    vocabulary = list(numbers)
    encoded = [w.encode() for w in vocabulary]
    ends = np.cumsum([len(w) for w in encoded], dtype=np.int64)
    data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    hashes = run_hashes(data, ends - [len(w) for w in encoded], ends) if encoded else np.empty(0, np.uint64)
    return [WindowTables(length, vocabulary, hashes, items) for length, items in sorted(by_length.items())]


RESULT = "n_words long, items array<int>, hits array<struct<first:long,last:long,start:long,end:long>>"
_HIT = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])


def search_slice(data: np.ndarray, cuts: np.ndarray, tables: list[WindowTables]) -> list[tuple[int, list[int], list[dict]]]:
    """For each row: its number of words, the owners of the windows found in it, and the maximal runs of hit words."""
    lowered = _LOWER[data]
    starts, ends = runs(WORD_BYTES[data], cuts)
    bounds = np.searchsorted(starts, cuts)
    words = run_hashes(lowered, starts, ends)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    owners: dict[int, set[int]] = defaultdict(set)
    for table in tables:
        places, buckets = table.candidates(words, bounds)
        rows = np.searchsorted(bounds, places, side="right") - 1
        for place, bucket, row in zip(places.tolist(), buckets.tolist(), rows.tolist(), strict=True):
            said = [bytes(lowered[starts[i] : ends[i]]).decode("utf-8", "replace") for i in range(place, place + table.length)]
            key = table.hashes[bucket]
            same = 0
            while bucket < len(table.hashes) and table.hashes[bucket] == key:
                number = table.order[bucket]
                if table.said(number) == said:
                    same = 1
                    owners[row].add(int(table.owners[number]))
                bucket += 1
            change[place] += same
            change[place + table.length] -= same
    hit = np.cumsum(change[:-1]) > 0
    first, last = runs(hit, bounds)
    counts = np.diff(bounds)
    hit_rows = np.searchsorted(bounds, first, side="right") - 1
    spans: dict[int, list[dict]] = defaultdict(list)
    if len(first):
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        for row, a, b in zip(hit_rows.tolist(), first.tolist(), last.tolist(), strict=True):
            origin = points[cuts[row]]
            spans[row].append({
                "first": a - int(bounds[row]), "last": b - int(bounds[row]),
                "start": int(points[starts[a]] - origin), "end": int(points[ends[b - 1]] - origin),
            })
    return [(int(counts[r]), sorted(owners.get(r, ())), spans.get(r, [])) for r in range(len(counts))]


def _worker_tables(name: str, texts, window: int) -> list[WindowTables]:
    """The tables of a block, built once by each Python worker, which serves many tasks; it keeps those of one block."""
    kept = sys.modules.setdefault("bandnet_worker_tables", ModuleType("bandnet_worker_tables")).__dict__
    if name not in kept:
        for other in [k for k in kept if k.startswith("tables-")]:
            del kept[other]
        kept[name] = build_tables(texts.value, window)
    return kept[name]


def _scanner(texts, window: int) -> Callable:
    """A scalar Arrow function over a text column; ``texts`` is a broadcast list of item texts."""
    name = f"tables-{uuid.uuid4().hex}"

    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = _worker_tables(name, texts, window)
        for column in columns:
            data, cuts = column_bytes(column)
            rows = []
            for a, b in slices(cuts):
                rows += search_slice(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], tables)
            yield pa.StructArray.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[2] for r in rows], pa.list_(_HIT)),
                ],
                names=["n_words", "items", "hits"],
            )

    scan.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return scan


def _item_blocks(items: DataFrame, item_id: str, item_text: str, window: int, block_chars: int) -> Iterator[tuple[list[str], list[str]]]:
    """Item ids and texts in blocks of about ``block_chars`` characters; a longer item is cut with overlap."""
    ids, texts, size = [], [], 0
    chosen = items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string"))
    for name, text in chosen.where(F.col(item_id).isNotNull()).toLocalIterator():
        words = text_words(text) if text and len(text) > block_chars else None
        step = max(1, block_chars // 8)
        parts = [text or ""] if words is None else [
            " ".join(words[i : i + step + window - 1]) for i in range(0, max(1, len(words) - window + 1), step)
        ]
        for part in parts:
            if ids and size + len(part) > block_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(name)
            texts.append(part)
            size += len(part)
    if ids:
        yield ids, texts


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` (ids as strings, in string order) and ``hits`` to every document.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window; without words it has
    none. Words of a document inside any occurrence of a window are hit. ``hits`` are the maximal runs of hit words:
    their first and last + 1 word, and their first and last + 1 code point in the text.

    Items are read to the driver block by block (``block_chars`` characters at a time) and each block is broadcast; a
    benchmark of several blocks costs one pass over the documents each and their hits are united, so every window
    counts whatever the size. Null texts have no words; items without an id cannot be named and are left out; items
    that share an id count once; documents that are alike are scored alike; an empty table on either side is fine.
    Columns of the documents with the names of the new ones are replaced, all others stay.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "items", "hits")
    (found,) = fresh_name(docs, "found")
    blocks = _item_blocks(items, item_id, item_text, window, block_chars)
    current, following = next(blocks, ([], [])), next(blocks, None)

    def scanned(table: DataFrame, block: tuple[list[str], list[str]]) -> DataFrame:
        udf = F.arrow_udf(_scanner(spark.sparkContext.broadcast(block[1]), window), RESULT).asNondeterministic()
        names = F.array(*[F.lit(x) for x in block[0]]) if len(block[0]) <= 500 else None
        table = table.withColumn(found, udf(F.col(text).cast("string")))
        if names is None:
            names = _named(spark.sparkContext.broadcast(block[0]))(F.col(f"{found}.items"))
        else:
            names = F.transform(F.col(f"{found}.items"), lambda i: F.element_at(names, i + 1))
        return table.withColumn("items", F.array_sort(F.array_distinct(names)))

    n_hit = lambda hits: F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    if following is None:
        out = scanned(docs, current)
        hits = F.col(f"{found}.hits")
        return out.select(*docs.columns, F.col(f"{found}.n_words").alias("n_words"), n_hit(hits).alias("n_hit"), "items", hits.alias("hits"))

    # Several blocks: one pass each over the stored documents, then the hits of a document are united
    (row,) = fresh_name(docs, "row")
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "contamination-rows")
    passes, block = [], current
    while block is not None:
        one = scanned(kept, block).select(row, F.col(f"{found}.n_words").alias("n_words"), "items", F.col(f"{found}.hits").alias("hits"))
        passes.append(stored(one, "contamination-pass"))
        block, following = following, next(blocks, None)
    united = passes[0]
    for one in passes[1:]:
        united = united.unionByName(one)
    united = united.groupBy(row).agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
    )

    def joined(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
        )
        apart = (F.size(done) == 0) | (x["first"] > F.get(done, F.size(done) - 1)["last"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))

    empty = F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>")
    united = united.withColumn("hits", F.aggregate("hits", empty, joined)).withColumn("n_hit", n_hit(F.col("hits")))
    return kept.join(united, row).select(*docs.columns, "n_words", "n_hit", "items", "hits")


def _named(ids) -> Callable:
    """Ids of a large block by their numbers."""

    def names(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(ids.value, pa.string())
        for column in columns:
            values = known.take(column.flatten())
            yield pa.ListArray.from_arrays(np.asarray(column.offsets) - column.offsets[0].as_py(), values)

    names.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(names, "array<string>")
