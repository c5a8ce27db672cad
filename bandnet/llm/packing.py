"""Best-fit packing of token pieces into sequences, after a dominance reduction.

Pieces of the same length are interchangeable, so the whole instance is the number of pieces of each length: at most
``capacity`` numbers, however many documents there are. The plan is made from these numbers alone, with multiplicities.
Sets that provably dominate every alternative (Martello and Toth) are fixed first; what remains is packed best fit, in
decreasing order. Each piece then finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandnet.llm.storage import fresh_name, stored
from bandnet.llm.textbytes import column_bytes, give_back, run_hashes, runs, slices

WORD_MEMORY = 800_000
JOINED = 256


class PackingPlan:
    """Where pieces go: stretches of ranks of one length, each filling bins one after the other."""

    def __init__(self, counts: dict[int, int], capacity: int):
        if any(n and not 0 < length <= capacity for length, n in counts.items()):
            raise ValueError("lengths must be between 1 and the capacity")
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.total = self.left.copy()
        self.bins = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, count, first bin, per bin, offset
        self._reduce()
        self.fixed_bins = self.bins
        self._best_fit()

    def _place(self, length: int, count: int, first_bin: int, per_bin: int, offset: int) -> None:
        rank = int(self.total[length] - self.left[length])
        self.rows.append((length, rank, count, first_bin, per_bin, offset))
        self.left[length] -= count

    def _dominating(self, j: int) -> tuple[int, ...] | None:
        """Lengths to go with one piece of length j in a set that no other set with j can beat, or None."""
        room = self.capacity - j
        self.left[j] -= 1
        others = np.flatnonzero(self.left)
        copies = self.left[others]
        self.left[j] += 1
        others, copies = others[others <= room], copies[: np.searchsorted(others, room, side="right")]
        if not len(others):
            return ()
        best = int(others[-1])
        if best == room:
            return (best,)
        small = np.repeat(others[:3], np.minimum(copies[:3], 3))[:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return (best,)
        if len(small) < 3 or small.sum() > room:  # at most two more fit: the best two against the best one
            partner = np.searchsorted(others, room - others, side="right") - 1
            lone = (partner == np.arange(len(others))) & (copies < 2)
            partner = partner - lone
            sums = np.where(partner >= 0, others + others[np.maximum(partner, 0)], 0)
            if best >= sums.max():
                return (best,)
        return None

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[j] and (chosen := self._dominating(j)) is not None:
                    together = int(self.left[j])
                    if chosen:
                        # Repeating the set is sound while both lengths last: the rest can only shrink
                        together = together // 2 if chosen[0] == j else min(together, int(self.left[chosen[0]]))
                    self._place(j, together, self.bins, 1, 0)
                    for length in chosen:
                        self._place(length, together, self.bins, 1, j)
                    self.bins += together
                    changed = True

    def _best_fit(self) -> None:
        rooms: list[int] = []  # sorted, without repeats
        groups: dict[int, list[tuple[int, int]]] = {}  # room: (first bin, bins)

        def put(room: int, first: int, bins: int) -> None:
            if bins and room:
                if room not in groups:
                    insort(rooms, room)
                    groups[room] = []
                groups[room].append((first, bins))

        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length]:
                n = int(self.left[length])
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    bins = -(-n // (self.capacity // length))
                    put(self.capacity, self.bins, bins)
                    self.bins += bins
                    continue
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                per_bin = min(room // length, n)
                full = min(bins, n // per_bin)
                self._place(length, full * per_bin, first, per_bin, self.capacity - room)
                put(room - per_bin * length, first, full)
                put(room, first + full, bins - full)

    def arrays(self) -> dict[str, np.ndarray]:
        """The stretches, sorted by their place in the line of all pieces by length and rank."""
        base = np.concatenate([[0], np.cumsum(self.total)])
        rows = np.array(self.rows, dtype=np.int64).reshape(-1, 6)
        key = base[rows[:, 0]] + rows[:, 1]
        order = np.argsort(key)
        rows = rows[order]
        return {"base": base, "key": key[order], "bin": rows[:, 3], "per_bin": rows[:, 4], "offset": rows[:, 5], "length": rows[:, 0]}


def pack_best_fit(pieces: DataFrame, length: str = "length", capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (longs): each sequence holds at most ``capacity``, gapless from offset 0.

    Lengths are integers from 1 to ``capacity`` (others, null included, are an error). Only the counts by length (at most
    ``capacity`` rows) reach the driver and only the plan made from them is broadcast. A length that many pieces share
    is ranked within partitions, so no task holds it whole. Repeated rows are pieces of their own; an empty table gives
    an empty one; columns named sequence_id or offset are replaced, all others stay.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    part, rank, before, n, found = fresh_name(pieces, "part", "rank", "before", "n", "found")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        number = TaskContext.get().partitionId()
        for batch in batches:
            column = batch.column(columns.index(length))
            if column.null_count:
                raise ValueError("lengths must not be null")
            lengths = np.asarray(column, dtype=np.int64)
            if len(lengths) and not (lengths.min() > 0 and lengths.max() <= capacity):
                raise ValueError("lengths must be between 1 and the capacity")
            order = np.argsort(lengths, kind="stable")
            sorted_lengths = lengths[order]
            first = np.searchsorted(sorted_lengths, sorted_lengths, side="left")
            ranks = np.empty(len(lengths), dtype=np.int64)
            ranks[order] = seen[sorted_lengths] + np.arange(len(lengths)) - first
            seen += np.bincount(lengths, minlength=capacity + 1)
            parts = pa.array(np.full(len(lengths), number, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(ranks)], names=[*columns, part, rank])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    laid = stored(pieces.mapInArrow(ranked, f"{fields}, `{part}` int, `{rank}` long"), "pieces")
    counts = laid.groupBy(part, length).agg(F.count(F.lit(1)).alias(n))
    plan = PackingPlan({r[0]: r[1] for r in counts.groupBy(length).agg(F.sum(n)).collect()}, capacity)
    earlier = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, length, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    known = laid.sparkSession.sparkContext.broadcast(plan.arrays())

    def place(arguments: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        p = known.value
        for lengths, ranks in arguments:
            lengths, ranks = np.asarray(lengths, dtype=np.int64), np.asarray(ranks, dtype=np.int64)
            key = p["base"][lengths] + ranks
            row = np.searchsorted(p["key"], key, side="right") - 1
            within = key - p["key"][row]
            sequence = p["bin"][row] + within // p["per_bin"][row]
            offset = p["offset"][row] + within % p["per_bin"][row] * lengths
            yield pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    place.__annotations__ = {"arguments": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(place, "sequence_id long, offset long")
    placed = laid.join(counts, [part, length]).withColumn(found, udf(F.col(length), F.col(rank) + F.col(before)))
    return placed.select(*columns, F.col(f"{found}.sequence_id").alias("sequence_id"), F.col(f"{found}.offset").alias("offset"))


class WordEncoder:
    """Token ids of texts, word by word.

    The tokenizer splits at white space and never joins across it, so the ids of a text are those of its words. Words are
    hashed as bytes; the ids of a word seen before are looked up by its hash, those of new words are encoded many at a
    time, with a control character between that is a token of its own.
    """

    MARK = "\x01"

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        mark = self.tokenizer.encode(f"a {self.MARK} a", add_special_tokens=False).ids
        self.mark_id = mark[1] if len(mark) == 3 and mark[0] == mark[2] else None
        self._forget()

    def _forget(self) -> None:
        # A large sorted table of hashes and a small one of late comers; the ids of all words end to end
        self.tables = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2)]
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        plain = [w for w in words if self.mark_id is not None and "<" not in w and self.MARK not in w]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        joined = self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(g) for g in groups], add_special_tokens=False)
        found: dict[str, np.ndarray] = {}
        for group, encoding in zip(groups, joined, strict=True):
            ids = np.array(encoding.ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            found.update(zip(group, (ids[i:j] for i, j in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)), strict=True))
        alone = [w for w in words if w not in found]
        for word, encoding in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            found[word] = np.array(encoding.ids, dtype=np.uint32)
        return [found[w] for w in words]

    def _rows(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known words by their sorted hashes, -1 for others."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for keys, rows in self.tables:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, rows[at], out)
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        rows = np.arange(len(self.begin), len(self.begin) + len(words))
        encoded = self._encoded(words)
        sizes = np.array([len(e) for e in encoded], dtype=np.int32)
        flat = np.concatenate(encoded)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(flat)
        large, late = self.tables
        late = (np.concatenate([late[0], hashes]), np.concatenate([late[1], rows]))
        if len(late[0]) > 50_000 + len(large[0]) // 4:
            late, large = (late[0][:0], late[1][:0]), (np.concatenate([large[0], late[0]]), np.concatenate([large[1], late[1]]))
            order = np.argsort(large[0])
            large = (large[0][order], large[1][order])
        order = np.argsort(late[0])
        self.tables = [large, (late[0][order], late[1][order])]
        return rows

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are bytes end to end, and the cuts between the texts' ids."""
        starts, ends = runs((data != 0x20) & (data != 0x0A), cuts)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(cuts), np.int64)
        hashes, first, word = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.begin) > WORD_MEMORY:
            self._forget()
        rows = self._rows(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = data.tobytes()
            at = first[new]
            said = [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            rows[new] = self._learn(hashes[new], said)
        rows = rows[word]
        sizes = self.size[rows].astype(np.int64)
        until = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(self.begin[rows] - until[:-1], sizes) + np.arange(until[-1])
        return self.ids[where], until[np.searchsorted(starts, cuts)]


def token_pieces(
    docs: DataFrame,
    tokenizer_json: str,
    keys: list[str],
    text: str = "text",
    end_id: int = 1,
    capacity: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the key columns, ``piece`` (int), ``start``, ``length``, ``ids_crc32`` (longs), on request ``ids``.

    A document is its token ids followed by ``end_id``; only a longer one than ``capacity`` is cut, into pieces of that
    length and a rest. ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers. Null and empty texts are
    ``end_id`` alone. Key columns may hold nulls and repeats.
    """
    chosen = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text_to_encode"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = [*keys, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A Python worker serves many tasks; the words it has looked up stay with the process
        kept = sys.modules.setdefault("bandnet_worker_memory", ModuleType("bandnet_worker_memory")).__dict__
        name = f"words-{zlib.crc32(vocabulary.value.encode())}"
        if name not in kept:
            kept[name] = WordEncoder(vocabulary.value)
        encoder = kept[name]
        for whole in batches:
            data, cuts = column_bytes(whole.column(len(keys)))
            for a, b in slices(cuts):
                ids, ends = encoder.encode(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
                ids = np.insert(ids, ends[1:], end_id).astype("<u4")
                ends = ends + np.arange(len(ends))
                count = -(-np.diff(ends) // capacity)
                source = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(ends)[source] - start)
                begin = ends[source] + start
                stretches = list(zip(begin.tolist(), (begin + length).tolist(), strict=True))
                crc = [zlib.crc32(ids[i:j]) for i, j in stretches]
                rows = whole.slice(a, b - a).take(pa.array(source))
                arrays = [*rows.columns[: len(keys)], pa.array(piece.astype(np.int32))]
                arrays += [pa.array(v, pa.int64()) for v in (start, length, crc)]
                if with_ids:
                    arrays.append(pa.array([ids[i:j].view("<i4") for i, j in stretches], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    schema = f"{fields}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return chosen.mapInArrow(pieces, schema)
