"""Removal of every byte covered by a long string that also stands elsewhere.

Candidates first, without loss: each window of ``size`` bytes is tied to the 32-byte gram in it with the smallest hash, and
windows tied to the same gram form a run. Equal windows are tied to equal grams at the same place in them, so only runs
whose gram (with what surrounds it in all windows of the run) stands more than once can hold a repeat. The bytes of such
runs are sorted in shards: the shard of a gram has all its runs, whichever documents they come from. A shard has a
suffix array, refined after Larsson and Sadakane, and Kasai's common prefixes tell which windows repeat in it. A gram
with too many different runs for one shard is cut into several; each sorts its distinct windows by a hash of 128 bits and
sends on packed slices of them, cut at equal steps of the hash, and where the slices of one step meet, the windows of each
shard are looked up in those of the others by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandnet.llm.storage import fresh_name, release, stored
from bandnet.llm.suffix_arrays import common_prefixes, prefix_ranks
from bandnet.llm.textbytes import WHITE, Hashes, column_bytes, give_back, keyed, mix, run_hashes, slices
from bandnet.llm.textbytes import runs as runs_of

GRAM = 32
SHARD_BYTES = 1_000_000


def _least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each place the place of the smallest hash among it and the ``width`` - 1 next, the first of equals."""
    n = len(hashes)
    bits = max(1, int(n).bit_length())
    mask = np.uint64((1 << bits) - 1)
    tagged = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width) + 1
    filled = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    filled[:n] = tagged
    table = filled.reshape(blocks, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)  # from a place to the end of its block
    behind = np.minimum.accumulate(table, axis=1).reshape(-1)  # from the start of the block to a place
    least = np.minimum(ahead[: n - width + 1], behind[width - 1 : n])
    return (least & mask).astype(np.int64)


def window_runs(data: np.ndarray, cuts: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Runs of windows tied to one gram: row, first and last start in it, key, and two hashes of all bytes of the run.

    A run is cut where windows stop to hold the bytes left of the gram, so that all windows of a part hold ``half``
    bytes on one side of the gram as well; the key is the hash of these.
    """
    gram = min(GRAM, size)
    n, half = len(data), (size - gram) // 2
    empty = {k: np.empty(0, np.int64) for k in ("row", "lo", "hi", "key", "one", "two")}
    if n < size:
        return empty
    sums = Hashes(data)
    places = np.arange(n - gram + 1)
    place = _least_places(sums.of(places, places + gram), size - gram + 1)  # of each window start
    starts = np.arange(len(place))
    row = np.searchsorted(cuts, starts, side="right") - 1
    whole = starts + size <= cuts[row + 1]
    starts, place, row = starts[whole], place[whole], row[whole]
    if not len(starts):
        return empty
    left = starts <= place - half
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (left[1:] != left[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    lo, hi, p, left, row = starts[first], starts[last], place[first], left[first], row[first]
    begin = np.where(left, p - half, p)
    end = np.where(left, p + gram, p + size - half)
    key = keyed(sums.of(begin, end), 1) ^ left.astype(np.uint64)
    flipped = Hashes(255 - data)
    shape = mix(((p - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
    one = sums.of(lo, hi + size) ^ shape
    two = keyed(flipped.of(lo, hi + size), 2) ^ shape
    origin = cuts[row]
    return {"row": row, "lo": lo - origin, "hi": hi - origin, "key": key.view(np.int64), "one": one.view(np.int64), "two": two.view(np.int64)}


RUN = "t binary, lo int, hi int, key long, one long, two long"


def _find_runs(size: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cuts = column_bytes(batch.column(1))
            for a, b in slices(cuts):
                found = window_runs(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], size)
                ids = batch.column(0).take(pa.array(found["row"] + a))
                arrays = [ids, pa.array(found["lo"].astype(np.int32)), pa.array(found["hi"].astype(np.int32))]
                arrays += [pa.array(found[k]) for k in ("key", "one", "two")]
                yield pa.RecordBatch.from_arrays(arrays, names=["t", "lo", "hi", "key", "one", "two"])

    return find


def _cut_runs(size: int):
    """Bytes of the wanted runs of each text: ``(text, runs)`` to one row for each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.encode()
                for w in wanted.as_py():
                    rows.append((w["key"], w["one"], w["two"], w["hi"] - w["lo"] + 1, raw[w["lo"] : w["hi"] + size]))
                    held += len(rows[-1][-1])
                if held > 2_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "one", "two", "n", "bytes"])

    return cut


PIECE = "key long, one long, two long, a int, b int"
#: A window of a slice: its hash, the run it is from, and its start in the run
_WINDOW = np.dtype([("hash", "S16"), ("one", "<i8"), ("two", "<i8"), ("start", "<i4")])


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Closed stretches of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _sort_shards(size: int):
    """Repeated windows of each shard, as stretches of starts in each run; of cut grams also slices of the distinct windows."""

    def one_shard(runs: list[tuple]) -> Iterator[tuple]:
        raw = np.frombuffer(b"".join(r[4] for r in runs), dtype=np.uint8)
        cuts = np.concatenate([[0], np.cumsum([len(r[4]) for r in runs])])
        counts = np.array([r[3] for r in runs])
        owner = np.repeat(np.arange(len(runs)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = cuts[owner] + within
        ends = np.repeat(cuts[1:], np.diff(cuts))
        order, shared = common_prefixes(raw, starts, prefix_ranks(raw, size), ends)
        flags = np.zeros(len(raw), dtype=bool)
        meet = np.flatnonzero(shared >= size)
        flags[order[meet]] = True
        flags[order[meet - 1]] = True
        distinct = np.zeros(len(raw), dtype=bool)
        distinct[order[shared < size]] = True
        windows: dict[int, list[tuple]] = {}
        for (key, one, two, n, _, steps), at in zip(runs, cuts[:-1].tolist(), strict=True):
            for a, b in _stretches(flags[at : at + n]):
                yield key, one, two, a, b, None, None
            if steps > 1:  # each distinct window once, for the other shards of the gram
                held = windows.setdefault(key, [steps])
                for s in np.flatnonzero(distinct[at : at + n]).tolist():
                    held.append((hashlib.blake2b(raw[at + s : at + s + size].tobytes(), digest_size=16).digest(), one, two, s))
        for key, (steps, *held) in windows.items():
            table = np.sort(np.array(held, dtype=_WINDOW), order="hash")
            step = _steps(table["hash"], steps)
            for first, last in zip(np.flatnonzero(np.diff(step, prepend=-1)).tolist(), np.flatnonzero(np.diff(step, append=steps)).tolist(), strict=True):
                yield key, None, None, None, None, int(step[first]), table[first : last + 1].tobytes()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, runs = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != shard and runs:
                    yield from _out(one_shard(runs))
                    runs = []
                shard = row[0]
                runs.append(row[1:])
        if runs:
            yield from _out(one_shard(runs))
        give_back()

    def _out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(found)
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
        for first in range(0, len(rows), 100_000):
            part = rows[first : first + 100_000]
            arrays = [pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "one", "two", "a", "b", "step", "slice"])

    return sort


def _steps(hashes: np.ndarray, steps: int) -> np.ndarray:
    """Which of ``steps`` equal parts of the hash's range each sorted hash is in."""
    front = np.array([int.from_bytes(h[:4].ljust(4, b"\0"), "big") for h in hashes.tolist()], dtype=np.int64)
    return (front * steps) >> 32


def _search_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices ``(key, step, slice)`` of one step after another to ``(key, one, two, starts)`` of windows that two shards have."""

    def search(key: int, slices_of: list[np.ndarray]) -> tuple[list, list, list, list]:
        every = np.sort(np.concatenate([t["hash"] for t in slices_of]))
        hits = []
        for table in slices_of:  # a slice has a window once: it stands elsewhere if the others add one
            times = np.searchsorted(every, table["hash"], side="right") - np.searchsorted(every, table["hash"], side="left")
            hits.append(table[times > 1])
        found = np.sort(np.concatenate(hits), order=["one", "two", "start"])
        new = np.concatenate([[True], (found["one"][1:] != found["one"][:-1]) | (found["two"][1:] != found["two"][:-1])])[: len(found)]
        first = np.flatnonzero(new)
        stops = np.append(first[1:], len(found))
        return (
            [key] * len(first), found["one"][first].tolist(), found["two"][first].tolist(),
            [found["start"][i:j].tolist() for i, j in zip(first.tolist(), stops.tolist(), strict=True)],
        )

    def out(key: int, held: list[np.ndarray]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        columns = search(key, held) if len(held) > 1 else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "one", "two", "starts"])

    at, held = None, []
    for batch in batches:
        for key, step, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != (key, step) and held:
                yield out(at[0], held)
                held = []
            at = (key, step)
            held.append(np.frombuffer(packed, dtype=_WINDOW))
    if held:
        yield out(at[0], held)
    give_back()


def _joined_starts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Starts in any order as the closed stretches that they make."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for column in columns:
        out = []
        for starts in column:
            s = np.unique(np.array(starts.as_py(), dtype=np.int64))
            cuts = np.flatnonzero(np.diff(s) > 1) + 1
            out.append([{"a": int(p[0]), "b": int(p[-1])} for p in np.split(s, cuts) if len(p)])
        yield pa.array(out, kind)


_joined_starts.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _removed(with_kept: bool):
    def remove(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, wholes, lists in columns:
            rows = []
            for text, whole, spans in zip(texts.to_pylist(), wholes.to_pylist(), lists, strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                if whole:
                    merged = [[0, len(raw)]]
                else:
                    for s in sorted((x["start"], x["end"]) for x in spans.as_py() or []):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                edges = [0, *(e for m in merged for e in m), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                             [{"start": a, "end": b} for a, b in merged], kept if with_kept else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.binary()]
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.StructArray.from_arrays(arrays, names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    remove.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(remove, RESULT).asNondeterministic()


#: Words of the grams that tie windows of words, and of the passages that documents are told to share
WORD_GRAM, PASSAGE_WORDS = 8, 51


def passage_cores(data: np.ndarray, cuts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the cores of all windows of ``words`` words.

    Each window is tied to the gram of words in it with the smallest hash; its core is that gram with as many words on the
    one side as half of the window's others. Equal windows have equal cores, and a core is more than half a window.
    """
    gram = min(WORD_GRAM, words)
    half = (words - gram) // 2
    starts, ends = runs_of(~WHITE[data], cuts)
    bounds = np.searchsorted(starts, cuts)
    said = run_hashes(data, starts, ends)
    n = len(said)
    if n < words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Grams of the whole slice; those that cross rows belong to no window
    total = np.zeros(n - gram + 1, dtype=np.uint64)
    for j in range(gram):
        total += keyed(said[j : n - gram + 1 + j], 31 + j)
    place = _least_places(mix(total), words - gram + 1)
    first = np.arange(len(place))
    row = np.searchsorted(bounds, first, side="right") - 1
    whole = first + words <= bounds[row + 1]
    first, place, row = first[whole], place[whole], row[whole]
    left = first <= place - half
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (left[1:] != left[:-1]) | (row[1:] != row[:-1])])[: len(place)]
    place, left, row = place[new], left[new], row[new]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(said), out=sums[1:])
    begin = np.where(left, place - half, place)
    # A sum of the words' hashes does not know their order: the gram's hash does, and the side
    core = keyed(sums[begin + half + gram] - sums[begin], 41) ^ keyed(mix(total[place]), 43) ^ left.astype(np.uint64)
    return row, core.view(np.int64)


def _find_cores(words: int):
    """``(t, x)`` to ``(t, core)``, each core of a text once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cuts = column_bytes(batch.column(1))
            for a, b in slices(cuts):
                row, core = passage_cores(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], words)
                order = np.lexsort((core, row))
                row, core = row[order], core[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (core[1:] != core[:-1])])[: len(row)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new] + a)), pa.array(core[new])], names=["t", "core"])
        give_back()

    return find


def text_number(text: Column) -> Column:
    """64 bits of a text's digest as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def shared_passages(docs: DataFrame, text: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """``(t, n)``: texts, by ``text_number``, that share passages with another row, and how many cores of passages that are.

    Every string of ``words`` words (what white space of ASCII separates, white space itself not counting) that another
    row has as well adds one core at least; rows that share no more than half as many words in a row have none. Rows
    with equal texts share all they have. Null and short texts share nothing; no rows give no rows.
    """
    said = docs.select(F.col(text).cast("string").alias("x")).where("x IS NOT NULL")
    numbered = said.select(text_number(F.col("x")).alias("t"), "x")
    cores = stored(numbered.mapInArrow(_find_cores(words), "t long, core long"), "cores")
    copies = numbered.select("t").groupBy("t").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("t")
    # Cores of two texts, and all cores of texts that several rows have
    met = cores.groupBy("core").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b").select("core")
    of_two = cores.join(met, "core", "left_semi").groupBy("t").agg(F.count_distinct("core").alias("n"))
    of_copies = cores.join(copies, "t", "left_semi").groupBy("t").agg(F.count_distinct("core").alias("n"))
    found = stored(of_two.union(of_copies).groupBy("t").agg(F.max("n").alias("n")), "shared-passages")
    release(cores)
    return found


def remove_repeats(docs: DataFrame, text: str = "text", size: int = 400, with_kept: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (bytes removed) and, on request, ``kept`` (bytes).

    A byte goes if a string of ``size`` (at least 40) bytes that covers it starts at another place too, in the same or in
    another document, judged on the texts as they are. Null texts count as empty; shorter texts lose nothing; a text of
    at least ``size`` bytes that several rows have goes altogether; strings never cross documents; an empty table gives
    an empty one; columns named like the new ones are replaced, all others stay.
    """
    if size < 40:
        raise ValueError("size must be at least 40")
    names = [f.split()[0] for f in RESULT.replace("array<struct<start:long,end:long>>", "array").split(", ")]
    docs = docs.drop(*names)
    t, whole, found, spans = fresh_name(docs, "t", "whole", "found", "spans_of")
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(said.cast("binary")))
    long_texts = docs.select(digest.alias("t"), said.alias("x")).where(F.octet_length("x") >= size)

    runs = stored(long_texts.mapInArrow(_find_runs(size), RUN), "runs")
    # Texts that several rows have, and the runs of each text once
    copies = docs.where(F.octet_length(said) >= size).groupBy(digest.alias("t")).agg(F.count(F.lit(1)).alias("rows"))
    copies = stored(copies.where("rows > 1").select("t"), "copies")
    several = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    flagged = stored(runs.join(several, "key").distinct(), "flagged")
    release(runs)
    # Runs that are alike throughout repeat altogether; of those that differ one each goes to the shards
    alike = flagged.groupBy("key", "one", "two").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("t", "lo", "hi")).alias("sample"), F.min("hi").alias("hi")
    )
    alike = stored(alike.select("key", "one", "two", "times", "sample.t", "sample.lo", "sample.hi"), "alike")
    different = alike.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("hi") - F.col("lo") + size).alias("bytes_of_key"))
    different = different.where("kinds > 1").select("key", "bytes_of_key")
    wanted = alike.join(different, "key")
    by_text = wanted.groupBy("t").agg(F.collect_list(F.struct("key", "one", "two", "lo", "hi")).alias("runs"))
    one_each = long_texts.join(by_text.withColumnRenamed("t", "wanted"), F.col("t") == F.col("wanted"), "inner")
    cut = one_each.dropDuplicates(["t"]).select("x", "runs").mapInArrow(_cut_runs(size), "key long, one long, two long, n int, bytes binary")
    # Shards of bounded size: light grams share one, a heavy gram has several
    total = different.agg(F.sum("bytes_of_key")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    cut = cut.join(different, "key")
    heavy = F.col("bytes_of_key") > shard_bytes
    parts = F.ceil(F.col("bytes_of_key") / shard_bytes)
    shard = F.when(heavy, F.xxhash64("key", F.pmod(F.col("one"), parts))).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    steps = F.when(heavy, parts).otherwise(1).cast("int")
    cut = cut.select(shard.alias("shard"), "key", "one", "two", "n", "bytes", steps.alias("steps"))
    pieces = cut.repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(_sort_shards(size), f"{PIECE}, step int, slice binary")
    pieces = stored(pieces, "pieces")
    # Slices of one gram and step meet; each is as large as a shard's share of a step
    slices_of = pieces.where("slice IS NOT NULL").select("key", "step", "slice").repartition("key", "step").sortWithinPartitions("key", "step")
    across = slices_of.mapInArrow(_search_slices, "key long, one long, two long, starts array<int>")
    across = across.groupBy("key", "one", "two").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    joined_starts = F.arrow_udf(_joined_starts, "array<struct<a: int, b: int>>").asNondeterministic()
    across = across.select("key", "one", "two", joined_starts("starts").alias("found")).select("key", "one", "two", F.inline("found"))
    stretches = pieces.where("slice IS NULL").select("key", "one", "two", "a", "b").union(across)
    # From the kinds of runs to their places
    placed = flagged.join(stretches, ["key", "one", "two"]).select("t", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + size).alias("end"))
    throughout = flagged.join(alike.where("times > 1").select("key", "one", "two"), ["key", "one", "two"])
    placed = placed.union(throughout.select("t", F.col("lo").alias("start"), (F.col("hi") + size).alias("end")))
    by_text = placed.groupBy("t").agg(F.collect_set(F.struct("start", "end")).alias(spans)).withColumnRenamed("t", t)
    by_text = by_text.join(copies.select(F.col("t").alias(t), F.lit(True).alias(whole)), t, "full")
    by_text = stored(by_text, "removals")
    release(copies, flagged, alike, pieces)
    (joined_t,) = fresh_name(by_text, "joined_t")
    joined = docs.withColumn(joined_t, digest).join(by_text, F.col(joined_t) == F.col(t), "left")
    out = joined.withColumn(found, _removed(with_kept)(F.col(text).cast("string"), F.coalesce(F.col(whole), F.lit(False)), F.col(spans)))
    return out.select(*docs.columns, *[F.col(f"{found}.{n}").alias(n) for n in names if n != "kept" or with_kept])
