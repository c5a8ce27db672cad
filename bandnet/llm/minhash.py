"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its five-word shingles. The weight axis of every shingle is cut at 1, 2, 4, 8, ...; each
stretch has Poisson processes of its own, one for each slot of the signature, drawn as one process whose points choose a
slot. A text sees the points below its weight; in the stretch that its weight ends in, points are placed by halving and
those above are left out. The earliest point of a slot is the signature there, and two texts agree in a slot with the
probability of their weighted Jaccard similarity. Points later than what fills the signature are never drawn.

Texts that share a band are candidates. In each bucket a few hubs are compared with all members, never all with all:
see ``_link_buckets`` for why no class is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandnet.llm.components import connected_components
from bandnet.llm.storage import fresh_name, release, stored
from bandnet.llm.textbytes import WHITE, column_bytes, give_back, keyed, mix, run_hashes, runs, slices, windows

# 56 bands of 8: texts of similarity 0.8 share one but for 1 pair in 30,000, texts of 0.25 do in 1 of 1,200
SHINGLE, SLOTS, BAND_ROWS, THRESHOLD = 5, 448, 8, 0.8
BITMAP_WORDS, COARSE_WORDS = 32, 4
MARKS = 1 << 24
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, cuts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shingle hashes, sorted by row and hash. A row of fewer words, but not none, is one shingle."""
    starts, ends = runs(~WHITE[data], cuts)
    bounds = np.searchsorted(starts, cuts)
    words = run_hashes(data, starts, ends)
    found, first = windows(words, bounds, width)
    rows = np.searchsorted(bounds, first, side="right") - 1
    counts = np.diff(bounds)
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            taken = words[bounds[short][:, None] + np.arange(n)].reshape(-1)
            found = np.concatenate([found, keyed(windows(taken, np.arange(0, len(taken) + 1, n), n)[0], n)])
            rows = np.concatenate([rows, short])
    order = np.lexsort((found, rows))
    return rows[order], found[order]


def occurrences(rows: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    """For each shingle how often its row had it before: with it, a multiset is a set."""
    if not len(rows):
        return np.empty(0, np.int64)
    fresh = np.concatenate([[True], (rows[1:] != rows[:-1]) | (sorted_hashes[1:] != sorted_hashes[:-1])])
    at = np.arange(len(rows))
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


def bag_signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, count: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (count, slots) of rows of weighted elements; infinity throughout for a row without elements."""
    signature = np.full((count, slots), np.inf)
    totals = np.bincount(rows, weights=weights, minlength=count)
    level = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)  # the last stretch each element reaches
    repeat = level + 1
    element = np.repeat(np.arange(len(rows)), repeat)
    stretch = np.arange(len(element)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    low = np.where(stretch > 0, 2.0 ** (stretch - 1), 0.0)
    width = np.where(stretch > 0, low, 1.0)
    share = np.minimum(1.0, (weights[element] - low) / width)
    seeds = keyed(hashes[element], 11) + stretch.astype(np.uint64) * _STEP
    row = rows[element]
    horizon = np.where(totals > 0, (np.log(slots) + 3) / np.maximum(totals, 1e-300), 0.0)
    todo = totals > 0
    while todo.any():
        active = np.flatnonzero(todo[row])
        time = np.zeros(len(active))
        at, chunk = 0, 1
        while len(active):
            draws = mix(seeds[active][:, None] + np.arange(at + 1, at + chunk + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            gaps = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            times = time[:, None] + np.cumsum(gaps / (width[active] * slots)[:, None], axis=1)
            placed = keyed(draws, 5)
            position = (placed >> np.uint64(11)).astype(np.float64) * 2.0**-53  # its bits are the halvings
            good = (times <= horizon[row[active]][:, None]) & (position < share[active][:, None])
            which, step = np.nonzero(good)
            slot = (placed[which, step] & np.uint64(0x7FF)).astype(np.int64) % slots
            np.minimum.at(signature, (row[active[which]], slot), times[which, step])
            time = times[:, -1]
            going = time <= horizon[row[active]]
            active, time = active[going], time[going]
            at, chunk = at + chunk, min(2 * chunk, 64)
        todo &= ~np.isfinite(signature).all(axis=1)
        horizon = np.where(todo, horizon * 2, horizon)
    return signature


def band_keys(signature: np.ndarray, rows_per_band: int = BAND_ROWS) -> np.ndarray:
    """64-bit keys (rows, bands), different from band to band."""
    bits = signature.view(np.uint64).reshape(len(signature), signature.shape[1] // rows_per_band, rows_per_band)
    key = np.zeros(bits.shape[:2], dtype=np.uint64)
    for j in range(rows_per_band):
        key = mix(key * _STEP + bits[:, :, j])
    return mix(key + np.arange(bits.shape[1], dtype=np.uint64) * _STEP).view(np.int64)


def _bands(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        data, cuts = column_bytes(column)
        keys, sizes = [], []
        for a, b in slices(cuts):
            rows, found = shingles(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            repeats = occurrences(rows, found)
            last = np.concatenate([repeats[1:] == 0, [True]])[: len(rows)]
            signature = bag_signatures(rows[last], found[last], (repeats[last] + 1).astype(float), b - a)
            full = np.isfinite(signature[:, 0])
            keys.append(band_keys(signature[full]).reshape(-1))
            sizes.append(np.where(full, SLOTS // BAND_ROWS, 0))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        values = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
    give_back()


def _bags(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A text as the sorted hashes of its shingles, each counted with its occurrence, packed; how many; a bitmap of them."""
    for column in columns:
        data, cuts = column_bytes(column)
        out, sizes, bitmaps, small = [], [], [], []
        for a, b in slices(cuts):
            rows, found = shingles(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            named = keyed(found, 3) + mix(occurrences(rows, found).astype(np.uint64)) * _STEP
            order = np.lexsort((named, rows))
            ends = np.searchsorted(rows, np.arange(b - a + 1))
            named = named[order]
            out += [named[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            sizes.append(np.diff(ends))
            bits = np.zeros((b - a, 64 * BITMAP_WORDS), dtype=bool)
            bits[rows, (named & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64)] = True
            bitmaps.append(np.packbits(bits, axis=1).reshape(-1).view(np.int64))
            # The same bits laid over one another
            folded = bits.reshape(b - a, -1, 64 * COARSE_WORDS).any(axis=1)
            small.append(np.packbits(folded, axis=1).reshape(-1).view(np.int64))
        arrays = [pa.array(out, pa.binary()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())]
        for words, maps in ((BITMAP_WORDS, bitmaps), (COARSE_WORDS, small)):
            offsets = np.arange(len(out) + 1, dtype=np.int32) * words
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(maps) if maps else np.empty(0, np.int64))))
        yield pa.StructArray.from_arrays(arrays, names=["bag", "size", "bits", "coarse"])


def _overlap(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Weighted Jaccard similarity of two packed bags."""
    for left, right in columns:
        out = []
        for a, b in zip(left, right, strict=True):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out.append(shared / (len(both) - shared) if len(both) else 0.0)
        yield pa.array(out, pa.float64())


def _udf(function, kind: str, several: bool = False):
    inner = Iterator[tuple[pa.Array, pa.Array]] if several else Iterator[pa.Array]
    function.__annotations__ = {"columns": inner, "return": Iterator[pa.Array]}
    return F.arrow_udf(function, kind).asNondeterministic()


def _may_link(threshold: float):
    """Whether two bags, as columns ``size``/``coarse``/``bits`` and the same of the hub, can reach the threshold.

    A bit that only one bag has set is an element that the other lacks, which bounds what they can share. Sizes and the
    few words of the coarse bitmap settle most pairs; only the others have all their bits counted. That is a loop over
    the arrays: written out it would be a method too long for the JVM to compile.
    """
    size, hub_size = F.col("size"), F.col("hub_size")
    alike = F.least(size, hub_size) >= threshold * F.greatest(size, hub_size) - 1e-6
    wanted = threshold / (1 + threshold) * (size + hub_size) - 1e-6
    only = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))
    few = lambda one, other: sum((only(F.get(one, F.lit(i)), F.get(other, F.lit(i))) for i in range(COARSE_WORDS)), start=F.lit(0))
    all_ = lambda one, other: F.aggregate(F.zip_with(one, other, only), F.lit(0), lambda n, x: n + x)
    for lacks, name in ((few, "coarse"), (all_, "bits")):
        mine, hubs = F.col(name), F.col(f"hub_{name}")
        alike = alike & (F.least(size - lacks(mine, hubs), hub_size - lacks(hubs, mine)) >= wanted)
    return alike


def _link_buckets(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """``(node, label)`` of linked nodes; members are ``(node, weight, held)``, bags ``(node, bag, size, bits, coarse)``.

    ``held`` are a node's buckets, one for each band at most, as an array: sketches and classes are joined to nodes and
    only then spread over buckets. Round by round some members of a bucket become hubs and are compared with the others
    of it, the heaviest first: a text that meets many others in large buckets is likely to be what they are copies of.
    After that a hub has met all of its bucket and leaves it. Classes grow by the links of the round alone, between
    classes and not between texts. Links inside a class change nothing, so in every bucket one class, the one with most
    members left, may keep them; when the members of all other classes have been hubs, each pair of two classes has had
    its comparison. Such a bucket is settled: classes only grow, so no round finds it otherwise, and all leave it. Later
    rounds spread only the rest, and nodes without a bucket are no longer carried. Pairs that cannot reach the threshold
    by their bitmaps are left out of the join, and only the bags of the other pairs are shuffled.
    """
    similarity = _udf(_overlap, "double", several=True)
    sketches = ["size", "coarse", "bits"]
    hub_sketches = bags.select(F.col("node").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in sketches])

    def seats(table: DataFrame, *more: str) -> DataFrame:
        return table.select("node", "weight", "label", *more, F.explode("held").alias("bucket"))

    def met(hubs: DataFrame) -> DataFrame:
        pairs = seats(nodes, *sketches).join(hubs.join(hub_sketches, "hub"), "bucket")
        pairs = pairs.where((F.col("label") != F.col("hub_label")) & _may_link(threshold))
        return pairs.select("hub", "node", "hub_label", "label").distinct()

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        ends = pairs.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
        # The same columns under the same names on both sides, so that one shuffle of the bags serves both joins
        packed = _marked(bags.select("node", "bag"), ends, "node")
        sized = pairs.alias("pair").join(packed.alias("one"), F.col("pair.node") == F.col("one.node"))
        sized = sized.join(packed.alias("other"), F.col("pair.hub") == F.col("other.node"))
        compared = stored(sized.select("pair.*", similarity(F.col("one.bag"), F.col("other.bag")).alias("similarity")), "tested")
        release(pairs)
        return compared

    nodes = stored(members.join(bags.select("node", *sketches), "node").withColumn("label", F.col("node")), "open")
    chosen = seats(nodes).groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "node")).alias("first"))
    chosen = stored(chosen.select("bucket", F.col("first.node").alias("hub"), F.col("first.node").alias("hub_label")), "hubs")
    found = tested(met(chosen))
    compared = [found]
    labels = connected_components(found.where(F.col("similarity") >= threshold), "hub", "node")
    # Few rounds, for each reads all open buckets: those with up to 64 members to compare are settled by the first
    fresh = 64
    while True:
        led = chosen.groupBy(F.col("hub").alias("node")).agg(F.collect_list("bucket").alias("led"))
        classed = nodes.select("node", "weight", "held").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        classed = classed.join(led, "node", "left")
        left = F.when(F.col("led").isNull(), F.col("held")).otherwise(F.array_except("held", "led"))
        classed = stored(classed.withColumn("held", left).drop("led").where(F.size("held") > 0), "classed")
        release(chosen)
        idle = seats(classed).groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("idle"))
        spared = idle.groupBy("bucket").agg(F.max(F.struct("idle", "label")).alias("spared"), F.sum("idle").alias("total"))
        unsettled = seats(classed).join(spared.where("spared.idle < total"), "bucket")
        waiting = unsettled.where("label != spared.label")
        heaviest = Window.partitionBy("bucket").orderBy(F.desc("weight"), "node")
        chosen = waiting.withColumn("place", F.row_number().over(heaviest)).where(F.col("place") <= fresh)
        chosen = stored(chosen.select("bucket", F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hubs")
        if chosen.isEmpty():
            release(nodes, classed, chosen, *compared)
            return labels
        held = unsettled.groupBy("node", "label").agg(F.collect_list("bucket").alias("held"))
        nodes, old = stored(nodes.drop("label", "held").join(held, "node"), "open"), nodes
        release(old, classed)
        pairs = met(chosen)
        for before in compared:
            pairs = pairs.join(before.select("hub", "node"), ["hub", "node"], "left_anti")
        found = tested(pairs)
        compared.append(found)
        links = found.where(F.col("similarity") >= threshold)
        if not links.isEmpty():
            labels = _relabelled(labels, links)
        fresh = 8 * fresh


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after their classes are united along links ``(hub_label, label)``; a text without a label is its own."""
    merged = connected_components(links, "hub_label", "label").withColumnsRenamed({"node": "class", "label": "to"})
    moved = labels.join(merged, F.col("label") == F.col("class"), "left").select("node", F.coalesce("to", "label").alias("label"))
    added = merged.join(labels, F.col("class") == F.col("node"), "left_anti").select(F.col("class").alias("node"), F.col("to").alias("label"))
    united = stored(moved.union(added), "labels")
    release(labels, merged)
    return united


def _marked(rows: DataFrame, wanted: DataFrame, key: str, rest: bool = False) -> DataFrame:
    """The rows whose key is in ``wanted``, and a few others: spares the join that follows a shuffle of all texts.

    With ``rest`` the rows that are left out instead, all of them with a key that is not in ``wanted``. Keys are hashed to
    the bits of one map of ``MARKS`` bits, 2 MB however large the tables are.
    """
    at = F.pmod(F.xxhash64(key), F.lit(MARKS)) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("marks"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("marks", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = rows.withColumn("part", F.bitmap_bucket_number(at)).join(F.broadcast(marks), "part", "left" if rest else "inner")
    bit = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("long"))
    return marked.where(F.coalesce(bit, F.lit(0)) == 0 if rest else bit != 0).select(*rows.columns)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``class_id`` (the smallest key of the class), ``class_rows`` and ``first_of_class`` to every document.

    Two texts are linked if the multisets of their five-word shingles (words between ASCII white space) have a weighted
    Jaccard similarity of at least ``threshold``; linked and equal texts are of one class. Texts of fewer than five words
    are one shingle. A text without words equals only the same text. A null text is a class of its own row, whose
    ``class_id`` is its key. ``first_of_class`` marks one row of each class, one with the smallest key (nulls last). Keys
    are longs and may repeat. An empty table gives an empty one; other columns stay, those named like new ones are replaced.
    """
    columns = docs.drop("class_id", "class_rows", "first_of_class").columns
    row, text_id, found = fresh_name(docs, "row", "text_id", "found")
    # Rows are numbered once, in a stored table: a plan that is run again could number them otherwise
    docs = stored(docs.select(*columns, F.monotonically_increasing_id().alias(row)), "numbered")
    hashed = F.unhex(F.md5(F.col(text).cast("string").cast("binary")))
    signed = docs.select(
        F.col(row).alias("row"), F.col(key).alias("k"), hashed.alias("t"),
        _udf(_bands, "array<long>")(F.col(text).cast("string")).alias("b"),
    )
    signed = stored(signed.where("t IS NOT NULL"), "signatures")
    # A node for each text, numbered as its head: a row with the smallest key
    nodes = signed.groupBy("t").agg(F.min(F.struct(F.col("k").isNull(), "k", "row")).alias("head"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes.select("t", "head.k", F.col("head.row").alias("node"), "n"), "nodes")

    # A row whose text no other has is its own head: only the others are shuffled with their signatures to find theirs
    copied, own = nodes.where("n > 1"), signed.select(F.col("row").alias("node"), "t", "b")
    # Nodes are unique, and a semi join would be moved below the filter
    heads = _marked(own, copied.select("t"), "t").join(nodes.select("node"), "node").select(*own.columns)
    heads = heads.union(_marked(own, copied.select("t"), "t", rest=True))
    # Equal keys of one text cannot be told apart, so each counts once
    banded = heads.select("node", F.explode(F.array_distinct("b")).alias("bucket"))
    # One shuffle by bucket counts the members, drops the many buckets of one, and tells the others apart
    whole = Window.partitionBy("bucket")
    shared = banded.withColumn("size", F.count(F.lit(1)).over(whole)).where("size > 1")
    # Copies of a text share most bands: buckets with the same members, told by their number, their ends and 128 bits, are one
    told = [F.min("node").over(whole).alias("least"), F.max("node").over(whole).alias("most")]
    told += [F.bit_xor(F.xxhash64(F.lit(i), "node")).over(whole).alias(f"told_{i}") for i in range(2)]
    alike = shared.select("bucket", "node", "size", *told).groupBy("node", "size", "least", "most", "told_0", "told_1")
    alike = alike.agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("times"))
    # A node is in one bucket for each band at most, so its array is small
    held = F.collect_list("bucket").alias("held")
    members = stored(alike.groupBy("node").agg(F.sum(F.col("size") * F.col("times")).alias("weight"), held), "members")
    release(signed)
    wanted = stored(members.select("node"), "wanted")
    texts = _marked(docs.select(F.col(row).alias("node"), F.col(text).cast("string").alias("x")), wanted, "node").join(wanted, "node")
    bagged = _udf(_bags, "bag binary, size long, bits array<long>, coarse array<long>")("x").alias("bagged")
    bags = stored(texts.select("node", bagged).select("node", "bagged.*"), "bags")
    release(wanted)
    labels = _link_buckets(members, bags, threshold)
    release(members, bags)

    classed = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    chief = F.min(F.struct(F.col("k").isNull(), "k", "node")).alias("chief")
    classes = classed.groupBy("label").agg(chief, F.sum("n").alias("class_rows"))
    classed = classed.join(classes, "label").select(
        F.col("t").alias(text_id), F.struct(F.col("chief.k").alias("id"), "class_rows", F.col("chief.node").alias("row")).alias(found)
    )
    out = docs.withColumn(text_id, hashed).join(stored(classed, "classes"), text_id, "left")
    alone = F.col(found).isNull()
    return out.select(
        *columns,
        F.when(alone, F.col(key)).otherwise(F.col(f"{found}.id")).alias("class_id"),
        F.coalesce(f"{found}.class_rows", F.lit(1)).alias("class_rows"),
        (alone | (F.col(row) == F.col(f"{found}.row"))).alias("first_of_class"),
    )
