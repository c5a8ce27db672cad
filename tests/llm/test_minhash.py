"""Near-duplicate classes against all-pairs comparison, and the signatures against their expectation."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bandnet.llm import minhash
from bandnet.llm.components import connected_components
from bandnet.llm.queries import QUERIES


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return Counter()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def classes(rows, threshold=0.8):
    """Smallest key of the class and its rows, for each row, by comparing all texts that share a shingle."""
    texts = sorted({t for _, t in rows if t is not None})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    pairs = set()
    for i, b in enumerate(bags):
        for s in b:
            pairs.update((j, i) for j in where.setdefault(s, []))
            where[s].append(i)
    for i, j in pairs:
        both = sum((bags[i] & bags[j]).values())
        if both >= threshold * (sum(bags[i].values()) + sum(bags[j].values()) - both) - 1e-12:
            parent[root(j)] = root(i)
    number = {t: root(i) for i, t in enumerate(texts)}
    keys, sizes = {}, Counter()
    for k, t in rows:
        if t is not None:
            keys.setdefault(number[t], []).append(k)
            sizes[number[t]] += 1
    least = {c: min((k for k in ks if k is not None), default=None) for c, ks in keys.items()}
    return [(k, k, 1) if t is None else (k, least[number[t]], sizes[number[t]]) for k, t in rows]


def check(rows, found):
    assert Counter((r.doc_id, r.class_id, r.class_rows) for r in found) == Counter(classes(rows))
    heads = Counter(r.class_id for r in found if r.first_of_class and r.text is not None)
    assert set(heads.values()) <= {1}
    assert len(heads) == len({r.class_id for r in found if r.text is not None})
    assert all(r.doc_id == r.class_id for r in found if r.first_of_class)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    for _ in range(4):
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        b = np.where(rng.random(60) < 0.6, a, b)
        hashes = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        rows = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        weights = np.concatenate([a[a > 0], b[b > 0]]).astype(float)
        signature = minhash.bag_signatures(rows, np.concatenate([hashes[a > 0], hashes[b > 0]]), weights, 3, slots=2048)
        assert abs((signature[0] == signature[1]).mean() - expected) < 4 * np.sqrt(expected * (1 - expected) / 2048)
        assert np.isinf(signature[2]).all()


def test_query_against_all_pairs(spark, small):
    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], strict=True))
    found = QUERIES["op1_bag_minhash"](spark, small).collect()
    assert Counter((r.doc_id, r.class_id, r.class_rows) for r in found) == Counter(classes(rows))


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    base = rng.choice(words, 120).tolist()
    rows = [(1, None), (2, None), (None, None), (3, ""), (4, ""), (5, "\n \n"), (6, "one two"), (7, "one  two"), (8, "one two three")]
    rows += [(None, "repeat " * 40), (9, "repeat " * 44), (9, "repeat " * 44), (9, "repeat " * 44), (10, "repeat " * 80), (None, "lonely words of no key here")]
    for i in range(20, 70):  # one group around a base whose members are near the limit among themselves
        copy = list(base)
        for at in rng.choice(120, 1 + i % 2, replace=False):
            copy[at] = f"x{i}{at}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.choice(words, 30))) for i in range(20)]
    frame = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], "doc_id long, text string, row int, Node int")
    found = minhash.near_duplicates(frame.repartition(3)).collect()
    check(rows, found)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1)]
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.label) for r in found) == sorted(label.items())
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_tables_between_have_a_row_for_each_text(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(500)]
    base, rows = rng.choice(words, 120).tolist(), []
    for i in range(60):  # near copies share some of their bands each, so their buckets differ
        copy = list(base)
        for at in rng.choice(120, 2, replace=False):
            copy[at] = f"x{i}{at}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.choice(words, 30))) for i in range(300)]
    kept, stored = {}, minhash.stored

    def counted(df, name):
        table = stored(df, name)
        kept[name] = max(kept.get(name, 0), table.count())
        return table

    monkeypatch.setattr(minhash, "stored", counted)
    check(rows, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    # No table of one row for each text and bucket is joined again, nor one of all bands kept
    assert not {"banded", "met"} & set(kept)
    assert 60 <= kept["members"] == kept["open"] == kept["bags"] < 120


def test_settled_buckets_and_hubs_are_not_spread_again(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for first, texts, changes in ((0, 60, 1), (100, 40, 4)):  # copies of one class, and texts that meet and are not alike
        base = rng.choice(words, 120).tolist()
        rows.append((first, " ".join(base)))
        for i in range(first + 1, first + texts):
            copy = list(base)
            for at in rng.choice(120, changes, replace=False):
                copy[at] = f"x{i}{at}"
            rows.append((i, " ".join(copy)))
    kept, stored = {"open": [], "hubs": []}, minhash.stored

    def recorded(df, name):
        table = stored(df, name)
        if name in kept:
            kept[name].append(table.collect())
        return table

    monkeypatch.setattr(minhash, "stored", recorded)
    check(rows, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    before, *later = kept["open"]
    assert len(before) > 90 and later
    for n, table in enumerate(later, 1):
        assert 0 < len(table) <= 40
        seats = [(r.node, r.label, bucket) for r in table for bucket in r.held]
        assert not {(r.hub, r.bucket) for hubs in kept["hubs"][:n] for r in hubs} & {(node, bucket) for node, _, bucket in seats}
        classes_in = Counter(bucket for _, bucket in {(label, bucket) for _, label, bucket in seats})
        assert min(classes_in.values()) > 1


def test_only_copied_rows_and_compared_texts_are_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(500)]
    base, rows = rng.choice(words, 120).tolist(), []
    for i in range(40):  # near copies of one text: pairs that are compared
        copy = list(base)
        copy[3 * i] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(500 + i, " ".join(["a", "b", "c", "d"][i % 3 :]) + f" {i // 3}") for i in range(30)]
    alone = [(100 + i, " ".join(rng.choice(words, 30))) for i in range(300)]
    rows += alone + [(900 + i, alone[i % 5][1]) for i in range(20)] + [(None, alone[7][1]), (107, alone[7][1]), (None, None)]
    # Texts that share bands and that their sizes keep apart: no pair needs their bags
    phrase = " ".join(rng.choice(words, 60))
    rows += [(2000 + i, phrase + " " + " ".join(rng.choice(words, 20 * i))) for i in range(8)]
    seen, marked, kept, stored = [], minhash._marked, {}, minhash.stored

    def recorded(table, wanted, key, **rest):
        found = marked(table, wanted, key, **rest)
        seen.append((set(table.columns), rest.get("rest", False), found.count(), table.count()))
        return found

    def counted(df, name):
        kept.setdefault(name, []).append(table := stored(df, name))
        return table

    monkeypatch.setattr(minhash, "_marked", recorded)
    monkeypatch.setattr(minhash, "stored", counted)
    monkeypatch.setattr(minhash, "release", lambda *tables: None)
    check(rows, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    signatures = [s for s in seen if "b" in s[0]]
    copies = sum(n for n in Counter(t for _, t in rows if t is not None).values() if n > 1)
    assert [(rest, n) for _, rest, n, _ in signatures] == [(False, copies), (True, len(rows) - 1 - copies)]
    # A node of each text in the shuffle by bucket, and the bags of what is compared in the joins by bag
    assert {r.node for r in kept["members"][0].collect()} <= {r.node for r in kept["nodes"][0].collect()}
    bags = [(n, of) for columns, _, n, of in seen if columns == {"node", "bag"}]
    ends = [len({x for r in pairs.collect() for x in (r.hub, r.node)}) for pairs in kept["pairs"]]
    assert [n for n, _ in bags] == ends
    assert 0 < ends[0] < bags[0][1] == kept["bags"][0].count()


def test_marked_rows_and_the_rest_are_all_rows(spark):
    rows = spark.range(50_000).withColumnRenamed("id", "row").withColumn("x", F.col("row") * 2)
    wanted = rows.where("row % 100 = 7").select("row")
    found, rest = (minhash._marked(rows, wanted, "row", rest=r) for r in (False, True))
    assert rest.columns == ["row", "x"]
    assert rest.join(wanted, "row").count() == 0
    assert found.union(rest).distinct().count() == found.count() + rest.count() == 50_000
    assert minhash._marked(rows, wanted.limit(0), "row", rest=True).count() == 50_000
    assert minhash._marked(rows.limit(0), wanted, "row", rest=True).count() == 0


def test_marked_rows_keep_every_wanted_one(spark):
    rows = spark.range(50_000).withColumnRenamed("id", "row").withColumn("x", F.col("row") * 2)
    wanted = rows.where("row % 100 = 7").select("row")
    found = minhash._marked(rows, wanted, "row")
    assert found.columns == ["row", "x"]
    assert found.join(wanted, "row", "left_semi").count() == 500
    assert found.count() < 550
    assert minhash._marked(rows, wanted.limit(0), "row").count() == 0
