"""Operators 11 to 13 against plain versions, on the small tables and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from bandnet.llm import mixing, periodic, spelling
from bandnet.llm.queries import QUERIES, repeated_tails, slip

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(small):
    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["source"], strict=True))


# op11


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again until none is above its limit; sizes by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / share for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def check_mix(rows, documents):
    sizes = {k: len(WORDS.findall(t or "")) for k, t, _ in documents}
    by_source = defaultdict(int)
    for k, _, s in documents:
        by_source[s] += sizes[k]
    targets = plain_targets(by_source)
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _, _ in documents)
    taken, copies = defaultdict(int), defaultdict(set)
    for r in rows:
        assert (r["size"], r.source_size) == (sizes[r.doc_id], by_source[r.source])
        assert r.target == pytest.approx(targets[r.source], rel=1e-12, abs=1e-9)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        copies[r.source].add(r.copies)
    for s, target in targets.items():
        own = sorted(sizes[k] for k, _, of in documents if of == s)
        # Twelve documents to choose from come within a few words; fewer within half of the largest
        assert abs(taken[s] - target) <= (target / 100 if len(own) > 12 else max(own) / 2) + 1e-6, s
        assert max(copies[s]) - min(copies[s]) <= 1
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.02)


def test_mix_of_the_documents(spark, small, documents):
    rows = QUERIES["op11_cube_source_mix"](spark, small).collect()
    check_mix(rows, documents)
    assert sorted(rows) == sorted(QUERIES["op11_cube_source_mix"](spark, small).collect())


def test_mix_in_many_rounds_does_not_depend_on_the_layout(spark, documents):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(df.repartition(5), part_rows=7).collect()
    check_mix(mixed, rows)
    again = mixing.mix_sources(df.repartition(2, "text"), part_rows=7).collect()
    assert sorted(mixed, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)
    other = mixing.mix_sources(df, part_rows=7, seed=1).collect()
    assert {r.doc_id: r.copies for r in other} != {r.doc_id: r.copies for r in mixed}


def test_chances_are_kept():
    """Over many draws each unit in flight is chosen as often as its probability says; sums hold in every draw."""
    units = [(3, 0.3, 0), (9, 0.8, 1), (4, 0.5, 2), (4, 0.5, 3), (7, 0.25, 4), (1, 0.65, 5), (2, 0.4, 6), (0, 0.6, 7)]
    sums, draws = np.zeros(len(units)), 4000
    for turn in range(draws):
        got = {unit[2]: p for unit, p in mixing.balanced_choice(iter(units), random.Random(turn), False)}
        assert len(got) == len(units) and sum(p not in (0.0, 1.0) for p in got.values()) <= 2
        assert sum(got.values()) == pytest.approx(4.0)
        assert sum(u[0] * got[u[2]] for u in units) == pytest.approx(sum(u[0] * u[1] for u in units))
        sums += [got[i] for i in range(len(units))]
    assert np.abs(sums / draws - [u[1] for u in units]).max() < 4 * math.sqrt(0.25 / draws)


def test_landing():
    assert mixing.landed([], []) == []
    assert mixing.landed([10], [0.4]) == [0.0] and mixing.landed([10], [0.6]) == [1.0]
    # 0.5 * (6 + 4 + 3 + 1) = 7 words, two documents
    assert mixing.landed([6, 4, 3, 1], [0.5] * 4) in ([0.0, 1.0, 1.0, 0.0], [1.0, 0.0, 0.0, 1.0])
    assert mixing.landed([0, 0], [0.9, 0.1]) == [1.0, 0.0]
    rng = random.Random(2)
    for _ in range(100):
        units = [(rng.randint(0, 500), rng.random(), i) for i in range(rng.randint(1, 40))]
        got = dict((u[2], p) for u, p in mixing.balanced_choice(iter(units), random.Random(1), True))
        assert set(got.values()) <= {0.0, 1.0} and sorted(got) == list(range(len(units)))
        assert abs(sum(got.values()) - sum(u[1] for u in units)) < 1


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a", 0), (1, None, "a", 0), (None, "one two", None, 1), (2, "", "b", 2), (3, "x " * 30_000, "b", 3), (4, "y", "", 4), (4, "y", "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE int").selectExpr("*", "1 AS copies", "'t' AS target", "2 AS place", "3 AS chance")
    out = mixing.mix_sources(df)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.taken <= 3 * r["size"] for r in got) and {r.target for r in got if r.source == "a"} == {0.0}
    assert mixing.mix_sources(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, weights=())


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, "c": 1, "d": 1}, {"a": 100, "b": 1, "c": 90, None: 5}, {"a": 0, "b": 0}, {"z": 7, "é": 3, "": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0), rel=1e-12)


# op12


def near(a, b):
    """One insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def plain_groups(counts, min_length=7, min_count=2, ratio=10):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    # Words one edit apart have a string in common that one of them, or each, becomes by losing one letter
    meet = defaultdict(set)
    for w in words:
        for s in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            meet[s].add(w)
    partners = defaultdict(set)
    for group in meet.values():
        for a in group:
            partners[a] |= {b for b in group if near(a, b)}
    forms = {}
    for w, n in words.items():
        best = min(partners[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (n, len(partners[w]), forms[w], words.get(forms[w]), root)
    return out


def as_dict(rows):
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


def contract_counts(documents):
    counts = Counter()
    for k, t, _ in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return counts


def test_variants_of_the_documents(spark, small, documents):
    got = as_dict(QUERIES["op12_spelling_variants"](spark, small).collect())
    assert got == plain_groups(contract_counts(documents))
    assert any(v[2] for v in got.values())


def test_the_slip_is_the_contracts():
    runs = [("%d" % k, "wörterbuch"[: 7 + k % 4]) for k in range(500)]
    assert sum(slip(k, run) != run for k, run in runs) == sum(zlib.crc32(f"{k}:{r}".encode()) % 31 == 0 for k, r in runs) > 0


@pytest.mark.parametrize("list_rows", [1, 5, 4096])
def test_groups_of_dense_words(spark, list_rows):
    """Words of few letters, many in one list, divided down to lists that differ in one place."""
    rng = random.Random(list_rows)
    counts = Counter()
    for _ in range(700):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(3, 7)))
        counts[w] += rng.choice([1, 2, 3, 40, 500, 9000])
    for i in range(200):
        counts["common" + "xyz𝒳"[i % 4] * (i % 3) + chr(97 + i % 26) + "prefix" * (i % 2)] += 10 ** (i % 5)
    counts["x" * 5000] += 30
    counts["x" * 4999] += 300
    rows = [(w, n) for w, n in counts.items()] + [(None, 5), ("abababa", None)]
    df = spark.createDataFrame(rows, "word string, n long").repartition(3)
    got = as_dict(spelling.spelling_groups(df, min_length=3, list_rows=list_rows).collect())
    assert got == plain_groups(counts, min_length=3)


def test_words_of_odd_rows(spark):
    rows = [(1, None, 0), (None, "", 1), (2, "Straße STRASSE naïve ÀÉ÷×ÿ kelvinK", 2), (2, "Straße STRASSE naïve ÀÉ÷×ÿ kelvinK", 2), (3, "word " * 40_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int").selectExpr("*", "1 AS n", "2 AS k", "3 AS T")
    got = {r.word: r.n for r in spelling.word_counts(df, "[a-zÀ-ÿ]+").collect()}
    assert got == {"straße": 2, "strasse": 2, "naïve": 2, "ÀÉ÷×ÿ": 2, "kelvin": 2, "word": 40_000}
    none = spelling.word_counts(df.limit(0), "[a-z]+")
    assert none.count() == 0 and spelling.spelling_groups(none).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(none, ratio=1)


# op13


def plain_runs(w, min_length=24, min_exponent=3):
    """Runs by trying every period, with those left out that a smaller period explains."""
    found = []
    for p in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if n >= max(min_length, min_exponent * p):
                part = w[i : i + n]
                if not any(part[: n - q] == part[q:] for q in range(1, p)):
                    found.append((i, n, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_fold(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_digest(w):
    runs = plain_runs(w)
    best = None
    for s, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(kept))


def test_runs_of_the_documents(spark, small, documents):
    rows = QUERIES["op13_periodic_runs"](spark, small).collect()
    got = Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows)
    want = Counter((k, *plain_digest(plain_fold(k, WORDS.findall(t or "")))) for k, t, _ in documents)
    assert got == want
    assert sum(r.n_runs > 0 for r in rows) > 5


def test_the_tail_is_repeated_as_the_contract_says(spark):
    docs = [(k, " ".join(f"w{i}" for i in range(k % 90))) for k in range(400)]
    rows = repeated_tails(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text.split() for r in rows} == {k: plain_fold(k, t.split()) for k, t in docs}


@pytest.mark.parametrize("min_length,min_exponent", [(24, 3), (6, 3), (4, 2), (1, 2), (12, 4)])
def test_runs_of_made_up_rows(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(1, 4)):
            letters = rng.choice([1, 2, 3])
            w = [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
            for _ in range(rng.randint(0, 3)):
                unit = [rng.randrange(letters + 1) for _ in range(rng.randint(1, 12))]
                w += unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))] + [rng.randrange(letters)] * rng.randint(0, 2)
            rows.append(w)
        bounds = np.cumsum([0] + [len(w) for w in rows])
        got = periodic.find_runs(np.array(sum(rows, []), dtype=np.int64), bounds, min_length, min_exponent)
        want = [(s + b, n, p) for w, b in zip(rows, bounds, strict=False) for s, n, p in plain_runs(w, min_length, min_exponent)]
        assert list(zip(*[x.tolist() for x in got], strict=True)) == want


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, " \n\t"), (3, "a b " * 30), (3, "a b " * 30), (4, "x " * 60_000), (5, "é é 日本 " * 20 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'r' AS RUNS", "7 AS found", "8 AS collapsed")
    out = periodic.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "found", "n_words", "runs", "strongest", "collapsed"]
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in out.collect()), key=str)
    assert got == sorted([
        (1, 0, [], None, ""), (0, 0, [], None, ""), (2, 0, [], None, ""),
        (3, 60, [(0, 60, 2)], (0, 60, 2), "a b"), (3, 60, [(0, 60, 2)], (0, 60, 2), "a b"),
        (4, 60_000, [(0, 60_000, 1)], (0, 60_000, 1), "x"), (5, 41, [(0, 40, 2)], (0, 40, 2), "é é 日本 end"),
    ], key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), np.array([0, 9]), 24, 1)
