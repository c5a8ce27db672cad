"""Repeated strings against a plain count of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from bandnet.llm import suffix_dedup
from bandnet.llm.queries import QUERIES
from bandnet.llm.suffix_arrays import prefix_ranks, repeated_starts


def plain(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rows, words):
    """Keys of rows that have a string of so many words that another row has as well."""
    seen = {}
    for i, (_, text) in enumerate(rows):
        w = (text or "").split()
        for j in range(len(w) - words + 1):
            seen.setdefault(" ".join(w[j : j + words]), set()).add(i)
    return {rows[i][0] for ids in seen.values() if len(ids) > 1 for i in ids}


def test_shared_passages(spark):
    rng = np.random.default_rng(9)
    say = lambda n: " ".join("w%d" % x for x in rng.integers(0, 10**6, n))
    passage = say(60)
    rows = [(0, None), (1, ""), (2, say(300)), (3, say(300)), (4, say(40) + " " + passage + " " + say(9)), (5, passage + "\n" + say(200))]
    rows += [(6, " ".join(passage.split()[:20]) + " " + say(100)), (7, say(70)), (8, say(10))]
    rows += [(9, (say(55) + " ") * 3)]  # repeats itself only
    same = say(80)
    rows += [(10, same), (11, same), (12, "  ".join(passage.split()[5:57]))]
    df = spark.createDataFrame(rows, "doc_id int, x string").repartition(3)
    number = {r.n: r.doc_id for r in df.select("doc_id", suffix_dedup.text_number(df.x).alias("n")).orderBy("doc_id").collect()}
    found = {number[r.t]: r.n for r in suffix_dedup.shared_passages(df, text="x").collect()}
    assert {k for k in found} <= {4, 5, 10, 11, 12} and {4, 5, 12} <= set(found) and {10, 11} & set(found)
    assert passages(rows, 51) == {4, 5, 10, 11, 12}
    assert suffix_dedup.shared_passages(df.limit(0), text="x").count() == 0


def test_query_against_all_windows(spark, small):
    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    rows = QUERIES["op2_suffix_array_repeats"](spark, small).collect()
    expected = [(k, *x) for k, x in zip(t["doc_id"], plain(t["text"], 400), strict=True)]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == Counter(expected)
    assert any(r.n_removed for r in rows) and any(r.n_removed == 0 for r in rows)
    shares = set(passages(list(zip(t["doc_id"], t["text"], strict=True)), 51))
    some = set(passages(list(zip(t["doc_id"], t["text"], strict=True)), 25))
    told = {r.doc_id for r in rows if r.n_shared_passages}
    assert shares and shares <= told <= some


@pytest.mark.parametrize("shard_bytes", [4_000_000, 300])
def test_awkward_texts(spark, shard_bytes):
    rng = np.random.default_rng(4)
    say = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, edge = say(120), say(45)
    texts = [None, "", "short", "z" * 39, "z" * 40, "y" * 41, "x" * 300, "ab" * 100, passage, passage, say(20) + passage + say(30)]
    texts += [say(10) + passage[30:90] + say(10), passage[:70] + say(5) + passage[60:], edge, "q" + edge, edge + "q", say(60) + edge * 3]
    texts += [say(int(rng.integers(0, 200))) + passage[i : i + int(rng.integers(38, 80))] + say(9) for i in range(0, 60, 3)]
    texts += ["".join(rng.choice(["abcabcabc", "defdef"], 30)) for _ in range(6)] + ["short", "x" * 300]
    frame = spark.createDataFrame([(i % 7, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, whole string")
    rows = suffix_dedup.remove_repeats(frame, size=40, with_kept=True, shard_bytes=shard_bytes).collect()
    expected = Counter(zip((i % 7 for i in range(len(texts))), *zip(*plain(texts, 40), strict=True), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == expected
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n, depth = int(rng.integers(1, 90)), int(rng.integers(8, 30))
        data = rng.integers(0, rng.integers(1, 3) + 1, n).astype(np.uint8)
        prefixes = [data[i : i + depth].tobytes() for i in range(n)]
        assert prefix_ranks(data, depth).tolist() == [sorted(prefixes).index(p) for p in prefixes]
        cuts = [0, *np.sort(rng.integers(0, n + 1, 3)).tolist(), n]
        ends = np.concatenate([np.full(b - a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        starts = np.array([i for i in range(n) if i + depth <= ends[i]], dtype=np.int64)
        flags = repeated_starts(data, starts, ends, depth)
        kept = [prefixes[i] for i in starts]
        assert flags.tolist() == [kept.count(p) > 1 for p in kept]


def test_stored_tables_leave_the_session_alone(spark):
    from bandnet.llm import storage

    other = spark.newSession()
    name = "spark.checkpoint.dir"
    before = other.conf.get(name, None)
    folder = storage.shared_folder(other)
    assert other.conf.get(name, None) == before and folder == storage.shared_folder(other)
    table = storage.stored(other.range(5), "five")
    assert table.count() == 5
    storage.release(table)
