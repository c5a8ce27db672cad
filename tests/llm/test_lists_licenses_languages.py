"""Operators 3, 5 and 8, and the pipeline, on awkward rows and against plain versions."""

import datetime as dt
import math
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from bandnet.llm import langid, licenses, url_lists
from bandnet.llm.decontaminate import text_words
from bandnet.llm.queries import QUERIES, vocabulary_bytes
from bandnet.llm.secrets import base_spans

DAY = dt.datetime(2024, 1, 1)


def at(days):
    return DAY + dt.timedelta(days=days)


def test_captures_as_of(spark):
    entries = [
        ("example.com", at(10), "block"), ("example.com", at(40), "allow"), ("Sub.example.com", at(20), "allow"), ("example.com", at(10), "block"),
        ("sub.example.com", at(100), "block"), ("tie.org", at(5), "allow"), ("tie.org", at(5), "block"), (None, at(1), "block"), ("x.org", None, "block"),
    ]
    captures = [
        (1, "http://example.com/a", at(9)), (1, "http://example.com/a", at(9)), (2, "HTTPS://user@Example.COM:80/b?c", at(10)), (3, "http://a.b.example.com", at(39.9)),
        (4, "http://example.com./", at(40)), (5, "http://sub.example.com/x", at(30)), (6, "http://sub.example.com/x", at(400)), (7, "http://tie.org", at(5)),
        (8, None, at(1)), (9, "no url", at(1)), (10, "http://tie.org", None), (11, "http://localhost/", at(1)),
    ]
    c = spark.createDataFrame([(*x, "v", "k") for x in captures], "page_id int, url string, fetched_at timestamp, verdict string, key string")
    e = spark.createDataFrame(entries, "key string, listed_at timestamp, action string")
    rows = url_lists.judge_captures(c, e, bucket_days=7).collect()
    found = sorted((r.page_id, r.matched_key, r.verdict) for r in rows if r.verdict)
    assert found == [(2, "example.com", "block"), (3, "example.com", "block"), (4, "example.com", "allow"), (5, "sub.example.com", "allow"), (6, "sub.example.com", "block"), (7, "tie.org", "block")]
    assert len(rows) == len(captures) and rows[0].key == "k"
    assert all(r.verdict is None for r in url_lists.judge_captures(c, e.limit(0)).collect())
    assert url_lists.judge_captures(c.limit(0), e).count() == 0


def test_licenses_in_awkward_texts(spark):
    said = dict(licenses.TEMPLATES)
    noise = " ".join(f"word{i}" for i in range(50))
    edited = said["GPL-3.0"].replace("version", "release")
    texts = [None, "", "license", said["MIT"], f"{noise}\n{said['MIT'].upper()} {noise} {said['CC-BY-NC-4.0']}", said["MIT"], "the " * 20_000 + said["Apache-2.0"], edited, noise]
    frame = spark.createDataFrame([(i, t, "d") for i, t in enumerate(texts)], "doc_id int, text string, digest string")
    rows = {r.doc_id: [(x.license_id, x.containment) for x in r.licenses] for r in licenses.scan_licenses(frame, licenses.template_table(spark)).collect()}
    assert rows[0] == rows[1] == rows[2] == rows[8] == []
    assert rows[3] == rows[5] == [("MIT", 1.0)] and rows[4] == [("CC-BY-NC-4.0", 1.0), ("MIT", 1.0)]
    assert rows[6] == [("Apache-2.0", 1.0)] and rows[7] == []
    assert licenses.scan_licenses(frame.limit(0), licenses.template_table(spark)).count() == 0
    assert all(not r.licenses for r in licenses.scan_licenses(frame, licenses.template_table(spark).limit(0)).collect())
    plan = licenses.scan_licenses(frame, licenses.template_table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan.split("== Physical Plan ==")[1])


def test_pivots_hit_every_shingle():
    lists = [re.findall("[a-z0-9]+", t.lower()) for _, t in licenses.TEMPLATES]
    chosen = set(licenses.pivots(lists))
    for words in lists:
        for i in range(max(1, len(words) - 4)):
            assert chosen & set(words[i : i + 5])


def plain_score(scorer, word):
    ahead = [np.ones(len(scorer.languages))]
    for end in range(1, len(word) + 1):
        total = np.zeros(len(scorer.languages))
        for start in range(end):
            if word[start:end] in scorer.pieces:
                total += ahead[start] * scorer.probability[scorer.pieces[word[start:end]]]
            elif end - start == 1:
                total += ahead[start] * langid.UNKNOWN
        ahead.append(total)
    return np.log(ahead[-1])


def test_forward_sums_all_segmentations(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 3000")
    learnt = langid.learn_languages(docs, vocabulary_bytes())
    scorer = langid.WordScorer(learnt)
    words = ["the", "être", "nicht", "x", "日本", "a" * 31, "öße!!", "0"]
    assert np.allclose(scorer.score(words), [plain_score(scorer, "▁" + w) for w in words])
    long_word = "tion" * 20
    assert np.allclose(scorer._score_long("▁" + long_word), plain_score(scorer, "▁" + long_word))
    assert np.isfinite(scorer.score(["ab日" * 2000])).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (4, "the"), (4, "the"), (5, "the " * 30_000)], "Score long, text string")
    rows = langid.identify_languages(odd.withColumnRenamed("Score", "found"), learnt).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == "en"
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    nothing = langid.learn_languages(docs.limit(0), vocabulary_bytes())
    assert {r.lang_pred for r in langid.identify_languages(odd.withColumnRenamed("Score", "k"), nothing).collect()} == {"und"}
    assert langid.identify_languages(odd.limit(0), learnt).count() == 0


def test_held_out_accuracy(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op8_unigram_languages"](spark, small).collect() if r.held_out]
    assert len(rows) > 20 and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept, seen = docs.columns, docs, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, small)
        assert kept.columns == columns and kept.dtypes == docs.dtypes
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        seen.append({r.doc_id: r.text for r in kept.collect()})
    quality, unique, clean, masked = seen
    texts = dict(pq.read_table(f"{small}/documents.parquet").select(["doc_id", "text"]).to_pandas().itertuples(index=False))
    good = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    judged = {r.doc_id: r for r in QUERIES["op7_line_field_quality"](spark, small).collect()}
    assert {k for k, r in judged.items() if r.kept} == set(quality) and len(good & set(quality)) > 0.8 * len(good)
    assert len(set(unique.values())) == len(unique) and set(unique) <= set(quality)
    benchmark = [tuple(text_words(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {w[i : i + 13] for w in benchmark for i in range(len(w) - 12)}
    for key, text in unique.items():
        words = text_words(text)
        hit = {j for i in range(len(words) - 12) if tuple(words[i : i + 13]) in windows for j in range(i, i + 13)}
        assert (key in clean) == (20 * len(hit) < len(words) or not hit)
    assert set(masked) == set(clean) and not any(base_spans(t) for t in masked.values())
    assert all(masked[k] == texts[k] for k in masked if not base_spans(texts[k]))
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.collect()} == set(masked)


def test_stages_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


@pytest.mark.parametrize("n", range(5))
def test_stages_take_nulls(spark, small, n):
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (1, "", None, None, 0), (1, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.STAGES[n][1](spark, docs, small).count()
    assert found == [0, 3, 4, 4, 4][n]


def test_whole_licenses_headers_and_excerpts(spark):
    texts = {f.stem: f.read_text() for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    noise = " ".join(f"word{i}" for i in range(50))
    clauses = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the\n"
        "   documentation and/or other materials provided with the distribution.\n"
    )
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this\n   software without specific prior written permission.\n"
    end = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.\n'
    header = "This program is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation{} either version {} of the License, or\n# (at your option) any later version.\n"
    cases = [(f"{noise} {text} {noise}", name) for name, text in texts.items()]
    cases += [(" ".join(texts["GPL-3.0"].split()[3000:3200]), "GPL-3.0"), (noise, "")]
    cases += [(clauses + end, "BSD-2-Clause"), (clauses + third + end, "BSD-3-Clause"), (dict(licenses.TEMPLATES)["BSD-3-Clause"], "BSD-3-Clause")]
    cases += [(header.format(":", "", ",", 3), "GPL-3.0"), (header.format(";", "", ";", 2), "GPL-2.0"), (header.format(":", "Lesser ", ",", 3), "LGPL-3.0"), (header.format(";", "Lesser ", ";", "2.1"), "LGPL-2.1"), (header.format(":", "Affero ", ",", 3), "AGPL-3.0")]
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id int, text string")
    rows = {r.doc_id: [x.license_id for x in r.licenses] for r in licenses.scan_licenses(frame, licenses.template_table(spark)).collect()}
    for i, (_, name) in enumerate(cases):
        assert rows[i] == [name] * bool(name), (name, rows[i])


def test_rare_pieces_do_not_underflow():
    learnt = {"languages": ["a", "b"], "probability": np.full((32_000, 2), [5e-11, 4e-11]), "model": vocabulary_bytes()}
    scorer = langid.WordScorer(learnt)
    words = ["日" * 31, "zqxj" * 8, "zqxj" * 9]
    scores = scorer.score(words)
    assert np.isfinite(scores).all() and (scores[:, 0] > scores[:, 1]).all()
    assert np.allclose(scores, [scorer._score_long("▁" + w) for w in words])


HOSTS = {
    "https://www.Example.com/a?b@c": "www.example.com",
    "http://192.168.1.5:8080/x": "192.168.1.5",
    "http://[2001:DB8::1]:443/": "[2001:db8::1]",
    "http://user@name@evil.com/": "evil.com",
    "ftp://a:b@host.org.": "host.org",
    "http://%65vil.com/": "evil.com",
    "http://ex%zzample.com/": "ex%zzample.com",
    "http://a+b.com/x": "a+b.com",
    "http://evil.com\\@good.com/": "evil.com",
    "http:///path": None,
    "no url": None,
    "": None,
    None: None,
}


def test_hosts_and_their_keys(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "url string")
    got = {r.url: r.host for r in df.select("url", url_lists.host_of(F.col("url")).alias("host")).collect()}
    assert got == HOSTS
    hosts = {"a.b.co.uk": ["a.b.co.uk", "b.co.uk", "co.uk"], "localhost": ["localhost"], "192.168.1.5": ["192.168.1.5"], "[2001:db8::1]": ["[2001:db8::1]"], "1.2.3.4.com": ["1.2.3.4.com", "2.3.4.com", "3.4.com", "4.com"]}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: r.k for r in df.select("host", url_lists.host_keys(F.col("host")).alias("k")).collect()} == hosts


def test_parts_of_an_address_block_nobody(spark):
    captures = spark.createDataFrame([("http://192.168.1.5/",), ("http://x@y@evil.com/",), ("http://%65vil.com/",)], "url string").selectExpr("url", "timestamp '2024-05-05' AS fetched_at")
    entries = spark.createDataFrame([("1.5", "block"), ("168.1.5", "block"), ("evil.com", "block")], "key string, action string").selectExpr("*", "timestamp '2024-01-01' AS listed_at")
    got = {r.url: r.verdict for r in url_lists.judge_captures(captures, entries).collect()}
    assert got == {"http://192.168.1.5/": None, "http://x@y@evil.com/": "block", "http://%65vil.com/": "block"}
