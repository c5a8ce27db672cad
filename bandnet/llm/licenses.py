"""License scans with DataFrame functions alone: MinHash bands over overlapping windows, then exact containment.

For each template length, windows that are a little longer slide over the text. A window and a template are compared if
one of 32 minima of their shingle hashes agrees. A window that holds a template whole has a similarity of at least a third, so it
is missed once in 400,000 times; fewer the longer the template. Then shingles are compared exactly.

Only windows with a pivot word are built: pivots are words chosen so that a window without one cannot hold enough of a
template's shingles to match. Long licenses are templates by their passages: windows of the same length that overlap.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, HASHES, STRIDE, CONTAINMENT = 5, 32, 3, 0.8
MOST_TEMPLATE_WORDS = 100_000

# Notices that name a license
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# What the headers and short texts of licenses have for themselves; the rest of them is shared
_GNU = "terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or"
MARKS = [
    *[(f"{name}-{version}.0", _GNU.format(word, version)) for name, word, version in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3))],
    ("LGPL-2.1", _GNU.format("Lesser ", "2.1")),
    ("BSD-2-Clause", "the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
]
# A template that two licenses have in common counts for the one, unless the other is found
UNLESS = {"Redistribution and use in source and binary forms, with or without modification, are permitted": "BSD-2-Clause"}
PASSAGE, STEP = 40, 20
# Words too common to look for first
COMMON = "a an and are as at be by for from in is it of on or that the this to under use version with without work".split()


def template_table(spark: SparkSession) -> DataFrame:
    """The notices, the marks of headers and the passages of whole licenses; ``unless`` names a license that rules a row out."""
    rows = [*TEMPLATES, *MARKS, *passages()]
    return spark.createDataFrame([(name, said, UNLESS.get(said)) for name, said in rows], "license_id string, template string, unless string")


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} - {()}


def passages() -> list[tuple[str, str]]:
    """Overlapping windows of the license texts beside this file, without those that another of the texts holds as well."""
    texts = {f.stem: re.findall("[a-z0-9]+", f.read_text().lower()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    held = {name: _shingles(words) for name, words in texts.items()}
    out = []
    for name, words in texts.items():
        for start in [*range(0, len(words) - PASSAGE, STEP), len(words) - PASSAGE]:
            part = words[start : start + PASSAGE]
            sought = _shingles(part)
            if all(len(sought & other) < CONTAINMENT * len(sought) for o, other in held.items() if o != name):
                out.append((name, " ".join(part)))
    return out


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, "[^a-z0-9]+"), lambda w: w != "")


def shingle_set(words: Column) -> Column:
    """Distinct five-word shingles; fewer words, but not none, are one shingle."""
    last = F.greatest(F.lit(0), F.size(words) - SHINGLE)
    joined = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))
    return F.when(F.size(words) > 0, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))


def minima(shingles: Column) -> Column:
    """One number for each hash function: a band of one row, with the function's number worked in."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: F.xxhash64(k, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))
    )


def pivots(templates: list[list[str]], containment: float | None = None) -> list[str]:
    """Words such that each shingle of each template has one; with ``containment``, so many that no window can match without one.

    Common and short words are taken last.
    """
    held = Counter(w for t in templates for w in set(t))
    chosen: set[str] = set()
    for words in sorted(templates):
        left = _shingles(words)
        # A window that matches lacks fewer shingles than these
        spare = 0 if containment is None else len(left) - min(len(left), int((1 - containment) * len(left) + 1e-9) + 1)
        left = {s for s in left if chosen.isdisjoint(s)}
        for word in sorted(set(words), key=lambda w: (w not in COMMON, min(len(w), 9), held[w], w), reverse=True):
            if len(left) <= spare:
                break
            if any(word in s for s in left):
                chosen.add(word)
                left = {s for s in left if word not in s}
    return sorted(chosen)


def scan_licenses(docs: DataFrame, templates: DataFrame, text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Add ``licenses``: for each license found its ``license_id``, the best ``containment``, and ``first_word`` of the first such window.

    Containment is the share of a template's shingles that a window holds. Windows have two words more than the template
    and start at every third word. Templates are few: their words are read to the driver, at most
    ``MOST_TEMPLATE_WORDS`` (more is an error); templates without words or id find nothing; one with a license in a
    column ``unless`` finds nothing in texts where that license is found. Equal texts are scanned
    once. Null and empty texts have no licenses; the list is ordered by id; an empty table gives an empty one; a column
    named licenses is replaced, all others stay.
    """
    docs = docs.drop("licenses")
    unless = F.col("unless") if "unless" in templates.columns else F.lit(None)
    known = templates.select(F.col("license_id").cast("string"), words_of(F.col("template")).alias("t_words"), unless.cast("string").alias("unless"))
    known = known.dropna(subset=["license_id", "t_words"])
    known = known.where(F.size("t_words") > 0).distinct()
    total = known.agg(F.sum(F.size("t_words"))).first()[0] or 0
    if total > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} words")
    lists = [r["t_words"] for r in known.select("t_words").distinct().collect()]
    by_length = {n: pivots([t for t in lists if len(t) == n], containment) for n in sorted({len(t) for t in lists})}
    wanted = sorted(set().union(*by_length.values()))
    digest = F.md5(F.col(text).cast("string").cast("binary"))
    result = "array<struct<license_id:string,containment:double,first_word:int>>"
    if not wanted:
        return docs.withColumn("licenses", F.array().cast(result))

    lowered = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hopeful = docs.where(lowered.rlike(f"(?<![a-z0-9])(?:{'|'.join(wanted)})(?![a-z0-9])"))
    texts = hopeful.select(digest.alias("digest"), F.col(text).cast("string").alias("said")).dropDuplicates(["digest"])
    texts = texts.select("digest", words_of(F.col("said")).alias("words"))
    numbered = F.transform("words", lambda w, i: F.when(w.isin(wanted), F.struct(i.alias("place"), w.alias("word"))))
    texts = texts.withColumn("pivots", F.filter(numbered, lambda x: x.isNotNull()))

    def of_length(n: int, held: list[str]) -> Column:
        """Distinct starts of the windows that hold one of the length's pivots."""

        def starts(x: Column) -> Column:
            first = (F.ceil(F.greatest(F.lit(0), x["place"] - n - 1) / STRIDE) * STRIDE).cast("int")
            return F.filter(F.sequence(first, F.greatest(first, x["place"]), F.lit(STRIDE)), lambda s: s <= x["place"])

        several = F.array_distinct(F.flatten(F.transform(F.filter("pivots", lambda x: x["word"].isin(held)), starts)))
        return F.transform(several, lambda s: F.struct(s.alias("start"), F.lit(n).alias("n")))

    spans = F.flatten(F.array(*[of_length(n, held) for n, held in by_length.items()]))
    windows = texts.select("digest", "words", F.explode(spans).alias("w"))
    windows = windows.select("digest", "w.start", "w.n", F.slice("words", F.col("w.start") + 1, F.col("w.n") + 2).alias("words"))
    windows = windows.select("digest", "start", "n", shingle_set(F.col("words")).alias("shingles"))

    sought = known.select("license_id", "unless", F.size("t_words").alias("n"), shingle_set(F.col("t_words")).alias("t_shingles"))
    t_bands = sought.select("license_id", "unless", "n", "t_shingles", F.explode(minima(F.col("t_shingles"))).alias("band"))
    bands = windows.select("digest", "start", "n", "shingles", F.explode(minima(F.col("shingles"))).alias("band"))
    # Templates are bounded above, so their bands can be sent to every task
    met = bands.join(F.broadcast(t_bands), ["n", "band"])
    share = F.size(F.array_intersect("t_shingles", "shingles")) / F.size("t_shingles")
    met = met.select("digest", "license_id", "unless", "start", share.alias("share")).where(F.col("share") >= containment - 1e-12)
    best = met.groupBy("digest", "license_id", "unless").agg(F.min(F.struct(-F.col("share"), F.col("start"))).alias("best"))
    hit = F.struct("license_id", F.col("best.col1").alias("short"), F.col("best.start").alias("first_word"), "unless")
    listed = best.groupBy("digest").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    ids = F.transform("hits", lambda x: x["license_id"])
    listed = listed.withColumn("hits", F.filter("hits", lambda x: x["unless"].isNull() | ~F.array_contains(ids, x["unless"])))
    first = F.filter("hits", lambda x, i: (i == 0) | (F.get(F.col("hits"), i - 1)["license_id"] != x["license_id"]))
    found = F.transform(first, lambda x: F.struct(x["license_id"].alias("license_id"), (-x["short"]).alias("containment"), x["first_word"].alias("first_word")))
    listed = listed.select("digest", found.alias("licenses"))
    listed = listed.withColumnRenamed("digest", "text_digest").withColumnRenamed("licenses", "found_licenses")
    joined = docs.join(listed, digest == F.col("text_digest"), "left")
    return joined.select(*docs.columns, F.coalesce("found_licenses", F.array().cast(result)).alias("licenses"))
