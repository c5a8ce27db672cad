"""The queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandnet.llm import spelling
from bandnet.llm.decontaminate import find_contamination
from bandnet.llm.langid import identify_languages, learn_languages
from bandnet.llm.licenses import CONTAINMENT, TEMPLATES, scan_licenses, template_table
from bandnet.llm.minhash import near_duplicates
from bandnet.llm.mixing import WORD, mix_sources
from bandnet.llm.packing import pack_best_fit, token_pieces
from bandnet.llm.periodic import periodic_runs
from bandnet.llm.quality import apply_quality_rules, fit_from_labels
from bandnet.llm.secrets import scan_secrets
from bandnet.llm.sharding import balanced_shards
from bandnet.llm.suffix_dedup import remove_repeats, shared_passages, text_number
from bandnet.llm.url_lists import host_keys, host_of, judge_captures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PACK_END_ID, PACK_CAPACITY, SHARDS = 1, 4096, 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The content of a public tokenizer's file."""
    return vocabulary_bytes(name).decode("utf-8")


def vocabulary_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


@query("op1_bag_minhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_rows", "first_of_class")


@query("op2_suffix_array_repeats")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    shared = shared_passages(docs)
    found = remove_repeats(docs, with_kept=True)
    found = found.withColumn("number", text_number(F.col("text"))).join(shared, F.col("number") == F.col("t"), "left")
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_shared_passages"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


def _number(text: str, salt: str, modulus: int) -> str:
    """A number below ``modulus`` that depends on a text, for ``_engine`` to put into SQL."""
    return f"{{hex}}(substr(md5({text} || '{salt}'), 1, 8)) % {modulus}"


# The tables name no fetch times and no lists. Both are made from the pages: each is fetched at a minute of 2024 that its
# number decides; two in three hosts and domains are listed, with two entries at minutes that their names decide.
_MINUTE = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast({minute} as int), 0)"
_DUCK_MINUTE = "timestamp '2024-01-01 00:00:00' + to_minutes(cast({minute} as int))"
_FETCHED, _LISTED = "page_id * 7919 % 525600", _number("key", "{turn}", 525600)
_LISTED_KEY, _ACTION = _number("key", "listed", 3) + " < 2", "CASE WHEN " + _number("key", "{turn}-action", 2) + " = 0 THEN 'block' ELSE 'allow' END"


def _engine(sql: str, engine: str, **values) -> str:
    """A template of ``_number`` for one of the engines."""
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", str(value))
    at = sql.find("{hex}(")
    while at >= 0:
        depth, end = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        inside = sql[at + 6 : end - 1]
        number = f"cast(conv({inside}, 16, 10) as bigint)" if engine == "spark" else f"('0x' || {inside})::bigint"
        sql = sql[:at] + number + sql[end:]
        at = sql.find("{hex}(")
    return sql


def _entry_sql(engine: str, turn: int) -> str:
    minute = _MINUTE if engine == "spark" else _DUCK_MINUTE
    listed = _engine(_LISTED, engine, turn=turn)
    return f"SELECT key, {minute.format(minute=listed)} AS listed_at, {_engine(_ACTION, engine, turn=turn)} AS action FROM keys WHERE {_engine(_LISTED_KEY, engine)}"


@query(
    "op3_url_lists_as_of",
    rf"""
WITH places AS (SELECT *, list_extract(string_split(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1), '@'), -1) AS place FROM pages),
captures AS (SELECT page_id, url,
  nullif(rtrim(lower(url_decode(CASE WHEN starts_with(place, '[') THEN split_part(place, ']', 1) || ']' ELSE split_part(place, ':', 1) END)), '.'), '') AS host,
  {_DUCK_MINUTE.format(minute=_FETCHED)} AS fetched_at FROM places),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM captures WHERE host IS NOT NULL),
host_keys AS (SELECT host, array_to_string(parts[i:], '.') AS key FROM (SELECT host, parts, unnest(range(1, CASE WHEN starts_with(host, '[') OR (len(parts) = 4 AND len(list_filter(parts, lambda p: try_cast(p AS ubigint) IS NULL)) = 0) THEN 2 ELSE greatest(1, len(parts) - 1) + 1 END)) AS i FROM hosts)),
keys AS (SELECT DISTINCT key FROM host_keys),
entries AS ({_entry_sql("duckdb", 1)} UNION ALL {_entry_sql("duckdb", 2)}),
held AS (SELECT key, listed_at, max(action) AS action FROM entries GROUP BY key, listed_at),
intervals AS (SELECT *, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS until FROM held),
met AS (SELECT page_id, k.key, action, listed_at, row_number() OVER (PARTITION BY page_id ORDER BY length(k.key) DESC) AS place
  FROM captures c JOIN host_keys k USING (host) JOIN intervals i ON i.key = k.key AND listed_at <= fetched_at AND (until IS NULL OR fetched_at < until))
SELECT page_id, host, key AS matched_key, action AS verdict, epoch(listed_at)::bigint AS since
FROM captures LEFT JOIN (SELECT * FROM met WHERE place = 1) USING (page_id)
""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    captures = pages.select("page_id", "url", F.expr(_MINUTE.format(minute=_FETCHED)).alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).dropna().distinct()
    keys = hosts.select(F.explode(host_keys(F.col("host"))).alias("key")).distinct()
    entries = None
    for turn in (1, 2):
        listed = _MINUTE.format(minute=_engine(_LISTED, "spark", turn=turn))
        one = keys.where(_engine(_LISTED_KEY, "spark")).selectExpr("key", f"{listed} AS listed_at", f"{_engine(_ACTION, 'spark', turn=turn)} AS action")
        entries = one if entries is None else entries.union(one)
    judged = judge_captures(captures, entries)
    return judged.select("page_id", "host", "matched_key", "verdict", F.unix_timestamp("since").alias("since"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(table(spark, folder, "documents"), vocabulary(), ["doc_id"], end_id=PACK_END_ID, capacity=PACK_CAPACITY)
    return pack_best_fit(pieces, capacity=PACK_CAPACITY)


_LICENSE_WORDS = "list_filter(string_split_regex(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, greatest(1, len({words}) - 4) + 1), lambda i: array_to_string({words}[i : i + 4], ' ')))"
_TEMPLATE_ROWS = ", ".join("('" + name + "', '" + said.replace("'", "''") + "')" for name, said in TEMPLATES)


@query(
    "op5_license_windows",
    f"""
WITH t AS (SELECT license_id, {_LICENSE_WORDS.format(text="template")} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(license_id, template)),
sought AS MATERIALIZED (SELECT license_id, len(w) AS n, {_SHINGLES.format(words="w")} AS t_shingles FROM t),
texts AS MATERIALIZED (SELECT text, {_LICENSE_WORDS.format(text="text")} AS w FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
starts AS (SELECT text, w, n, unnest(range(0, len(w), 3)) AS start FROM texts, (SELECT DISTINCT n FROM sought)),
windows AS (SELECT text, n, start, w[start + 1 : start + n + 2] AS w FROM starts),
shingled AS (SELECT text, n, start, {_SHINGLES.format(words="w")} AS shingles FROM windows),
shared AS (SELECT text, license_id, start, len(list_intersect(t_shingles, shingles)) / len(t_shingles)::double AS share FROM shingled JOIN sought USING (n)),
best AS (SELECT text, license_id, min((-share, start)) AS b FROM shared WHERE share >= {CONTAINMENT} - 1e-12 GROUP BY ALL),
listed AS (SELECT text, string_agg(license_id, ',' ORDER BY license_id) AS ids, count(*) AS n, round(max(-b[1]), 6) AS top, min(b[2]) AS first FROM best GROUP BY text)
SELECT doc_id, coalesce(ids, '') AS license_ids, coalesce(n, 0)::int AS n_licenses, top AS best_containment, first::int AS first_word
FROM documents LEFT JOIN listed USING (text)
""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"), template_table(spark))
    return found.select(
        "doc_id",
        F.array_join("licenses.license_id", ",").alias("license_ids"),
        F.size("licenses").alias("n_licenses"),
        F.round(F.array_max("licenses.containment"), 6).alias("best_containment"),
        F.array_min("licenses.first_word").alias("first_word"),
    )


@query("op6_balanced_shards")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("text").isNull(), 1).otherwise(F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = balanced_shards(rows, ["doc_id", "text_crc32", "size"], "size", SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op7_line_field_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_from_labels(docs, table(spark, folder, "labels"))
    judged = apply_quality_rules(docs.select("doc_id", "text"), model)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_content_lines", "content_share",
    )


@query("op8_unigram_languages")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    learnt = learn_languages(docs.where(~held_out), vocabulary_bytes())
    found = identify_languages(docs.select("doc_id", "text"), learnt)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _span_list(spans):
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


@query("op9_secret_worklist")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(_span_list(base).cast("binary"), 256).alias("base_sha256"),
        _span_list(F.col("secrets")).alias("spans"),
    )


_SQL_WORDS = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"
_DOC_WORDS = _SQL_WORDS.format(text="coalesce(text, '')", pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@query(
    "op10_benchmark_windows",
    f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_DOC_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id::varchar AS item_id, {_DOC_WORDS} AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
items AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
item_windows AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS said FROM items),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n),
doc_windows AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS said FROM places),
found AS MATERIALIZED (SELECT r, n, p, item_id FROM doc_windows JOIN item_windows USING (n, said)),
hits AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS word FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def contaminated():
    """At least one word in 20 is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


@query("op11_cube_source_mix")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


#: Runs of letters; the query looks for those that can become a word of seven
_LETTER_RUN = "[a-zÀ-ÿ]{%d,}" % spelling.MIN_LENGTH


def slip(doc_id, run: str) -> str:
    """The contract's rule: in one of 31 pairs of document and run, one code point of the run is lost."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


@query("op12_spelling_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts = spelling.word_counts(docs, _LETTER_RUN, key="doc_id", rewrite=slip)
    return spelling.spelling_groups(counts).select("word", "n", "n_near", "form", "form_n", "root")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The contract's rule: in one of ten documents the words from one on are replaced by repeats of the first of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    n = F.size("w")
    start = (F.col("g") % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + F.col("g") % 8))).cast("int")
    unit = F.slice("w", start + 1, period)
    times = F.ceil((n - start) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - start)
    folded = F.array_join(F.concat(F.slice("w", F.lit(1), start), tail), " ")
    return words.select("doc_id", F.when(F.size("w") > 0, folded).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(repeated_tails(table(spark, folder, "documents")))
    said = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.transform(said, lambda line: F.concat(line, F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
