"""A training corpus from raw documents: quality rules, near duplicates, benchmark passages, secrets, packing.

All stages take an empty table (and return one), null and repeated keys, rows that are equal in all columns, texts of any
length, and extra columns whatever their names, which all but the last hand on. What a null or empty text comes to is said
at each stage; ties are broken by key, so a stage that runs again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandnet.llm.decontaminate import find_contamination
from bandnet.llm.minhash import near_duplicates
from bandnet.llm.packing import pack_best_fit, token_pieces
from bandnet.llm.quality import apply_quality_rules, fit_from_labels
from bandnet.llm.queries import PACK_CAPACITY, PACK_END_ID, contaminated, table, vocabulary
from bandnet.llm.secrets import scan_secrets
from bandnet.llm.storage import release, stored

#: Tokenization and the line field have no SQL form
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and whose lines are mostly content.

    Null and empty texts have no words and go; equal rows stay or go together. Without a usable label every line is content.
    """
    model = fit_from_labels(docs, table(spark, sf_dir, "labels"))
    return apply_quality_rules(docs, model).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id (null last; of equal ones one row).

    Every null text is a class of its own and stays; empty texts, and texts without words that are equal, are one class.
    """
    return near_duplicates(docs).where("first_of_class").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 is in a benchmark window.

    Null and empty texts, which have no words, stay, as do all documents if the benchmark is empty; equal rows are judged alike.
    """
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~contaminated()).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret and ``n_chars`` counted anew.

    A null text stays null and its ``n_chars`` becomes null; an empty one stays as it is.
    """
    found = scan_secrets(docs, redact=True).withColumn("text", F.col("redacted"))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences.

    A null or empty text is one piece of the end token; a text longer than a sequence is cut into pieces; equal rows have
    pieces of their own.
    """
    pieces = token_pieces(docs, vocabulary(), ["doc_id"], end_id=PACK_END_ID, capacity=PACK_CAPACITY)
    return pack_best_fit(pieces, capacity=PACK_CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again.

    What a stage read is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"), docs
        release(before)
    return docs
