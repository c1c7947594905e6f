"""Corpus pipeline: language, near-duplicates, repeated strings, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import jaccard_join, language_id, packing, secret_scan, suffix_dedup
from matchgrid.llm.common import read_table, stored
from matchgrid.llm.queries import END_ID, PIECES, WORDS
from matchgrid.session import small_side

#: A text whose best language is less sure than this is rejected, and so is a text without a letter.
SURE = 0.5
#: Near-duplicates share this many percent of their rows of so many words (op6 has its own, stricter test).
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of a repeated string: passages of 50 words are longer than this, though not all have op8's 400.
REPEATED = 256


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs`` and the number of characters counted anew."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; ``lang`` is the predicted one."""
    vocab = public_tokenizers.path(PIECES)
    labels, model = language_id.fit(language_id.sample(docs.where(~language_id.held_out())), vocab)
    found = language_id.classified(docs, vocab, labels, model)
    return found.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= SURE)).withColumn("lang", F.col("__lang")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id (of equal ids: the smallest digest of the text).

    Rows are judged by id and text, so other texts of an id that goes stay. Of rows with the same id and text one stays,
    null text counting as empty. Rows without an id stay.
    """
    d = docs.withColumn("__row", F.struct("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")))
    named = d.where("doc_id is not null")
    groups = jaccard_join.join(named.select("__row", "text"), "__row", words=NEAR_WORDS, percent=NEAR_PERCENT)[0]
    rows = stored(groups.groupBy("__row").agg(F.max(F.col("__row") != F.col("component_id")).alias("gone"), F.count("*").alias("copies")))
    # Only rows that stand more than once are compared as rows; the others need no shuffle of their texts.
    gone, twice = (stored(rows.where(c).select("__row")) for c in ("gone", "not gone and copies > 1"))
    once = named.join(small_side(gone.unionByName(twice)), "__row", "left_anti")
    again = named.join(small_side(twice), "__row", "left_semi").dropDuplicates(["__row"])
    return once.unionByName(again).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur more than once in the corpus."""
    return _like(docs, suffix_dedup.without_repeats(docs, length=REPEATED))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _like(docs, secret_scan.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one piece each, with its token ids."""
    return packing.pack(docs, public_tokenizers.path(WORDS), END_ID)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("secret_scan", without_secrets),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
