"""Cleaning of ``documents``: language, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. ``run`` writes every stage's result as Parquet in the shared folder and
reads it again, so a lost executor costs at most the stage it was lost in.

Defined results of every stage: an empty table gives an empty one; columns of
any name, nulls in them included, pass through the first four stages untouched
but for ``text`` and ``n_chars`` of the fourth; rows are judged by their text
alone, so repeated rows and rows of one id are treated alike, whole texts of any
length are read, and null ids are kept; a null text is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language_id, order_minhash, packing, pii, toxicity
from weftline.llm.common import shared_dir, table

#: A document goes if fewer of its n-grams than this belong to its best language.
LEAST_LANGUAGE = 0.2


def _wrapped(docs: DataFrame) -> DataFrame:
    """A document's columns as one struct beside its text, so that no column clashes with a stage's own."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters or belong to no learned language.

    Null and empty texts have no letters. Where no document has a language to
    learn from, every document with a letter stays.
    """
    filters = language_id.fit_on_documents(docs)
    if not filters.languages:
        return docs.where(F.col("text").cast("string").rlike("\\p{L}"))
    out = language_id.predict(spark, _wrapped(docs), filters)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def keep_clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted to be toxic; without labels all stay."""
    lexicon = toxicity.fit_on_documents(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(spark, _wrapped(docs), lexicon).where("score < 0.5").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id.

    Of equal rows one stays, of unlike texts with one id each that leads its
    class; in a class without ids one of its rows stays.
    """
    return order_minhash.one_of_each(spark, docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text (null stays null)."""
    out = pii.redacted(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets; an empty text is one piece of the end id."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("language", keep_known_language),
    ("toxicity", keep_clean_language),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark).rstrip('/')}/weftline/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs


#: The stages learn models and pack by rank; tests hold them against brute force instead.
ORACLE_SQL = None
