"""From raw documents to token digests: language, near copies, personal data, mix, pieces.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; stages are written and read again in
between. Language filters are learnt from the stage's own labelled rows, ``lang`` is never read for a decision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import jaccard_join, langid, mixing, pieces, pii
from cargolens.session import shared_dir

#: A text whose language knows less of its n-grams than this is no text in any learnt language.
LEAST_SHARE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or in no learnt language; ``lang`` becomes the predicted one."""
    filters = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs, filters, prefix="_lang_")
    kept = found.where((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_share") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col("_lang_pred")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms; n_chars follows the new text."""
    masked = pii.mask(docs, counts=False)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that is left."""
    return pieces.encode(docs).select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_copies", near_copies), ("personal", personal), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None  # language filters, near copies and pieces have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
