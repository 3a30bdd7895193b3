"""A corpus pipeline over ``documents``: quality, language, near-duplicates, packing.

Every stage takes all rows that the one before kept, as a written table, and all but the last return the columns of
``documents``. Stages do not depend on each other's models: each is trained on the rows it is given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import langid, packing, quality, simhash
from tidewatch.llm.common import crc_bucket, documents, scratch_dir, table

#: A document is kept from this quality score, and from this probability of its language, on. A text in two languages
#: has about one half for each and stays.
MIN_QUALITY, MIN_LANGUAGE = 0.5, 0.35


def _carried(docs: DataFrame) -> DataFrame:
    """The whole row beside its text, so that no result column can clash with a column of the table."""
    return docs.select(F.struct("*").alias("row"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier scores at least ``MIN_QUALITY``."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 4) != 2)
    return quality.score(_carried(docs), model).where(F.col("score") >= MIN_QUALITY).select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a known language, recognised with at least ``MIN_LANGUAGE``."""
    model = langid.train(docs, crc_bucket("doc_id", 3) != 1)
    found = langid.predict(_carried(docs), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: texts whose fingerprints of three-word shingles differ in at most
    three bits, directly or through others, as the SimHash operator's contract says."""
    return simhash.representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Trained models and tokenizers are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
