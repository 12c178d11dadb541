"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept, and its
decisions take effect: rejected documents go, of near-duplicates one stays, repeated passages and
personal data leave the texts, and the rest is tokenised and packed. All but the last stage return
the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import jaccard, packing, phrase_dedup, pii, quality
from lodeframe.llm.tables import read, written

#: Some stage trains a model or matches approximate candidates, which SQL can't express.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has leave the text."""
    return _counted(phrase_dedup.deduplicated(docs))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _counted(pii.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in padded sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("pii", mask_personal),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
