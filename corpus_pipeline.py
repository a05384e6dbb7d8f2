"""A training-data pipeline over `documents`: classify, deduplicate, mask, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`, extra columns of any name included. Every stage takes null
ids, texts, languages and sources, empty and very long texts, repeated rows and empty tables; what it makes of them is said
with each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import mixing, neardup, personal, pieces, quality
from tapeloom.llm.common import documents, shared_folder


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, doesn't reject; each row is judged by
    its own text, a null one as an empty one, so repeated rows go or stay together. Without usable labels every score is 0.5
    and all rows stay."""
    machine = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, machine)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of the least id (a null one only if all are). Texts without words are alike
    to nothing: of each id one such row stays. Of rows that are equal in id and text, any one is the one."""
    return neardup.unique(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows. Null texts stay null, with a null n_chars; all rows
    stay."""
    done = personal.masked(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them. Null is a source of its own; null and empty texts have size 0 and come
    as often as their source's documents; rows of one id share their fate. A source without words is left out."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the pieces of the text: null of a null text, none of an empty one."""
    rows = pieces.encoded(docs)
    return rows.select("doc_id", "lang", "source", "ids", F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.size("ids")).alias("n_pieces"))


STAGES = [
    ("quality classifier", classified),
    ("near-dedup", deduplicated),
    ("personal data", masked),
    ("source mix", mixed),
    ("sentencepiece", encoded),
]

#: The classifier is trained, near duplicates are a closure, and pieces are a search: SQL can't state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read from there."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/stage-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
