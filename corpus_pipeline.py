"""Training-corpus pipeline: quality, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import bpe, decontaminate, jaccard, pii, quality
from keepsake.llm.common import bucket, stored
from keepsake.llm.queries import table, tokenizer

#: Documents whose score is lower go.
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier doesn't reject; it learns from the labels of four fifths of the keys."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), bucket(F.col("doc_id"), 5) != 0)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    scored = quality.score(docs.toDF(*names), machine, text=names[docs.columns.index("text")], keep=True)
    return scored.where(F.col("score") >= LEAST_QUALITY).drop("score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that with the smallest doc_id. Rows of one doc_id are one document and stay or go together."""
    groups = jaccard.near_groups(docs)
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    # rows without an id take part in no group and stay
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none and stay; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders and counts characters anew. Null texts stay null, with null counted for them; all rows stay."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of token ids and digests of ids and decoded text, a row a document; a null text counts as empty."""
    return bpe.digests(bpe.encode(docs, tokenizer("word_bpe_49k.json")))


STAGES = [("quality classifier", quality_filter), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("BPE encoding and decoding", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
