"""Readers for retrieval evaluation sets: corpus and queries as JSONL, judgements as TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, title string, text string").json(path)


def queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, text string").json(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("scene_id string, candidate_doc_ids array<string>").json(path)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid string, doc_id string, relevance int").csv(path, sep="\t")
