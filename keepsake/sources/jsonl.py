"""JSONL export and import of memories, episodes and profiles, one typed record a line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "keepsake-export/1.0"
FIELDS = {
    "memory": ("id", "agent_id", "msg_id", "content", "source", "timestamp", "metadata", "created_at", "project_id", "channel", "locked", "recall_count", "last_recalled"),
    "episode": ("id", "agent_id", "summary", "keywords", "start_time", "end_time", "created_at", "resolved", "project_id", "channel"),
    "profile": ("agent_id", "user_id", "content", "updated_at", "project_id"),
}
SCHEMA = "_type string, version string, memory_count long, episode_count long, profile_count long, id long, agent_id string, msg_id string, content string, source string, timestamp string, metadata string, created_at string, project_id string, channel string, locked boolean, recall_count long, last_recalled double, summary string, keywords string, start_time string, end_time string, resolved boolean, user_id string, updated_at string, embedding_b64 string, _bad string"


def records(memory: DataFrame, episode: DataFrame, profile: DataFrame, agent: str | None = None) -> DataFrame:
    """(line): a header with counts, then the records. All of one snapshot: DataFrames are immutable."""
    tables = {k: (df if agent is None else df.where(F.col("agent_id") == agent)) for k, df in (("memory", memory), ("episode", episode), ("profile", profile))}
    lines = []
    for kind, df in tables.items():
        columns = [F.col(c) for c in FIELDS[kind] if c in df.columns]
        if "embedding" in df.columns:
            columns.append(encode_embedding().alias("embedding_b64"))
        lines.append(df.select(F.to_json(F.struct(F.lit(kind).alias("_type"), *columns), {"ignoreNullFields": "false"}).alias("line")))
    count = lambda k: tables[k].agg(F.count("*").alias(f"{k}_count"))
    head = count("memory").join(count("episode")).join(count("profile"))  # three rows of one column
    head = head.select(F.to_json(F.struct(F.lit("header").alias("_type"), F.lit(VERSION).alias("version"), F.lit(agent).alias("agent_id"), "memory_count", "episode_count", "profile_count")).alias("line"))
    out = head
    for x in lines:
        out = out.unionAll(x)
    return out


def export(path: str, memory: DataFrame, episode: DataFrame, profile: DataFrame, agent: str | None = None) -> None:
    """Writes records as text; the writer's commit makes the folder appear whole or not at all."""
    records(memory, episode, profile, agent).write.text(path)


def parsed(lines: DataFrame) -> DataFrame:
    """The records of JSON lines (value) with `seq` (their order within the read) and `_bad` for lines that are no JSON; unknown types are kept for the caller."""
    rows = lines.withColumn("r", F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_bad"})).withColumn("seq", F.monotonically_increasing_id())
    return rows.select("seq", "r.*")


def load(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path).where("trim(value) <> ''"))


def problems(rows: DataFrame) -> DataFrame:
    """(problem, n): unreadable lines, unknown types, and counts that differ from the header's."""
    stats = rows.agg(
        F.count_if(F.col("_bad").isNotNull()).alias("bad_json"),
        F.count_if(F.col("_bad").isNull() & ~F.coalesce("_type", F.lit("")).isin("header", *FIELDS)).alias("unknown_type"),
        *[F.abs(F.count_if(F.col("_type") == k) - F.coalesce(F.max(f"{k}_count"), F.lit(0))).alias(f"{k}_count_differs") for k in FIELDS],
    )
    return stats.unpivot([], stats.columns, "problem", "n").where("n > 0")


def decode_embedding(column: str = "embedding_b64") -> Column:
    """Little-endian 32-bit floats in base64 as array<float>; null where the length isn't a multiple of four."""
    @F.pandas_udf("array<float>")
    def unpack(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return unpack(F.try_to_binary(F.col(column), F.lit("base64")))


def encode_embedding(column: str = "embedding") -> Column:
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.base64(pack(F.col(column)))
