"""Memories, episodes and profiles derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed instants: the first memory's time, and the `now` of all queries (2024-03-01), in seconds.
FIRST, NOW = 1704067200, 1709251200.0

CTES = """
memory AS (
  SELECT d.doc_id + 1 AS id, 'agent' || (d.doc_id % 3) AS agent_id,
    CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE d.lang END AS project_id,
    CASE WHEN d.doc_id % 53 = 0 THEN 'discord' WHEN d.doc_id % 5 = 0 THEN '' ELSE d.source END AS channel,
    CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'm' || (d.doc_id % 400) END AS msg_id,
    CASE WHEN d.doc_id % 37 = 0 THEN '[Memory from Bob] ' || d.text WHEN d.doc_id % 41 = 0 THEN '<@123> ' || d.text
         WHEN d.doc_id % 43 = 0 THEN '' WHEN d.doc_id % 47 = 0 THEN 'abc' WHEN d.doc_id % 59 = 0 THEN '[Ann] ' || d.text ELSE d.text END AS content,
    CASE d.doc_id % 10 WHEN 0 THEN '{"type":"User","id":"","name":""}' WHEN 1 THEN '{"type":"assistant","id":"a' || (d.doc_id % 7) || '"}'
         WHEN 2 THEN '{"User":"u' || (d.doc_id % 5) || '"}' WHEN 3 THEN '{}' WHEN 4 THEN '{bad' WHEN 5 THEN '"assistant"' WHEN 6 THEN '{"type":"migration"}'
         WHEN 7 THEN '{"System":"ep"}' ELSE '{"type":"User","id":"Discord:' || (d.doc_id % 13) || '","name":"n"}' END AS source,
    CASE WHEN d.doc_id % 31 = 0 THEN '{oops' WHEN d.doc_id % 106 = 0 THEN '{"session_id":"' || (d.doc_id % 9) || '77:u:1"}' ELSE '{}' END AS metadata,
    CASE WHEN d.doc_id % 17 = 0 THEN '' WHEN d.doc_id % 19 = 0 THEN 'x' WHEN d.doc_id % 23 = 0 THEN strftime(TIMESTAMP '2024-01-01' + d.doc_id * 7 * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S')
         WHEN d.doc_id % 29 = 0 THEN strftime(TIMESTAMP '2024-01-01' + d.doc_id * 7 * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+09:00'
         ELSE strftime(TIMESTAMP '2024-01-01' + d.doc_id * 7 * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS "timestamp",
    CASE WHEN d.doc_id % 17 = 0 OR d.doc_id % 19 = 0 THEN NULL ELSE CAST(1704067200 + d.doc_id * 420 AS DOUBLE) - CASE WHEN d.doc_id % 23 <> 0 AND d.doc_id % 29 = 0 THEN 32400 ELSE 0 END END AS seconds,
    strftime(TIMESTAMP '2024-01-01' + d.doc_id * 7 * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS created_at,
    e.embedding AS embedding, d.doc_id % 6 AS recall_count,
    CASE WHEN d.doc_id % 6 > 0 THEN CAST(1704067200 + d.doc_id * 420 + 86400 AS DOUBLE) END AS last_recalled,
    d.doc_id % 11 = 0 AS locked
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
episode AS (
  SELECT c.id, c.agent_id, c.project_id, c.channel, c.summary, c.keywords, e.embedding AS embedding, c.start_time, c.end_time, c.resolved, c.created_at FROM (
  SELECT conv_id + 1 AS id, 'agent' || (conv_id % 3) AS agent_id, '' AS project_id, CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'src' || (conv_id % 20) END AS channel,
    coalesce(min(CASE WHEN turn = 0 THEN text END), '') AS summary, coalesce(min(role), '') || ' ' || coalesce(max(role), '') AS keywords,
    CASE WHEN conv_id % 7 = 0 THEN NULL ELSE strftime(TIMESTAMP '2024-01-01' + conv_id * 3 * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') END AS start_time,
    strftime(TIMESTAMP '2024-01-01' + conv_id * 3 * INTERVAL 1 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS end_time,
    conv_id % 5 = 0 AS resolved, strftime(TIMESTAMP '2024-01-01' + conv_id * 3 * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM conversations GROUP BY conv_id) c LEFT JOIN embeddings e ON e.vec_id = c.id - 1),
profile AS (
  SELECT 1 AS id, 'agent0' AS agent_id, '' AS user_id, 'likes orchards and pears' AS content, '2024-02-20 00:00:00' AS updated_at
  UNION ALL SELECT 2, 'agent1', '', 'prefers short answers', '2024-01-05 00:00:00')
"""


def _time(key: str, minutes: int, pattern: str, shift: int = 0) -> str:
    return f"date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {key} * {minutes} + {shift}, 0), \"{pattern}\")"


@dataclass
class Views:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id"), "embedding")

    @cached_property
    def memory(self) -> DataFrame:
        d = self.table("documents").join(self.vectors, F.col("vec_id") == F.col("doc_id"), "left")
        k = F.col("doc_id")
        text = F.col("text")
        num = lambda n: (k % n).cast("string")
        cat = F.concat
        at = 1704067200 + k * 420
        source = F.element_at(
            F.array(
                F.lit('{"type":"User","id":"","name":""}'), cat(F.lit('{"type":"assistant","id":"a'), num(7), F.lit('"}')), cat(F.lit('{"User":"u'), num(5), F.lit('"}')), F.lit("{}"), F.lit("{bad"), F.lit('"assistant"'), F.lit('{"type":"migration"}'), F.lit('{"System":"ep"}'),
                *[cat(F.lit('{"type":"User","id":"Discord:'), num(13), F.lit('","name":"n"}'))] * 2,
            ),
            (k % 10 + 1).cast("int"),
        )
        odd = (k % 23 != 0) & (k % 29 == 0)
        return d.select(
            (k + 1).alias("id"),
            cat(F.lit("agent"), num(3)).alias("agent_id"),
            F.when(k % 4 == 0, "").otherwise(F.col("lang")).alias("project_id"),
            F.when(k % 53 == 0, "discord").when(k % 5 == 0, "").otherwise(F.col("source")).alias("channel"),
            F.when(k % 3 == 0, "").otherwise(cat(F.lit("m"), num(400))).alias("msg_id"),
            F.when(k % 37 == 0, cat(F.lit("[Memory from Bob] "), text)).when(k % 41 == 0, cat(F.lit("<@123> "), text)).when(k % 43 == 0, "").when(k % 47 == 0, "abc").when(k % 59 == 0, cat(F.lit("[Ann] "), text)).otherwise(text).alias("content"),
            source.alias("source"),
            F.when(k % 31 == 0, "{oops").when(k % 106 == 0, cat(F.lit('{"session_id":"'), num(9), F.lit('77:u:1"}'))).otherwise("{}").alias("metadata"),
            F.when(k % 17 == 0, "").when(k % 19 == 0, "x").when(k % 23 == 0, F.expr(_time("doc_id", 7, "yyyy-MM-dd HH:mm:ss"))).when(k % 29 == 0, F.expr(_time("doc_id", 7, "yyyy-MM-dd'T'HH:mm:ss'+09:00'"))).otherwise(F.expr(_time("doc_id", 7, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("timestamp"),
            F.when((k % 17 != 0) & (k % 19 != 0), at.cast("double") - F.when(odd, 32400).otherwise(0)).alias("seconds"),
            F.expr(_time("doc_id", 7, "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
            "embedding",
            (k % 6).alias("recall_count"),
            F.when(k % 6 > 0, (at + 86400).cast("double")).alias("last_recalled"),
            (k % 11 == 0).alias("locked"),
        )

    @cached_property
    def episode(self) -> DataFrame:
        c = self.table("conversations").groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.col("turn") == 0, F.col("text"))), F.lit("")).alias("summary"), F.concat(F.coalesce(F.min("role"), F.lit("")), F.lit(" "), F.coalesce(F.max("role"), F.lit(""))).alias("keywords"))
        k = F.col("conv_id")
        start = F.expr(_time("conv_id", 180, "yyyy-MM-dd HH:mm:ss"))
        return c.join(self.vectors, F.col("vec_id") == k, "left").select(
            (k + 1).alias("id"),
            F.concat(F.lit("agent"), (k % 3).cast("string")).alias("agent_id"),
            F.lit("").alias("project_id"),
            F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("src"), (k % 20).cast("string"))).alias("channel"),
            "summary",
            "keywords",
            "embedding",
            F.when(k % 7 != 0, start).alias("start_time"),
            F.expr(_time("conv_id", 180, "yyyy-MM-dd HH:mm:ss", 30)).alias("end_time"),
            (k % 5 == 0).alias("resolved"),
            start.alias("created_at"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        rows = [(1, "agent0", "", "likes orchards and pears", "2024-02-20 00:00:00"), (2, "agent1", "", "prefers short answers", "2024-01-05 00:00:00")]
        return self.spark.createDataFrame(rows, "id long, agent_id string, user_id string, content string, updated_at string")

    def vector(self, vec_id: int) -> list[float]:
        """The embedding of one row, a query's vector."""
        return list(self.vectors.where(F.col("vec_id") == vec_id).first().embedding)
