"""Ranking quality and latency figures."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(ndcg): mean over queries with relevant documents, times 100. ranked: qid, doc_id, rank from 1; qrels: qid, doc_id, relevance."""
    good = qrels.where("relevance > 0").select("qid", "doc_id").distinct()
    gain = ranked.where(F.col("rank") <= k).join(good, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(log(2) / F.ln(F.col("rank") + 1)).alias("dcg"))
    ideal = good.groupBy("qid").agg(F.count("*").alias("n")).withColumn("best", F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + log(2) / F.ln(r + 1)))
    return ideal.join(gain, "qid", "left").agg((100 * F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("best"))).alias("ndcg"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(membership_changed, order_changed, jaccard): how two rankings of the same queries differ in their first k."""
    top = lambda df, n: df.where(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(n))
    both = top(a, "x").join(top(b, "y"), "qid", "full").select(*[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("x", "y")])
    union = F.size(F.array_union("x", "y"))
    same = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / union)
    return both.agg((100 * F.avg((same < 1).cast("int"))).alias("membership_changed"), (100 * F.avg((F.col("x") != F.col("y")).cast("int"))).alias("order_changed"), F.avg(same).alias("jaccard"))


def latency(rows: DataFrame, column: str, by: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(by, p50, ..., mean) with quantile q at index floor(n q) of the sorted values, not interpolated."""
    ranked = rows.withColumns({"i": F.row_number().over(W.partitionBy(by).orderBy(column)), "n": F.count("*").over(W.partitionBy(by))})
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * q) + 1, F.col("n")), F.col(column))).alias(f"p{round(100 * q)}")
    return ranked.groupBy(by).agg(*map(at, quantiles), F.avg(column).alias("mean"))
