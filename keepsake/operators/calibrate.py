"""Threshold calibration from similarity distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scoring import dot, unit

SAMPLE, MOST_SAMPLE, LEAST_SAMPLE = 200, 2000, 10
FLOOR, PERCENTILE, Z = 0.05, 0.95, 1.0
STEPS = 256
ADJACENT_SECONDS = 30 * 60
#: Weight of false admissions.
PRECISION = {"strict": 2.0, "balanced": 1.0, "lenient": 0.5}


def sample(rows: DataFrame, n: int = SAMPLE, seed: int | None = None) -> DataFrame:
    """At most n rows (2000 at most) with an embedding of the most frequent dimension, the smaller one on ties; random with a seed, else lowest ids."""
    n = max(0, min(n, MOST_SAMPLE))
    found = rows.where("embedding is not null").withColumn("dim", F.size("embedding"))
    modal = found.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).select("dim")
    found = found.join(F.broadcast(modal), "dim")
    return found.orderBy(F.rand(seed) if seed is not None else F.col("id"), "id").limit(n).drop("dim")


def pairs(few: DataFrame) -> DataFrame:
    """(a, b, sim) for all pairs a < b of a sample of at most MOST_SAMPLE rows; never for a table."""
    few = few.select("id", "embedding")
    left = few.select(F.col("id").alias("a"), F.col("embedding").alias("u"))
    right = few.select(F.col("id").alias("b"), F.col("embedding").alias("v"))
    return left.join(F.broadcast(right), F.col("a") < F.col("b")).select("a", "b", dot(F.col("u"), F.col("v")).alias("sim"))


def adjacent(rows: DataFrame, seconds: str = "seconds") -> DataFrame:
    """(id, sim) of rows that follow another of their agent within half an hour; vectors are scaled to length one.

    The row before lies in the same half hour or in the one before, so rows meet by
    (agent, half hour), to which the last row of the half hour before is added; an agent
    with a third of all rows is no hot key.
    """
    slim = rows.select("agent_id", "id", F.col(seconds).alias("seconds"), unit(F.col("embedding")).alias("v")).withColumn("bin", F.floor(F.col("seconds") / ADJACENT_SECONDS).cast("long"))
    last = slim.groupBy("agent_id", "bin").agg(F.max(F.struct("seconds", "id", "v")).alias("x")).select("agent_id", (F.col("bin") + 1).alias("bin"), "x.id", "x.seconds", "x.v", F.lit(False).alias("own"))
    both = slim.withColumn("own", F.lit(True)).unionByName(last)
    by = W.partitionBy("agent_id", "bin").orderBy("seconds", "id")
    found = both.withColumns({"before": F.lag("seconds").over(by), "u": F.lag("v").over(by)})
    return found.where(F.col("own") & (F.col("seconds") - F.col("before") <= ADJACENT_SECONDS) & (F.size("u") == F.size("v"))).select("id", dot(F.col("u"), F.col("v")).alias("sim"))


def nearest(sims: DataFrame) -> DataFrame:
    """(id, sim): each sampled row's largest similarity with another."""
    return sims.select(F.col("a").alias("id"), "sim").union(sims.select(F.col("b").alias("id"), "sim")).groupBy("id").agg(F.max("sim").alias("sim"))


def by_percentile(sims: DataFrame, p: float = PERCENTILE) -> DataFrame:
    p = p / 100 if p > 1 else p
    return sims.agg(F.round(F.greatest(F.percentile("sim", p), F.lit(FLOOR)), 4).alias("threshold"))


def by_zscore(sims: DataFrame, z: float = Z) -> DataFrame:
    z = max(-10.0, min(10.0, z))
    return sims.agg(F.round(F.greatest(F.avg("sim") + z * F.stddev_pop("sim"), F.lit(FLOOR)), 4).alias("threshold"))


def distribution(sims: DataFrame, threshold: float | None = None) -> DataFrame:
    """(n, mean, std, median, p95) and, with a threshold, the share of similarities that it admits."""
    admitted = [] if threshold is None else [F.avg((F.col("sim") >= threshold).cast("double")).alias("admit_rate")]
    return sims.agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"), F.median("sim").alias("median"), F.percentile("sim", 0.95).alias("p95"), *admitted)


def by_separation(null: DataFrame, positive: DataFrame, beta: float = 1.0, steps: int = STEPS) -> DataFrame:
    """(threshold, objective): of `steps` evenly spaced candidates the first that maximises TPR + beta (1 - FPR).

    Similarities are turned into candidates' bins once and counted, so the sweep
    is a running sum over `steps` rows, not a product of candidates and pairs.
    """
    both = null.select("sim", F.lit(0).alias("pos")).union(positive.select("sim", F.lit(1).alias("pos")))
    ends = both.agg(F.min("sim").alias("low"), F.max("sim").alias("high"))
    step = (F.col("high") - F.col("low")) / (steps - 1)
    # the candidates a row passes are 0..bin
    binned = both.join(F.broadcast(ends)).withColumn("bin", F.when(F.col("high") > F.col("low"), F.floor((F.col("sim") - F.col("low")) / step + 1e-12)).otherwise(0))
    counts = binned.groupBy("bin").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("n"))
    grid = both.sparkSession.range(steps).select(F.col("id").alias("bin")).join(counts, "bin", "left").fillna(0)
    later = W.orderBy(F.desc("bin"))  # over `steps` rows
    swept = grid.withColumns({"tp": F.sum("p").over(later), "fp": F.sum("n").over(later), "tps": F.sum("p").over(W.partitionBy()), "fps": F.sum("n").over(W.partitionBy())})
    scored = swept.withColumn("objective", F.col("tp") / F.greatest("tps", F.lit(1)) + beta * (1 - F.col("fp") / F.greatest("fps", F.lit(1))))
    best = scored.orderBy(F.desc("objective"), "bin").limit(1).join(F.broadcast(ends))
    value = F.when(F.col("high") > F.col("low"), F.col("low") + F.col("bin") * step).otherwise(F.col("low"))
    return best.select(F.round(F.greatest(value, F.lit(FLOOR)), 4).alias("threshold"), F.when(F.col("high") > F.col("low"), F.col("objective")).otherwise(0.0).alias("objective"))


def upper_median(draws: DataFrame, column: str = "threshold") -> DataFrame:
    """The value at place n // 2 of the sorted draws."""
    by = W.orderBy(column)  # a handful of draws
    return draws.withColumns({"i": F.row_number().over(by) - 1, "n": F.count("*").over(W.partitionBy())}).where("i = floor(n / 2)").select(column)


def labelled(results: DataFrame, window_seconds: int = ADJACENT_SECONDS) -> DataFrame:
    """Simulated queries: a result counts as relevant if it lies within the window of its query's time (qid, q_seconds, seconds, score)."""
    return results.withColumn("pos", (F.abs(F.col("seconds") - F.col("q_seconds")) <= window_seconds).cast("int"))


def stale(stored_dimension: int | None, stored_version: str | None, dimension: int, version: str, age_days: float, most_days: float = 90) -> bool:
    """Whether a stored calibration no longer fits."""
    return stored_dimension != dimension or stored_version != version or age_days > most_days
