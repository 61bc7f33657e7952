"""Fusion of candidate lists, scoring, gates and cuts.

Lists are DataFrames (qid, kind, id, list, pos, score): list numbers them (0 vector,
1 episodes, 2 keywords), pos is the place in the list from 0. `ord` keeps the order
in which rows first appear, list by list, which breaks ties everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scoring import RRF_K, RRF_SCALE, adaptive_least, boundary_penalty

KEY = ("qid", "kind", "id")
GAP_RATIO, GAP_ROWS = 0.15, 3
#: Decimal places to which fused scores are told apart.
PLACES = 9
#: Profiles that a recall takes in, and characters of a preview.
PROFILES, PREVIEW = 3, 500


def listed(rows: DataFrame, number: int, order: list[Column], score: str) -> DataFrame:
    """A candidate list. Places are given before rows are excluded, so excluded rows use theirs up."""
    place = F.row_number().over(W.partitionBy("qid").orderBy(*order)) - 1
    return rows.select(*KEY, F.lit(number).alias("list"), place.alias("pos"), F.col(score).cast("double").alias("score"), *[c for c in ("excluded",) if c in rows.columns])


def united(lists: list[DataFrame]) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)
    return rows.where(~F.coalesce("excluded", F.lit(False))).drop("excluded") if "excluded" in rows.columns else rows


def _fused(rows: DataFrame, score: Column, name: str) -> DataFrame:
    first = F.min(F.struct("list", "pos"))
    out = rows.groupBy(*KEY).agg(score.alias(name), F.max(F.when(F.col("list") == 0, F.col("score"))).alias("cosine"), F.max(F.when(F.col("list") > 0, F.col("score"))).alias("bm25"), first.alias("first"))
    order = F.row_number().over(W.partitionBy("qid").orderBy(F.round(name, PLACES).desc(), "first.list", "first.pos"))
    return out.withColumn("ord", order).drop("first")


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + place + 1), best first by `ord`."""
    rows = united(lists).withColumn("part", F.col("list") * 1_000_000_000 + F.col("pos"))
    terms = F.sort_array(F.collect_list(F.struct("part", (1 / (F.lit(k) + F.col("pos") + 1)).alias("x"))))
    return _fused(rows, F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["x"]), "rrf")  # summed in list order, so that equal rows get equal sums


def rsf(lists: list[DataFrame]) -> DataFrame:
    """Relative score fusion: each list scaled to 0..1 (all null or flat: 1, single nulls: 0), averaged over the lists with rows."""
    rows = united(lists)
    by = W.partitionBy("qid", "list")
    low, high = F.min("score").over(by), F.max("score").over(by)
    norm = F.when(high.isNull() | (high <= low), 1.0).otherwise(F.coalesce((F.col("score") - low) / (high - low), F.lit(0.0)))
    active = F.size(F.collect_set("list").over(W.partitionBy("qid")))
    rows = rows.withColumns({"norm": norm, "active": active})
    terms = F.sort_array(F.collect_list(F.struct("list", F.col("norm").alias("x"))))
    return _fused(rows, F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["x"]) / F.max("active"), "rsf")


def cascade(lists: list[DataFrame], limit: int, profiles: DataFrame | None = None) -> DataFrame:
    """Lists one after the other, each row where it first appears: the vector list and the episodes whole, then the
    profiles, then of the keyword list its first so many rows as are missing to `limit`."""
    rows = united(lists)
    earlier = rows.where("list < 2")
    first = F.row_number().over(W.partitionBy(*KEY).orderBy("list", "pos"))
    out = earlier.withColumn("n", first).where("n = 1").drop("n")
    words = rows.where("list = 2")
    if profiles is not None:
        newest = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("updated_at"), "id")) - 1
        told = profiles.withColumn("pos", newest).where(F.col("pos") < PROFILES)
        out = out.unionByName(told.select("qid", F.lit("profile").alias("kind"), F.lit(-1).cast("long").alias("id"), F.lit(1).alias("list"), (F.lit(1 << 30) + F.col("pos")).alias("pos"), F.lit(None).cast("double").alias("score"), F.concat(F.lit("[Profile] "), "content").alias("content")), allowMissingColumns=True)
    taken = out.groupBy("qid").agg(F.count("*").alias("taken"))
    words = words.join(taken, "qid", "left").where(F.col("pos") < limit - F.coalesce("taken", F.lit(0))).drop("taken")
    both = out.unionByName(words.join(out.select(*KEY), list(KEY), "left_anti"), allowMissingColumns=True)
    ranked = both.withColumn("ord", F.row_number().over(W.partitionBy("qid").orderBy("list", "pos")))
    return ranked.select(*KEY, F.when(F.col("list") == 0, F.col("score")).alias("cosine"), F.when(F.col("list") > 0, F.col("score")).alias("bm25"), "ord", *[c for c in ("content",) if c in ranked.columns])


def with_profiles(fused: DataFrame, profiles: DataFrame, most: int = PROFILES) -> DataFrame:
    """Appends the newest profiles of a query's agent (qid, content, updated_at), unscored, after all others."""
    newest = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("updated_at"), "id"))
    rows = profiles.withColumn("n", newest).where(F.col("n") <= most).select("qid", F.lit("profile").alias("kind"), F.lit(-1).cast("long").alias("id"), (F.lit(1 << 30) + F.col("n")).alias("ord"), F.concat(F.lit("[Profile] "), "content").alias("content"))
    return fused.unionByName(rows, allowMissingColumns=True)


def backfilled(fused: DataFrame, embeddings: DataFrame, cosine: Column) -> DataFrame:
    """Fills missing cosines from the rows' embeddings (kind, id, embedding) and marks them."""
    rows = fused.join(embeddings, ["kind", "id"], "left")
    return rows.withColumn("backfilled", F.col("cosine").isNull() & F.col("embedding").isNotNull()).withColumn("cosine", F.coalesce("cosine", cosine)).drop("embedding")


def penalised(fused: DataFrame, seconds: str, boundary: Column) -> DataFrame:
    """Memories from before the latest session lose score: cosine and fused scores are scaled alike."""
    factor = F.when(F.col("kind") == "mem", F.coalesce(boundary_penalty(F.col(seconds), boundary), F.lit(1.0))).otherwise(1.0)
    scored = [c for c in ("cosine", "rrf", "rsf") if c in fused.columns]
    return fused.withColumn("factor", factor).withColumns({c: F.col(c) * F.col("factor") for c in scored})


def resorted(rows: DataFrame, score: str) -> DataFrame:
    """`ord` anew by a score, ties as before; rows without score sink."""
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("qid").orderBy(F.desc_nulls_last(score), "ord")))


def signal(columns: list[str]) -> Column:
    """Name of the score that speaks for a row: confidence, rsf, cosine, rrf, in this order."""
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("confidence", "rsf", "cosine", "rrf") if c in columns], F.lit(None).cast("string"))


def gate(rows: DataFrame, pool: Column, calibrated: dict[str, float] | None = None, deep: bool = False, empty_query: bool | Column = False, override: float | None = None) -> DataFrame:
    """Rows that pass the quality gate, with columns `signal` and `score`."""
    names = [c for c in ("confidence", "rsf", "cosine", "rrf") if c in rows.columns]
    half = 0.5 if deep else 1.0
    least = F.lit(override) if override is not None else adaptive_least(pool)
    asked = F.when(F.col("signal") == "rrf", least * RRF_SCALE).otherwise(least)
    for name, value in (calibrated or {}).items():
        asked = F.when(F.col("signal") == name, value).otherwise(asked)
    rows = rows.withColumn("signal", signal(rows.columns)).withColumn("score", F.coalesce(*[F.col(c) for c in names]) if names else F.lit(None).cast("double"))
    passes = F.when(F.col("kind") == "profile", pool >= 50).when(F.col("signal").isNull(), (pool >= 100) | (empty_query if isinstance(empty_query, Column) else F.lit(empty_query))).otherwise(F.col("score") >= asked * half)
    return rows.where(passes)


def rescued(passed: DataFrame, before: DataFrame) -> DataFrame:
    """passed, but where a query has nothing left except profiles and had backfilled rows, those; `fallback` tells."""
    kept = passed.groupBy("qid").agg(F.count_if(F.col("kind") != "profile").alias("kept"))
    state = before.groupBy("qid").agg(F.count_if("backfilled").alias("filled")).join(kept, "qid", "left").select("qid", ((F.coalesce("kept", F.lit(0)) == 0) & (F.col("filled") > 0)).alias("fallback"))
    name = signal(before.columns)
    told = before.withColumn("signal", name).withColumn("score", F.coalesce(*[F.col(c) for c in ("confidence", "rsf", "cosine", "rrf") if c in before.columns]))
    again = told.where("backfilled").join(state.where("fallback"), "qid")
    return passed.join(state, "qid", "left").unionByName(again, allowMissingColumns=True)


def autocut(rows: DataFrame, ratio: float = GAP_RATIO, least_rows: int = GAP_ROWS) -> DataFrame:
    """Cuts each query's rows at the first largest gap between neighbours, where that gap is a fair part of the best score.

    Rows that the gate refused (`fallback`) are not cut: their scores order nothing.
    """
    by = W.partitionBy("qid")
    has = lambda c: F.max(F.when(F.col("ord") == 1, F.col(c).isNotNull())).over(by) if c in rows.columns else F.lit(False)
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    ranked = rows.withColumn("ord", F.row_number().over(by.orderBy("ord")))
    every = F.min(col("cosine").isNotNull()).over(by)
    key = F.when(has("confidence"), col("confidence")).when(has("rsf") | has("rrf"), F.lit(None)).when(every, col("cosine"))
    ranked = ranked.withColumn("key", key)
    ranked = ranked.withColumn("gap", F.col("key") - F.lead("key").over(by.orderBy("ord")))
    ranked = ranked.withColumns({"top": F.max(F.when(F.col("ord") == 1, F.col("key"))).over(by), "rows": F.count("*").over(by), "widest": F.max("gap").over(by), "at": F.min_by("ord", F.struct(F.coalesce(-F.col("gap"), F.lit(float("inf"))), F.col("ord"))).over(by)})
    cuts = (F.col("rows") >= least_rows) & (F.col("top") > 0) & (F.col("widest") / F.col("top") >= ratio)
    if "fallback" in rows.columns:
        cuts = cuts & ~F.coalesce("fallback", F.lit(False))
    return ranked.where(~F.coalesce(cuts, F.lit(False)) | (F.col("ord") <= F.col("at"))).drop("key", "gap", "top", "rows", "widest", "at")


def last_best(rows: DataFrame, limit: int) -> DataFrame:
    """The best rows, best last: place 1 is the weakest."""
    kept = rows.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("ord"))).where(F.col("n") <= limit)
    return kept.withColumn("place", F.count("*").over(W.partitionBy("qid")) - F.col("n") + 1).drop("n")


def budget(rows: DataFrame, size: Column, most: int, order: list[Column]) -> DataFrame:
    """`whole` tells the rows that fit a running budget, spent in `order`; from the first that doesn't on, none does. The first with any text always fits."""
    by = W.partitionBy("qid").orderBy(*order)
    spent = F.sum(size).over(by.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("whole", (spent <= most) | (spent - size == 0))


def preview(rows: DataFrame, chars: int = PREVIEW, column: str = "content", whole: Column | None = None) -> DataFrame:
    """Cuts long contents of rows that can be fetched by reference (and aren't `whole`); their length and the cut are told."""
    cut = F.col("ref").isNotNull() & F.coalesce(F.length(column) > chars, F.lit(False))
    cut = cut if whole is None else cut & ~whole
    return rows.withColumns({f"{column}_len": F.when(cut, F.length(column)), f"{column}_truncated": cut, column: F.when(cut, F.substring(column, 1, chars)).otherwise(F.col(column))})


def degraded(rows: DataFrame, kind: str, columns: tuple[str, ...], most: int, order: list[Column], chars: int = PREVIEW) -> DataFrame:
    """A listing within a budget of characters, spent from its first row on: rows beyond it keep a preview of each column,
    and those that were cut get a `ref` to fetch them by."""
    if chars <= 0:  # previews are off, and with them the budget
        return rows.withColumns({"ref": F.lit(None).cast("string"), **{x: v for c in columns for x, v in ((f"{c}_len", F.lit(None).cast("int")), (f"{c}_truncated", F.lit(False)))}})
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.length(columns[0]), F.lit(0)))
    out = budget(rows, size, most, order).withColumn("ref", F.concat(F.lit(f"{kind}:"), "id"))
    for c in columns:
        out = preview(out, chars, c, F.col("whole"))
    cut = F.greatest(*[F.col(f"{c}_truncated") for c in columns]) if len(columns) > 1 else F.col(f"{columns[0]}_truncated")
    return out.withColumn("ref", F.when(cut, F.col("ref"))).drop("whole")


def full_contents(rows: DataFrame, most: int, chars: int = PREVIEW) -> DataFrame:
    """Contents of a recall (qid, place, ref, content) within a budget that is spent from the best row down, the last place
    first; rows beyond it keep a preview. Rows without a reference stay whole and spend what they are long."""
    if chars <= 0:
        return rows.withColumns({"content_len": F.lit(None).cast("int"), "content_truncated": F.lit(False)})
    return preview(budget(rows, F.coalesce(F.length("content"), F.lit(0)), most, [F.desc("place")]), chars, "content", F.col("whole")).drop("whole")
