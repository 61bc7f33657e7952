"""Hybrid recall for a batch of queries: candidates, fusion, scoring, gate, cut, output."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.isolation import visible
from ..functions.scoring import age_hours, confidence, dot
from ..functions.text import excluded, instant, source_starts
from ..operators import fusion
from ..operators.lexical import Query, keywords_batch, matching_batch
from ..operators.retrieval import SCAN_WINDOW, newest, similar_batch
from ..shared import stored

RRF_VECTOR_FACTOR = 0.5


def _vector_order() -> list:
    return [F.desc("cosine"), F.desc("kind"), F.desc("created_at"), F.col("id")]


@dataclass(frozen=True)
class Options:
    agent: str | None = None
    project: str | None = None
    channel: str | None = None
    source: str | None = None
    limit: int = 10
    mode: str = "rrf"
    least: float = 0.3
    exclude: list[str] = field(default_factory=list)
    use_confidence: bool = False
    deep: bool = False
    now: float = 0.0
    calibrated: dict[str, float] = field(default_factory=dict)
    scan: int | None = SCAN_WINDOW


def vector_list(memory: DataFrame, episode: DataFrame | None, queries: list[Query] | DataFrame, o: Options, least: float) -> DataFrame:
    """The k nearest of memories and episodes together; on ties memories first, then the newest."""
    mine = visible(o.agent, o.project, o.channel)
    dim = len(queries[0].vector) if isinstance(queries, list) else None
    rows = memory.where(mine if o.source is None else mine & source_starts(o.source))
    rows = newest(rows, o.scan, dim) if o.scan else rows
    slim = ("qid", "id", "cosine", "created_at")
    hits = similar_batch(rows, queries, o.limit, least).select(*slim, F.lit("mem").alias("kind"))
    if episode is not None and (o.source is None or o.channel):
        eps = episode.where(mine)
        eps = newest(eps, o.scan, dim) if o.scan else eps
        hits = hits.union(similar_batch(eps, queries, o.limit, least).select(*slim, F.lit("ep").alias("kind")))
    top = F.row_number().over(W.partitionBy("qid").orderBy(*_vector_order()))
    return hits.withColumn("n", top).where(F.col("n") <= o.limit).drop("n")


def candidates(memory: DataFrame, episode: DataFrame, queries: list[Query], o: Options) -> list[DataFrame]:
    """The vector, episode and keyword lists, places given before the caller's own texts are excluded."""
    mine = visible(o.agent, o.project, o.channel)
    least = o.least * (RRF_VECTOR_FACTOR if o.mode != "cascade" else 1.0)
    vectors = vector_list(memory, episode, queries, o, least)
    words = keywords_batch(memory, queries, o.limit, mine if o.source is None else mine & source_starts(o.source)).withColumn("kind", F.lit("mem"))
    if o.exclude:
        own = memory.where(excluded(F.col("content"), o.exclude)).select("id", F.lit("mem").alias("kind"), F.lit(True).alias("excluded"))
        vectors, words = vectors.join(own, ["kind", "id"], "left"), words.join(own, ["kind", "id"], "left")
    lists = [fusion.listed(vectors, 0, _vector_order(), "cosine")]
    if o.source is None or o.channel:
        talks = matching_batch(episode, queries, o.limit, mine, ("summary", "keywords")).withColumn("kind", F.lit("ep"))
        lists.append(fusion.listed(talks, 1, [F.col("rank")], "bm25"))
    return [*lists, fusion.listed(words, 2, [F.col("rank")], "bm25")]


def own_profiles(profile: DataFrame | None, queries: list[Query], o: Options) -> DataFrame | None:
    """(qid, id, content, updated_at): the agent's profiles for each query; an agent has few."""
    if profile is None or o.agent is None or not queries:
        return None
    asked = profile.sparkSession.createDataFrame([(q.qid,) for q in queries], "qid long")
    few = profile.where((F.col("agent_id") == o.agent) & (F.col("user_id") == "")).orderBy(F.desc("updated_at"), "id").limit(fusion.PROFILES)
    return asked.crossJoin(F.broadcast(few.select("id", "content", "updated_at")))  # at most PROFILES rows


def fused(memory: DataFrame, episode: DataFrame, queries: list[Query], o: Options, profile: DataFrame | None = None) -> DataFrame:
    """Fused candidates, the agent's profiles after them (a cascade puts them before the keyword rows)."""
    told = own_profiles(profile, queries, o)
    lists = candidates(memory, episode, queries, o)
    if o.mode == "cascade":
        return fusion.cascade(lists, o.limit, told)
    rows = fusion.rrf(lists) if o.mode == "rrf" else fusion.rsf(lists)
    rows = rows.withColumn(o.mode, F.round(o.mode, fusion.PLACES))  # what penalties scale is what orders, so that rows tie alike
    return rows if told is None else fusion.with_profiles(rows, told)


def newest_rows(memory: DataFrame, queries: list[Query], o: Options, profile: DataFrame | None = None) -> DataFrame:
    """What a query without text gets: the agent's profiles, then its newest memories, unscored."""
    mine = visible(o.agent, o.project, o.channel)
    rows = memory.where(mine if o.source is None else mine & source_starts(o.source))
    if o.exclude:
        rows = rows.withColumn("excluded", excluded(F.col("content"), o.exclude))
    few = rows.orderBy(F.desc("created_at"), "id").limit(o.limit)
    asked = memory.sparkSession.createDataFrame([(q.qid,) for q in queries], "qid long")
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("created_at"), "id"))
    own = asked.crossJoin(F.broadcast(few.select("id", "created_at", *[c for c in ("excluded",) if o.exclude]))).withColumn("rank", place)  # at most `limit` rows
    words = own.select("qid", F.lit("mem").alias("kind"), "id", "rank", F.lit(None).cast("double").alias("bm25"), *[c for c in ("excluded",) if o.exclude])
    return fusion.cascade([fusion.listed(words, 2, [F.col("rank")], "bm25")], o.limit, own_profiles(profile, queries, o))


def pool_stats(memory: DataFrame, episode: DataFrame, o: Options) -> tuple[int, float, float | None, float | None]:
    """(pool size, span in hours, newest age in hours, session boundary): one row of counts, minima and maxima.

    The span runs from the least to the greatest time text that can be read.
    """
    mine = visible(o.agent, o.project, o.channel)
    text = F.when(F.col("seconds").isNotNull() & (F.col("timestamp") != ""), F.col("timestamp"))
    m = memory.where(mine).agg(F.count("*").alias("n"), F.min(text).alias("a"), F.max(text).alias("b")).select("n", instant(F.col("a")).alias("a"), instant(F.col("b")).alias("b")).first()
    e = episode.where(mine).agg(F.count("*").alias("n"), F.max("created_at").alias("last")).select("n", instant(F.col("last")).alias("last")).first()
    known = m.a is not None and m.b is not None
    return m.n + e.n, max(0.0, (m.b - m.a) / 3600) if known else 0.0, max(0.0, (o.now - m.b) / 3600) if known else None, e.last


def scored(rows: DataFrame, memory: DataFrame, episode: DataFrame, queries: list[Query], o: Options) -> tuple[DataFrame, int]:
    """Cosines backfilled (with confidence), the boundary's penalty, and confidence; `ord` anew.

    The candidates are a few rows a query: they are stored, and the wide columns come
    by a join that sends their ids to the tables, not the tables to them.
    """
    pool, span, newest_age, boundary = pool_stats(memory, episode, o)
    rows = stored(rows, "candidates")
    ids = F.broadcast(rows.where("kind <> 'profile'").select("kind", "id").distinct())  # at most three lists of `limit` rows a query
    vectors = ["embedding"] if o.use_confidence else []
    wide = memory.select(F.lit("mem").alias("kind"), "id", *vectors, "seconds", "recall_count", "last_recalled", F.lit(False).alias("resolved")).join(ids, ["kind", "id"])
    start = instant(F.coalesce(F.when(instant(F.col("start_time")).isNotNull(), F.col("start_time")), F.col("created_at")))
    wide = wide.unionByName(episode.select(F.lit("ep").alias("kind"), "id", *vectors, start.alias("seconds"), F.lit(0).cast("long").alias("recall_count"), F.lit(None).cast("double").alias("last_recalled"), "resolved").join(ids, ["kind", "id"]))
    rows = rows.join(F.broadcast(wide), ["kind", "id"], "left")
    if o.use_confidence:
        told = rows.sparkSession.createDataFrame([(q.qid, [float(x) for x in q.vector]) for q in queries if q.text.strip()], "qid long, asked array<double>")
        rows = rows.join(F.broadcast(told), "qid", "left")  # the batch's vectors
        found = F.when(F.size("embedding") == F.size("asked"), F.round(dot(F.col("embedding"), F.col("asked")), 9))
        rows = rows.withColumn("backfilled", F.col("cosine").isNull() & found.isNotNull()).withColumn("cosine", F.coalesce("cosine", found)).drop("embedding", "asked")
    else:
        rows = rows.withColumn("backfilled", F.lit(False))
    if boundary is not None:
        rows = fusion.penalised(rows, "seconds", F.lit(boundary))
    if o.use_confidence:
        age = age_hours(F.col("seconds"), o.now, F.lit(newest_age), F.lit(span))
        since = (F.lit(o.now) - F.col("last_recalled")) / 3600
        rows = rows.withColumn("confidence", confidence(F.col("cosine"), age, F.lit(span), F.col("recall_count"), F.when(F.col("recall_count") > 0, since), F.coalesce("resolved", F.lit(False)), o.deep))
        rows = fusion.resorted(rows, "confidence")
    elif o.mode in rows.columns and boundary is not None:
        rows = fusion.resorted(rows, o.mode)
    return rows, pool


def recall(memory: DataFrame, episode: DataFrame, queries: list[Query], o: Options, profile: DataFrame | None = None) -> DataFrame:
    """(qid, place, kind, id, ref, signal, score, match_reason, ...): what a caller gets, the best row last.

    With profiles the agent's newest ones take part, as rows of kind `profile` with
    their content and without a reference. match_reason holds the signal the gate
    went by, its score and the scores of the single rankings. `fallback` tells rows that
    the gate refused and that are all there is.
    """
    some, none = [q for q in queries if q.text.strip()], [q for q in queries if not q.text.strip()]
    found = [fused(memory, episode, some, o, profile)] if some else []
    found += [newest_rows(memory, none, o, profile)] if none else []
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    rows, pool = scored(rows, memory, episode, queries, o)
    passed = fusion.gate(rows, F.lit(pool), o.calibrated, o.deep, F.col("qid").isin(*[q.qid for q in none]) if none else F.lit(False))
    kept = fusion.autocut(fusion.rescued(passed, rows) if o.use_confidence else passed)
    out = fusion.last_best(kept, o.limit)
    parts = [F.col(c) for c in ("signal", "score", "cosine", "rrf", "rsf") if c in out.columns]
    return out.withColumns({"ref": F.when(F.col("kind") != "profile", F.concat("kind", F.lit(":"), F.col("id"))), "match_reason": F.when(F.col("signal").isNotNull(), F.struct(*parts))})


def with_context(recalled: DataFrame, memory: DataFrame, context: DataFrame) -> DataFrame:
    """(qid, role, content, timestamp, place): recalled memories and the caller's messages (qid, pos, role, content, timestamp) by raw time text."""
    own = context.where(F.col("role").isin("user", "assistant")).select("qid", F.lit(1).alias("part"), F.col("pos").cast("long").alias("at"), "role", "content", "timestamp")
    texts = memory.select("id", "content", "timestamp")
    told = recalled.where("kind = 'mem'").join(texts, "id").select("qid", F.lit(0).alias("part"), F.col("place").cast("long").alias("at"), F.lit("memory").alias("role"), "content", "timestamp")
    both = told.unionByName(own)
    return both.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.coalesce("timestamp", F.lit("")), "part", "at"))).drop("part", "at")


def contents(refs: DataFrame, memory: DataFrame, episode: DataFrame, agent: str, most: int = 40_000) -> DataFrame:
    """(pos, ref, status, content): full texts by reference; what isn't the agent's is missing. refs: qid, pos, ref.

    Texts are never cut. The first one is always given; from the first that exceeds
    the budget on, all references are deferred.
    """
    split = refs.withColumns({"kind": F.substring_index("ref", ":", 1), "id": F.when(F.col("ref").rlike("^(mem|ep):[0-9]{1,18}$"), F.substring_index("ref", ":", -1)).cast("long")})
    texts = memory.where(F.col("agent_id") == agent).select(F.lit("mem").alias("kind"), "id", "content").unionByName(episode.where(F.col("agent_id") == agent).select(F.lit("ep").alias("kind"), "id", F.concat(F.lit("[Episode] "), "summary").alias("content")))
    here = texts.join(F.broadcast(split.select("kind", "id").distinct()), ["kind", "id"])  # refs of one call
    found = split.join(F.broadcast(here), ["kind", "id"], "left")
    before = W.partitionBy("qid").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    size, given = F.coalesce(F.length("content"), F.lit(0)), F.col("content").isNotNull()
    told = found.withColumns({"used": F.coalesce(F.sum(size).over(before), F.lit(0)), "items": F.coalesce(F.count_if(given).over(before), F.lit(0))})
    over = given & (F.col("items") > 0) & (F.col("used") + size > most)
    told = told.withColumn("first", F.min(F.when(over, F.col("pos"))).over(W.partitionBy("qid")))
    status = F.when(F.col("pos") >= F.col("first"), "deferred").when(~given, "missing").otherwise("ok")
    return told.select("pos", "ref", status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))
