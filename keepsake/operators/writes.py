"""Writes as new versions of a table: every function takes DataFrames and returns the next ones.

Parquet tables have no MERGE; a version is an anti-join and a union, or a rewrite
of one column. Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import MAX_CONTENT, bound, json_valid, normalised_source, sanitised

MAX_JSON, MAX_PROFILE = 8000, 2000
EXACT = ("agent_id", "project_id", "channel")


def prepared(incoming: DataFrame, cap: int | None = MAX_CONTENT) -> DataFrame:
    """Incoming messages with cleaned content (cut to cap characters; None: whole), canonical source and a verdict: rejected (why) or null. Needs a column `seq` for their order."""
    canonical = bound(normalised_source(F.col("source")), lambda s: F.when(s["mapped"], F.to_json(F.struct(s["type"].alias("type"), s["id"].alias("id"), s["name"].alias("name")))).otherwise(F.col("source")))
    out = incoming.withColumns({"source": F.coalesce(canonical, F.lit("{}")), "content": sanitised(F.col("content"), cap)})
    why = F.when(F.coalesce("content", F.lit("")) == "", "empty content").when((F.length("source") > MAX_JSON) | (F.length(F.coalesce("metadata", F.lit("{}"))) > MAX_JSON), "oversized json")
    return out.withColumn("rejected", why)


def _first(rows: DataFrame, *keys: str, when: Column | None = None) -> DataFrame:
    """Rows without those that repeat an earlier one's keys."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy("seq"))
    return rows.withColumn("n", n).where((F.col("n") == 1) | (F.lit(False) if when is None else ~when)).drop("n")


def _seen(rows: DataFrame, target: DataFrame, column: str, shared: bool) -> DataFrame:
    """Keys (seq) of rows whose column is in the target already: in the same bucket, or (shared) also in the global project.

    Texts are compared by digest: only keys and digests of the target are shuffled, and
    nothing of it where Spark finds the incoming rows small enough to broadcast.
    """
    key = F.md5(F.col(column).cast("binary"))
    have = target.select(F.col("agent_id").alias("a"), F.col("project_id").alias("p"), F.col("channel").alias("c"), key.alias("x"))
    projects = F.array_distinct(F.array("project_id", F.lit(""))) if shared else F.array("project_id")
    wanted = rows.select("seq", "agent_id", F.explode(projects).alias("own"), "channel", key.alias("key"))
    found = have.join(wanted, (F.col("agent_id") == F.col("a")) & (F.col("own") == F.col("p")) & (F.col("channel") == F.col("c")) & (F.col("key") == F.col("x")))
    return found.select("seq").distinct()


def store(target: DataFrame, incoming: DataFrame, shared: bool = True, cap: int | None = MAX_CONTENT) -> DataFrame:
    """(seq, result): stored, skipped (msg_id or content is there already, or came earlier in the batch) or rejected.

    Contents are compared as the target keeps them: cut to cap characters, or whole (None) where it holds whole texts.
    """
    rows = prepared(incoming, cap)
    good = rows.where("rejected is null")
    by_id = _seen(good.where("msg_id <> ''"), target.where("msg_id <> ''"), "msg_id", shared)
    by_content = _seen(good, target, "content", shared)
    new = good.join(by_id.union(by_content).distinct(), "seq", "left_anti")
    kept = _first(_first(new, "agent_id", "project_id", "msg_id", when=F.col("msg_id") != ""), *EXACT, "content")
    told = rows.join(kept.select("seq", F.lit(True).alias("kept")), "seq", "left")
    return told.select("seq", F.when(F.col("rejected").isNotNull(), "rejected").when(F.col("kept"), "stored").otherwise("skipped").alias("result"))


def appended(target: DataFrame, incoming: DataFrame, results: DataFrame) -> DataFrame:
    """target with the stored rows; ids follow the largest there is, in order of seq."""
    rows = prepared(incoming).join(results.where("result = 'stored'").select("seq"), "seq")
    top = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    place = F.row_number().over(W.orderBy("seq")) if "id" not in incoming.columns else F.col("id") - top
    return target.unionByName(rows.withColumn("id", (F.lit(top) + place).cast("long")).select(*[c for c in target.columns if c in (*rows.columns, "id")]), allowMissingColumns=True)


def updated(rows: DataFrame, memory_id: int, agent: str, content: str, embedding: list[float] | None = None) -> DataFrame:
    """New content for one unlocked row of its owner; its embedding is replaced or dropped."""
    hit = (F.col("id") == memory_id) & (F.col("agent_id") == agent) & ~F.col("locked")
    vector = F.lit(None) if embedding is None else F.array(*map(F.lit, embedding))
    return rows.withColumns({"content": F.when(hit, content).otherwise(F.col("content")), "embedding": F.when(hit, vector.cast("array<float>")).otherwise(F.col("embedding"))})


def locked(rows: DataFrame, memory_id: int, agent: str, on: bool = True) -> DataFrame:
    return rows.withColumn("locked", F.when((F.col("id") == memory_id) & (F.col("agent_id") == agent), on).otherwise(F.col("locked")))


def without(rows: DataFrame, ids: list[int], agent: str, respect_locks: bool = True) -> DataFrame:
    """Deletes rows of their owner by id."""
    hit = F.col("id").isin(*ids) & (F.col("agent_id") == agent)
    return rows.where(~(hit & ~F.col("locked") if respect_locks and "locked" in rows.columns else hit))


def without_agent(rows: DataFrame, agent: str) -> DataFrame:
    return rows.where(F.col("agent_id") != agent)


def profiles_upserted(rows: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write wins on (agent_id, user_id); blank contents change nothing; contents are cut."""
    new = incoming.where(F.trim("content") != "").withColumn("content", F.substring("content", 1, MAX_PROFILE))
    n = F.row_number().over(W.partitionBy("agent_id", "user_id").orderBy(F.desc("updated_at"), F.desc("new")))
    both = rows.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("n", n).where("n = 1").drop("n", "new")


def episode(history: DataFrame, by: str = "conv") -> DataFrame:
    """(by, start_time, end_time): the least and greatest time text of a session's messages."""
    return history.where("coalesce(timestamp, '') <> ''").groupBy(by).agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))


def _merge(ours: DataFrame, kept: DataFrame, move: bool) -> DataFrame:
    told = ours.join(kept.select("seq", F.lit(True).alias("kept")), "seq", "left")
    return told.select("id", F.when(F.col("kept"), "moved" if move else "copied").otherwise("left_at_source" if move else "skipped").alias("action"))


def merged(rows: DataFrame, source: str, target: str, move: bool = False) -> DataFrame:
    """(id, action) for every row of the source agent: copied or skipped; of a move also left_at_source for what can't go.

    A row is skipped where the target holds its content in the same bucket, or its
    msg_id in the same project, or an earlier row of the source does.
    """
    slim = rows.select("id", "agent_id", "project_id", "channel", "msg_id", F.md5(F.col("content").cast("binary")).alias("content"))
    ours, theirs = slim.where(F.col("agent_id") == source).withColumn("seq", F.col("id")), slim.where(F.col("agent_id") == target)
    by_content = ours.join(theirs, ["project_id", "channel", "content"], "left_semi").select("seq")
    by_id = ours.where("msg_id <> ''").join(theirs.where("msg_id <> ''"), ["project_id", "msg_id"], "left_semi").select("seq")
    new = ours.join(by_content.union(by_id).distinct(), "seq", "left_anti")
    kept = _first(_first(new, "project_id", "msg_id", when=F.col("msg_id") != ""), "project_id", "channel", "content")
    return _merge(ours, kept, move)


def episodes_merged(rows: DataFrame, source: str, target: str, move: bool = False) -> DataFrame:
    """(id, action) for the source's episodes: those whose summary the target has in the same bucket, or an earlier one of the source, and empty ones stay."""
    slim = rows.where(F.coalesce("summary", F.lit("")) != "").select("id", "agent_id", "project_id", "channel", F.md5(F.col("summary").cast("binary")).alias("summary"))
    ours, theirs = rows.where(F.col("agent_id") == source).select("id", F.col("id").alias("seq")), slim.where(F.col("agent_id") == target)
    new = slim.where(F.col("agent_id") == source).withColumn("seq", F.col("id")).join(theirs, ["project_id", "channel", "summary"], "left_anti")
    return _merge(ours, _first(new, "project_id", "channel", "summary"), move)


def profiles_merged(rows: DataFrame, source: str, target: str, move: bool = False) -> DataFrame:
    """(id, action) for the source's profiles: one that the target has for the same user stays, whatever it says."""
    ours = rows.where(F.col("agent_id") == source).withColumn("seq", F.col("id"))
    kept = ours.where(F.coalesce("content", F.lit("")) != "").join(rows.where(F.col("agent_id") == target), "user_id", "left_anti")
    return _merge(ours, kept, move)


def imported(target: DataFrame, records: DataFrame) -> DataFrame:
    """(seq, result) of import records: exact buckets, repeats within the file count as skipped; a dry run is this result alone."""
    return store(target, records, shared=False)


def episodes_imported(target: DataFrame, records: DataFrame) -> DataFrame:
    """(seq, result) of episode records (seq, agent_id, project_id, channel, summary): rejected without a summary, skipped where the same one is in the same bucket already."""
    rows = records.withColumn("summary", sanitised(F.col("summary"), MAX_CONTENT))
    good = rows.where(F.coalesce("summary", F.lit("")) != "").withColumn("key", F.md5(F.col("summary").cast("binary")))
    have = target.select(*EXACT, F.md5(F.col("summary").cast("binary")).alias("key"))
    kept = _first(good.join(have, [*EXACT, "key"], "left_anti"), *EXACT, "key")
    told = rows.join(kept.select("seq", F.lit(True).alias("kept")), "seq", "left")
    return told.select("seq", F.when(F.coalesce("summary", F.lit("")) == "", "rejected").when(F.col("kept"), "stored").otherwise("skipped").alias("result"))


def profiles_imported(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Profiles after an import: the file's last record of an (agent_id, user_id) wins over earlier ones and over what is there; blank ones change nothing."""
    new = records.withColumn("content", sanitised(F.col("content"), MAX_PROFILE)).where(F.coalesce("content", F.lit("")) != "")
    both = rows.withColumn("seq", F.lit(-1).cast("long")).unionByName(new, allowMissingColumns=True)
    n = F.row_number().over(W.partitionBy("agent_id", "user_id").orderBy(F.desc("seq")))
    kept_id = F.max(F.when(F.col("seq") < 0, F.col("id"))).over(W.partitionBy("agent_id", "user_id"))
    return both.withColumns({"n": n, "kept_id": kept_id}).where("n = 1").withColumn("id", F.coalesce("kept_id", "id")).drop("n", "kept_id", "seq")


def channels(rows: DataFrame) -> DataFrame:
    """(id, recovered) for rows filed under a bridge's name: digits before ':' of metadata.session_id, null where there are none.

    A recovered channel in which the row's content already is, or which an earlier row takes, gives null with collision.
    """
    session = F.when(json_valid(F.col("metadata")), F.get_json_object("metadata", "$.session_id"))
    digest = F.md5(F.col("content").cast("binary"))
    found = rows.where("channel = 'discord'").select("id", "agent_id", "project_id", digest.alias("content"), F.when(session.rlike("(?s)^[0-9].*:"), F.substring_index(session, ":", 1)).alias("recovered"))
    there = rows.select("agent_id", "project_id", F.col("channel").alias("recovered"), digest.alias("content")).distinct().withColumn("there", F.lit(True))
    place = F.row_number().over(W.partitionBy("agent_id", "project_id", "recovered", "content").orderBy("id"))
    told = found.join(there, ["agent_id", "project_id", "recovered", "content"], "left").withColumn("place", place)
    collides = F.col("recovered").isNotNull() & (F.col("there").isNotNull() | (F.col("place") > 1))
    return told.select("id", "recovered", collides.alias("collision"))


def migrated(rows: DataFrame, globalise: bool = False) -> DataFrame:
    """rows with recovered channels; what can't be recovered stays, or becomes global."""
    told = channels(rows)
    out = rows.join(told, "id", "left")
    fresh = F.when(F.col("recovered").isNotNull() & ~F.col("collision"), F.col("recovered")).when(F.lit(globalise) & (F.col("channel") == "discord") & F.col("recovered").isNull(), "").otherwise(F.col("channel"))
    return out.withColumn("channel", fresh).drop("recovered", "collision")


def survivors(rows: DataFrame) -> DataFrame:
    """Of rows with equal agent, project and content the one that stays: the first without channel, else the first."""
    return rows.groupBy("agent_id", "project_id", "content").agg(F.coalesce(F.min(F.when(F.col("channel") == "", F.col("id"))), F.min("id")).alias("id"), F.count("*").alias("cnt"))


def counted(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Folds recall events (id, seconds) into recall_count and last_recalled."""
    seen = events.groupBy("id").agg(F.count("*").alias("n"), F.max("seconds").alias("last"))
    out = rows.join(seen, "id", "left")
    return out.withColumns({"recall_count": F.col("recall_count") + F.coalesce("n", F.lit(0)), "last_recalled": F.greatest("last_recalled", "last") if "last_recalled" in rows.columns else F.col("last")}).drop("n", "last")
