"""Data-quality checks: each finding is one row (check, severity, n, repairable).

`repairable` counts with the predicate of the repair, so locked rows don't count
where the repair wouldn't touch them; null says that there is no repair. A repair
returns the next version of a table. Checks that count rows by a predicate are
Findings, of which any number fits one aggregate over a table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scoring import dot, unit
from ..functions.text import ANNOTATION, MENTION, instant, json_valid, normalised_source, stripped, utc_text, zone_class
from ..shared import stored
from .retrieval import postings
from .writes import survivors

MAX_CONTENT, MAX_PROFILE = 16_000, 2_000
NEAR, NEAR_ROWS, SHORT, STALE_DAYS = 0.97, 1000, 5, 30
#: Characters of a summary of the operating context that still go without a remark.
MAX_SUMMARY = 2_000
#: All checks in the order in which repairs build on each other and findings are read.
REGISTRY = (
    "memory_annotation", "discord_mention", "oversized_content", "duplicate_content", "embedding_dimension", "null_embedding", "null_episode_embedding", "fts_integrity", "schema_version", "dedup_msg_id", "schema_objects", "integrity", "axis_hygiene",
    "invalid_json_source", "invalid_json_metadata", "invalid_timestamp", "missing_episode_start_time", "timestamp_format_drift", "episode_timestamp_format_drift", "stale_pending_tasks", "missing_profile", "empty_content", "invalid_source_type", "oversized_profile",
    "anonymous_source", "vector_fallback_config", "operating_context_parse", "operating_context_size",
)


@dataclass(frozen=True)
class Finding:
    """A check as aggregates over its table."""

    name: str
    severity: Column
    n: Column
    repairable: Column


def counted(name: str, severity: str, bad: Column, fixable: Column | None = None) -> Finding:
    bad = F.coalesce(bad, F.lit(False))
    return Finding(name, F.lit(severity), F.count_if(bad), F.lit(None).cast("long") if fixable is None else F.count_if(bad & F.coalesce(fixable, F.lit(False))))


def report(rows: DataFrame, findings: list[Finding]) -> DataFrame:
    """One row a finding, from one aggregate over the table."""
    told = [F.struct(F.lit(f.name).alias("check"), f.severity.alias("severity"), f.n.cast("long").alias("n"), f.repairable.cast("long").alias("repairable")) for f in findings]
    return rows.agg(F.array(*told).alias("found")).select(F.inline("found"))


def _free() -> Column:
    return ~F.col("locked")


def finding(rows: DataFrame, name: str, severity: str, bad: Column, fixable: Column | None = None) -> DataFrame:
    return report(rows, [counted(name, severity, bad, fixable)])


# ---- findings on memories ---------------------------------------------------------


def annotation_() -> Finding:
    c = F.col("content")
    return counted("memory_annotation", "info", F.contains(F.lower(c), F.lit("[memory from")), _free() & (stripped(F.regexp_replace(c, ANNOTATION, "")) != c))


def mention_() -> Finding:
    c = F.col("content")
    return counted("discord_mention", "info", F.contains(c, F.lit("<@")), _free() & (stripped(F.regexp_replace(c, MENTION, "")) != c))


def oversized_(cap: int = MAX_CONTENT) -> Finding:
    return counted("oversized_content", "warn", F.length("content") > cap, _free())


def dimension_(expected: int) -> Finding:
    return counted("embedding_dimension", "critical", F.col("embedding").isNotNull() & (F.size("embedding") != expected), F.lit(True))


def no_embedding_(name: str = "null_embedding", client: bool = True) -> Finding:
    """Critical where more than half of the rows have none; one run of the repair fills 500. Without an embedding function it is information that nothing repairs."""
    n = F.count_if(F.col("embedding").isNull())
    if not client:
        return Finding(name, F.lit("info"), n, F.lit(0).cast("long"))
    return Finding(name, F.when(2 * n > F.count("*"), "critical").otherwise("warn"), n, F.least(n, F.lit(500)))


def invalid_json_(column: str) -> Finding:
    return counted(f"invalid_json_{column}", "warn", ~F.coalesce(json_valid(F.col(column)), F.lit(False)), _free())


def invalid_timestamp_() -> Finding:
    return counted("invalid_timestamp", "warn", _bad_time(), _free() & instant(F.col("created_at")).isNotNull())


def zone_drift_() -> Finding:
    """Readable times of more than one convention, or with another offset: those that aren't in UTC. The repair reaches times with an offset."""
    zone = F.when((F.coalesce("timestamp", F.lit("")) != "") & instant(F.col("timestamp")).isNotNull(), zone_class(F.col("timestamp")))
    aware, naive, utc = (F.count_if(zone == z) for z in ("aware", "naive", "utc"))
    return Finding("timestamp_format_drift", F.lit("warn"), F.when((aware > 0) | ((naive > 0) & (utc > 0)), aware + naive).otherwise(0), F.count_if((zone == "aware") & _free()))


def empty_() -> Finding:
    return counted("empty_content", "warn", F.trim(F.coalesce("content", F.lit(""))) == "", _free())


def invalid_source_() -> Finding:
    """Sources that name a producer of no known type; those that can be mapped are repairable."""
    return counted("invalid_source_type", "warn", _bad_source(), _free() & normalised_source(F.col("source"))["mapped"])


def anonymous_() -> Finding:
    _, nobody = _source()
    return counted("anonymous_source", "info", _anonymous() | F.coalesce(nobody, F.lit(False)))


def short_(most: int = SHORT) -> Finding:
    return counted("short_content", "info", F.length(F.trim("content")) <= most, _free())


def vectors_(kept: bool) -> Finding:
    """With vectors kept elsewhere: rows that no local scan can find."""
    return counted("vector_fallback_config", "info", F.lit(not kept) & F.col("embedding").isNull())


def missing_start_() -> Finding:
    return counted("missing_episode_start_time", "info", F.coalesce("start_time", F.lit("")) == "", instant(F.col("created_at")).isNotNull())


def oversized_profile_(cap: int = MAX_PROFILE) -> Finding:
    return counted("oversized_profile", "warn", F.length("content") > cap, F.lit(True))


def annotation(rows: DataFrame) -> DataFrame:
    return report(rows, [annotation_()])


def mention(rows: DataFrame) -> DataFrame:
    return report(rows, [mention_()])


def cleaned(rows: DataFrame) -> DataFrame:
    """Repair of both: unlocked contents without annotations and mentions."""
    c = stripped(F.regexp_replace(F.regexp_replace("content", ANNOTATION, ""), MENTION, ""))
    return rows.withColumn("content", F.when(_free(), c).otherwise(F.col("content")))


def oversized(rows: DataFrame, cap: int = MAX_CONTENT) -> DataFrame:
    return report(rows, [oversized_(cap)])


def cut_contents(rows: DataFrame, cap: int = MAX_CONTENT) -> DataFrame:
    """Repair: unlocked contents are cut to cap characters."""
    return rows.withColumn("content", F.when(_free(), F.substring("content", 1, cap)).otherwise(F.col("content")))


def oversized_profile(profiles: DataFrame, cap: int = MAX_PROFILE) -> DataFrame:
    return report(profiles, [oversized_profile_(cap)])


def cut_profiles(profiles: DataFrame, cap: int = MAX_PROFILE) -> DataFrame:
    return profiles.withColumn("content", F.substring("content", 1, cap))


def _surplus(rows: DataFrame) -> DataFrame:
    """Rows of equal agent, project and content but for the one that stays. Contents are compared by digest, so that texts stay where they are."""
    slim = rows.select("id", "agent_id", "project_id", "channel", "locked", F.sha2(F.col("content").cast("binary"), 256).alias("content"))
    kept = survivors(slim).where("cnt > 1").select("agent_id", "project_id", "content", F.col("id").alias("kept"))
    return slim.join(kept, ["agent_id", "project_id", "content"]).where("id <> kept")


def duplicates(rows: DataFrame) -> DataFrame:
    """Surplus rows of equal agent, project and content; the repair deletes those that are unlocked."""
    return finding(_surplus(rows), "duplicate_content", "warn", F.lit(True), _free())


def deduplicated(rows: DataFrame) -> DataFrame:
    return rows.join(_surplus(rows).where(_free()).select("id"), "id", "left_anti")


def dimension(rows: DataFrame, expected: int) -> DataFrame:
    return report(rows, [dimension_(expected)])


def without_misfits(rows: DataFrame, expected: int) -> DataFrame:
    """Repair: embeddings of another width become null, for the next run of embed_missing."""
    return rows.withColumn("embedding", F.when(F.size("embedding") == expected, F.col("embedding")))


def no_embedding(rows: DataFrame, name: str = "null_embedding") -> DataFrame:
    return report(rows, [no_embedding_(name)])


def index_drift(index: DataFrame, rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """Postings that the index lacks or has too many.

    First each text's postings are boiled down to their number and a digest, on both
    sides; only texts that differ are compared posting by posting.
    """
    one = F.xxhash64("pos", "tri")
    digest = (F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(F.xxhash64(one, F.lit(1))).alias("y"))
    mine = index.where(F.col("kind") == kind)
    have = mine.groupBy("id", "col").agg(*digest)
    want = postings(rows, kind, *columns).groupBy("id", "col").agg(*digest)
    both = want.join(have.select("id", "col", *[F.col(c).alias(f"h{c}") for c in "nxy"]), ["id", "col"], "full")
    odd = both.where(~(F.col("n").eqNullSafe(F.col("hn")) & F.col("x").eqNullSafe(F.col("hx")) & F.col("y").eqNullSafe(F.col("hy")))).select("id").distinct()
    odd = stored(odd, "index-drift")
    theirs = mine.join(odd, "id", "left_semi")
    own = postings(rows.join(odd, "id", "left_semi"), kind, *columns)
    return finding(own.exceptAll(theirs.select(*own.columns)).unionAll(theirs.select(*own.columns).exceptAll(own)), "fts_integrity", "critical", F.lit(True), F.lit(True))


def _older_ids(rows: DataFrame) -> DataFrame:
    """Rows that share agent, project and msg_id with a later one."""
    slim = rows.where("msg_id <> ''").select("id", "agent_id", "project_id", "msg_id", "locked")
    last = slim.groupBy("agent_id", "project_id", "msg_id").agg(F.max("id").alias("last"))
    return slim.join(last, ["agent_id", "project_id", "msg_id"]).where(F.col("id") < F.col("last"))


def repeated_ids(rows: DataFrame) -> DataFrame:
    return finding(_older_ids(rows), "dedup_msg_id", "warn", F.lit(True), _free())


def without_repeated_ids(rows: DataFrame) -> DataFrame:
    """Repair: of rows that share a msg_id the last keeps it; unlocked earlier ones get none."""
    gone = _older_ids(rows).where(_free()).select("id", F.lit(True).alias("blank"))
    return rows.join(gone, "id", "left").withColumn("msg_id", F.when(F.col("blank"), "").otherwise(F.col("msg_id"))).drop("blank").select(*rows.columns)


def schema(rows: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Columns that are missing or of another type, as text."""
    have = {f.name: f.dataType.simpleString() for f in rows.schema}
    wrong = sorted(f"{c} {t}" for c, t in expected.items() if have.get(c) != t)
    spark = rows.sparkSession
    return spark.createDataFrame([("schema_objects", "critical" if wrong else "ok", len(wrong), len(wrong))], "check string, severity string, n long, repairable long")


def schema_version(found: str | None, wanted: str, spark) -> DataFrame:
    """Whether tables were written by a scheme that this engine knows."""
    wrong = int(found is not None and found != wanted)
    return spark.createDataFrame([("schema_version", "critical" if wrong else "ok", wrong, None)], "check string, severity string, n long, repairable long")


def readable(rows: DataFrame) -> DataFrame:
    """Reads every value of every row once, so that damaged files show."""
    read = rows.agg(F.bit_xor(F.xxhash64(*rows.columns)).alias("x"))
    return read.select(F.lit("integrity").alias("check"), F.lit("ok").alias("severity"), F.coalesce(F.pmod("x", F.lit(1)), F.lit(0)).cast("long").alias("n"), F.lit(None).cast("long").alias("repairable"))


def axis_hygiene(rows: DataFrame) -> DataFrame:
    """Groups of project ids that differ in case and punctuation only."""
    return finding(drifting_projects(rows), "axis_hygiene", "warn", F.lit(True))


def drifting_projects(rows: DataFrame) -> DataFrame:
    """(key, spellings, rows): project ids that differ in case and punctuation only."""
    key = F.regexp_replace(F.lower("project_id"), "[^a-z0-9]", "")
    each = rows.where("project_id <> ''").groupBy(key.alias("key"), "project_id").agg(F.count("*").alias("cnt"))
    return each.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("cnt").alias("rows")).where("spellings > 1")


def axis_counts(rows: DataFrame, axis: str, k: int = 20) -> DataFrame:
    """The k largest buckets of an axis."""
    return rows.groupBy(F.when(F.col(axis) == "", "(global)").otherwise(F.col(axis)).alias("bucket")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "bucket").limit(k)


def invalid_json(rows: DataFrame, column: str) -> DataFrame:
    return report(rows, [invalid_json_(column)])


def valid_json(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.when(_free() & ~F.coalesce(json_valid(F.col(column)), F.lit(False)), "{}").otherwise(F.col(column)))


def _bad_time() -> Column:
    return (F.col("timestamp") != "") & instant(F.col("timestamp")).isNull()


def invalid_timestamp(rows: DataFrame) -> DataFrame:
    return report(rows, [invalid_timestamp_()])


def valid_timestamps(rows: DataFrame) -> DataFrame:
    made = instant(F.col("created_at"))
    return rows.withColumn("timestamp", F.when(_bad_time() & _free() & made.isNotNull(), utc_text(made)).otherwise(F.col("timestamp")))


def missing_start(episodes: DataFrame) -> DataFrame:
    return report(episodes, [missing_start_()])


def with_start(episodes: DataFrame) -> DataFrame:
    """Repair: a missing start becomes the time the row was made, in UTC."""
    made = instant(F.col("created_at"))
    return episodes.withColumn("start_time", F.when((F.coalesce("start_time", F.lit("")) == "") & made.isNotNull(), utc_text(made)).otherwise(F.col("start_time")))


def zone_drift(rows: DataFrame, column: str = "timestamp") -> DataFrame:
    """(zone, cnt) of the parsable times."""
    return rows.where((F.coalesce(column, F.lit("")) != "") & instant(F.col(column)).isNotNull()).groupBy(zone_class(F.col(column)).alias("zone")).agg(F.count("*").alias("cnt"))


def in_utc(rows: DataFrame, column: str = "timestamp") -> DataFrame:
    """Repair: unlocked times with another offset become UTC; naive ones stay, as their zone isn't known."""
    free = _free() if "locked" in rows.columns else F.lit(True)
    return rows.withColumn(column, F.when(free & (zone_class(F.col(column)) == "aware"), utc_text(instant(F.col(column)))).otherwise(F.col(column)))


def episode_zone_drift(episodes: DataFrame) -> DataFrame:
    values = episodes.select(F.explode(F.array("start_time", "end_time")).alias("value"))
    return zone_drift(values, "value")


def episode_drift(episodes: DataFrame) -> DataFrame:
    """Times of episodes that aren't in UTC, of more than one convention; those with an offset and copies of created_at are repairable."""
    values = episodes.select(F.explode(F.array("start_time", "end_time")).alias("value"), "created_at").where((F.coalesce("value", F.lit("")) != "") & instant(F.col("value")).isNotNull())
    zone = zone_class(F.col("value"))
    aware, naive, utc = (F.count_if(zone == z) for z in ("aware", "naive", "utc"))
    fixable = F.count_if((zone == "aware") | ((zone == "naive") & (F.col("value") == F.col("created_at"))))
    return report(values, [Finding("episode_timestamp_format_drift", F.lit("warn"), F.when((fixable > 0) | ((aware > 0).cast("int") + (naive > 0).cast("int") + (utc > 0).cast("int") > 1), aware + naive).otherwise(0), fixable)])


def episodes_in_utc(episodes: DataFrame) -> DataFrame:
    """Repair: times with another offset, and copies of created_at, become UTC."""
    out = episodes
    for c in ("start_time", "end_time"):
        copied = (zone_class(F.col(c)) == "naive") & (F.col(c) == F.col("created_at"))
        out = out.withColumn(c, F.when((zone_class(F.col(c)) == "aware") | copied, utc_text(instant(F.col(c)))).otherwise(F.col(c)))
    return out


def waiting_tasks(tasks: DataFrame, now: float, hours: float = 1) -> DataFrame:
    return finding(tasks, "stale_pending_tasks", "warn", _waiting(now, hours), F.lit(True))


def _waiting(now: float, hours: float = 1) -> Column:
    return instant(F.col("created_at")) < now - hours * 3600


def without_waiting(tasks: DataFrame, now: float) -> DataFrame:
    return tasks.where(~F.coalesce(_waiting(now), F.lit(False)))


def no_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """(agent_id): agents with memories and without a profile."""
    return rows.select("agent_id").distinct().join(profiles, "agent_id", "left_anti")


def empty(rows: DataFrame) -> DataFrame:
    return report(rows, [empty_()])


def without_empty(rows: DataFrame) -> DataFrame:
    return rows.where((F.trim(F.coalesce("content", F.lit(""))) != "") | F.col("locked"))


def _source() -> tuple[Column, Column]:
    v = F.try_parse_json("source")
    shape = F.schema_of_variant(v)
    nobody = (shape == "VOID") | (shape == "OBJECT<>") | (F.startswith(shape, F.lit("OBJECT")) & (F.coalesce(F.size(F.json_object_keys("source")), F.lit(0)) == 0))
    return v, nobody


def _bad_source() -> Column:
    v, nobody = _source()
    kind = F.try_variant_get(v, "$.type", "string")
    return F.coalesce(v.isNotNull() & ~nobody & ~F.coalesce(kind.isin("User", "Agent", "System"), F.lit(False)), F.lit(False))


def invalid_source(rows: DataFrame) -> DataFrame:
    return report(rows, [invalid_source_()])


def valid_sources(rows: DataFrame) -> DataFrame:
    """Repair: unlocked sources of a known legacy shape are rewritten; unknown shapes stay."""
    s = normalised_source(F.col("source"))
    fresh = F.to_json(F.struct(s["type"].alias("type"), F.coalesce(s["id"], F.lit("")).alias("id"), F.coalesce(s["name"], F.lit("")).alias("name")))
    return rows.withColumn("source", F.when(_free() & _bad_source() & s["mapped"], fresh).otherwise(F.col("source")))


def source_counts(rows: DataFrame) -> DataFrame:
    """(mapped, unmapped, locked, remaining): what a repair of sources does, and what is left after it."""
    bad, mapped = _bad_source(), normalised_source(F.col("source"))["mapped"]
    return rows.agg(F.count_if(bad & _free() & mapped).alias("mapped"), F.count_if(bad & _free() & ~mapped).alias("unmapped"), F.count_if(bad & ~_free()).alias("locked"), F.count_if(bad & _free() & ~mapped).alias("remaining"))


def _anonymous() -> Column:
    get = lambda k: F.get_json_object("source", f"$.{k}")
    return F.coalesce((get("type") == "User") & (get("id") == "") & (get("name") == ""), F.lit(False))


def anonymous(rows: DataFrame) -> DataFrame:
    return report(rows, [anonymous_()])


def vectors_kept(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("memories"), F.count("embedding").alias("with_embedding"))


def named_sources(rows: DataFrame) -> DataFrame:
    """Deep check: anonymous rows whose content begins with [name], with the name; null where it doesn't."""
    name = F.regexp_extract("content", r"^\[(.+?)\]\s", 1)
    return rows.where(_anonymous()).select("id", F.when(name != "", name).alias("name"), "locked")


def with_names(rows: DataFrame) -> DataFrame:
    """Deep repair: unlocked anonymous rows take the [name] that their content begins with."""
    name = F.regexp_extract("content", r"^\[(.+?)\]\s", 1)
    fresh = F.to_json(F.struct(F.lit("User").alias("type"), F.lit("").alias("id"), name.alias("name")))
    return rows.withColumn("source", F.when(_free() & _anonymous() & (name != ""), fresh).otherwise(F.col("source")))


def short(rows: DataFrame, most: int = SHORT) -> DataFrame:
    return report(rows, [short_(most)])


def without_short(rows: DataFrame, most: int = SHORT) -> DataFrame:
    """Deep repair: unlocked rows of at most so many characters go."""
    return rows.where((F.length(F.trim("content")) > most) | F.col("locked"))


def stale_profiles(profiles: DataFrame, now: float, days: int = STALE_DAYS) -> DataFrame:
    """Compared as text, as the column is stored."""
    return finding(profiles, "stale_profile", "info", F.col("updated_at") < utc_text(F.lit(now - days * 86400.0), "yyyy-MM-dd HH:mm:ss"))


def orphaned(episodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Episodes of which no memory of the agent lies between start and end.

    The agent alone is a hot key. An episode's own day is searched by a join on (agent,
    day); of the days after it only the first memory of each counts, and so many rows
    as an agent has days are put in order. However long an episode is, it is one row.
    """
    day = 86400
    e = episodes.select("id", "agent_id", instant(F.col("start_time")).alias("s"), instant(F.col("end_time")).alias("t")).where("s is not null and t is not null").withColumn("day", F.floor(F.col("s") / day))
    m = rows.select("agent_id", instant(F.col("timestamp")).alias("ts")).where("ts is not null").withColumn("day", F.floor(F.col("ts") / day))
    same = e.join(m.distinct(), ["agent_id", "day"]).where("ts >= s and ts <= t").select("id")
    firsts = m.groupBy("agent_id", "day").agg(F.min("ts").alias("first"))
    later = F.min("first").over(W.partitionBy("agent_id").orderBy("day").rangeBetween(1, W.unboundedFollowing))
    days = firsts.unionByName(e.select("agent_id", "day", F.lit(None).cast("double").alias("first")).distinct()).groupBy("agent_id", "day").agg(F.min("first").alias("first")).withColumn("later", later)
    after = e.join(days.select("agent_id", "day", "later"), ["agent_id", "day"]).where("later <= t").select("id")
    return e.join(same.union(after).distinct(), "id", "left_anti").select("id", "agent_id")


def near_duplicates(rows: DataFrame, least: float = NEAR, most: int = NEAR_ROWS) -> DataFrame:
    """(a, b, sim) among the newest `most` rows of an agent's corpus: cosine above `least`, contents differ."""
    few = rows.where("embedding is not null").orderBy(F.desc("id")).limit(most).select("id", "content", unit(F.col("embedding")).alias("v"))
    a, b = (few.select(F.col("id").alias(n), F.col("content").alias(f"{n}_c"), F.col("v").alias(f"{n}_v")) for n in "ab")
    close = a.join(F.broadcast(b), (F.col("a") < F.col("b")) & (F.size("a_v") == F.size("b_v"))).withColumn("sim", dot(F.col("a_v"), F.col("b_v")))
    return close.where((F.col("sim") > least) & (F.col("a_c") != F.col("b_c"))).select("a", "b", "sim")


def verdict(findings: DataFrame) -> DataFrame:
    """(severity, n): findings by severity. A warning of which nothing can be repaired is information that asks for review."""
    found = findings.where("n > 0").withColumn("severity", F.when((F.col("severity") == "warn") & (F.col("repairable") == 0), "info").otherwise(F.col("severity")))
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def status(findings: DataFrame) -> str:
    """healthy, degraded or critical."""
    seen = {r.severity for r in verdict(findings).collect()}  # three rows at most
    return "critical" if "critical" in seen else "degraded" if "warn" in seen else "healthy"


def memory_findings(width: int, vectors_kept: bool = True, client: bool = True) -> list[Finding]:
    return [annotation_(), mention_(), oversized_(), dimension_(width), no_embedding_(client=client), invalid_json_("source"), invalid_json_("metadata"), invalid_timestamp_(), zone_drift_(), empty_(), invalid_source_(), anonymous_(), vectors_(vectors_kept)]


def all_checks(rows: DataFrame, episodes: DataFrame, profiles: DataFrame, width: int, now: float, tasks: DataFrame | None = None, index: DataFrame | None = None, columns: dict[str, str] | None = None, version: tuple[str | None, str] | None = None, context: tuple[str | None, int] | None = None, vectors_kept: bool = True, client: bool = True) -> DataFrame:
    """(check, severity, n, repairable) of the whole registry, findings of one check added up.

    All checks that count rows of a table by a predicate are one aggregate over it.
    index: a trigram index of the contents, to be held against them; columns: the
    table's expected columns; version: of the stored tables and of the engine; context:
    error and length of the operating context's summary.
    """
    spark = rows.sparkSession
    found = [report(rows, memory_findings(width, vectors_kept, client)), report(episodes, [no_embedding_("null_episode_embedding", client), dimension_(width), missing_start_()]), report(profiles, [oversized_profile_()])]
    found += [episode_drift(episodes), duplicates(rows), repeated_ids(rows), axis_hygiene(rows), readable(rows), finding(no_profile(rows, profiles), "missing_profile", "info", F.lit(True))]
    if tasks is not None:
        found.append(waiting_tasks(tasks, now))
    if index is not None:
        found.append(index_drift(index, rows, "mem", "content"))
    if columns is not None:
        found.append(schema(rows, columns))
    if version is not None:
        found.append(schema_version(*version, spark))
    if context is not None:
        error, length = context
        found.append(spark.createDataFrame([("operating_context_parse", "warn", int(bool(error)), None), ("operating_context_size", "info", int(length > MAX_SUMMARY), None)], "check string, severity string, n long, repairable long"))
    every = reduce(DataFrame.unionByName, found)
    worst = F.max_by("severity", F.array_position(F.array(*map(F.lit, ("ok", "info", "warn", "critical"))), F.col("severity")))
    return every.groupBy("check").agg(worst.alias("severity"), F.sum("n").alias("n"), F.sum("repairable").alias("repairable"))


def in_order(findings: DataFrame) -> DataFrame:
    """Findings in the registry's order; others last."""
    place = F.array_position(F.array(*map(F.lit, REGISTRY)), F.col("check"))
    return findings.orderBy(F.when(place > 0, place).otherwise(len(REGISTRY) + 1), "check")


def repaired(rows: DataFrame, width: int | None = None) -> DataFrame:
    """The next version of memories with all repairs, in the registry's order: what one makes possible the next one finds."""
    out = deduplicated(cut_contents(cleaned(rows)))
    out = without_misfits(out, width) if width else out
    out = valid_json(valid_json(without_repeated_ids(out), "source"), "metadata")
    return valid_sources(without_empty(in_utc(valid_timestamps(out)))).select(*rows.columns)


def repaired_episodes(episodes: DataFrame, width: int | None = None) -> DataFrame:
    out = without_misfits(episodes, width) if width else episodes
    return episodes_in_utc(with_start(out)).select(*episodes.columns)
