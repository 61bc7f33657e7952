"""A memory store on Parquet: the tools by which an agent writes, recalls and maintains its memories.

Each table is a log of numbered folders: whole versions, rows appended after them,
and recall events whose counters are folded in on reading. A number is claimed by
creating a file that must not exist yet, so two writers never share one; a folder counts
once its writer has committed it. Appending takes the next free number; a new
whole version is refused if anything was written since the rows it comes from were
read. Old readers keep what they read until `vacuum`. Tables may be of any size: only
results, counts and single rows come to the driver. Calibration and settings are a
small JSON file, written aside and renamed.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.embedding import Embed, bag_of_words, embedded
from .functions.isolation import visible, written_axis
from .functions.text import instant, sanitised
from .operators import calibrate, fusion, health, writes
from .operators.lexical import Query
from .plans import recall as plan
from .plans.recall import Options
from .shared import stored
from .sources import jsonl

SCHEMAS = {
    "memory": "id long, agent_id string, project_id string, channel string, msg_id string, content string, source string, metadata string, timestamp string, created_at string, embedding array<float>, recall_count long, last_recalled double, locked boolean",
    "episode": "id long, agent_id string, project_id string, channel string, summary string, keywords string, embedding array<float>, start_time string, end_time string, resolved boolean, created_at string",
    "profile": "id long, agent_id string, user_id string, content string, updated_at string",
    "task": "id long, task_type string, agent_id string, project_id string, payload string, retries long, created_at string",
}
MOST_LISTED, MOST_EPISODES, MOST_REFS, MOST_RECALLED = 500, 200, 20, 100
MOST_IMPORT_BYTES = 100 << 20
LONGEST_PAUSE, USUAL_PAUSE = 86_400, 1_800
SCORING, SCHEME = "1", "2"
#: Folders after a whole version at which a write makes the next whole one; seconds after which a claim without data is given up.
MOST_PARTS, ABANDONED = 64, 3600
LIST_CHARS, EPISODE_CHARS, RECALL_CHARS = 1_000_000, 800_000, 200_000
_EVENTS = "id long, seconds double"


class Refused(ValueError):
    """A call that the store doesn't carry out."""


class Conflict(RuntimeError):
    """A new version comes from rows that another writer has changed since; read again and retry."""


def clamped(n: int, cap: int) -> int:
    return max(0, min(n, cap))


class Context:
    """Known projects and their defaults; mode is off, warn or reject. Reads warn at most. `error` tells why it couldn't be read."""

    def __init__(self, projects: set[str] = frozenset(), defaults: dict[str, str] | None = None, mode: str = "off", doctrine: str = "", summary: str = "", error: str | None = None):
        self.projects, self.defaults, self.mode, self.doctrine, self.summary, self.error, self.warnings = set(projects), defaults or {}, mode, doctrine, summary, error, []

    @classmethod
    def parse(cls, text: str) -> Context:
        """From JSON; what can't be read gives a dormant context that says so."""
        try:
            given = json.loads(text)
            return cls(set(given.get("projects", ())), dict(given.get("defaults", {})), given.get("mode", "off"), given.get("doctrine", ""), given.get("summary", ""))
        except (ValueError, TypeError, AttributeError) as e:
            return cls(error=str(e))

    def project(self, project: str | None, agent: str, write: bool) -> str | None:
        if project == "@auto":
            project = self.defaults.get(agent, "")
        if project and self.mode != "off" and project not in self.projects:
            if write and self.mode == "reject":
                raise Refused(f"unknown project {project!r}")
            self.warnings.append(f"unknown project {project!r}")
        return project


class MemoryStore:
    def __init__(self, spark: SparkSession, root: str, embed: Embed | None = bag_of_words, context: Context | None = None, clock=time.time, io_root: str | None = None):
        self.spark, self.root, self.embed, self.context, self.clock = spark, root.rstrip("/"), embed, context or Context(), clock
        self.io_root = (io_root or f"{self.root}/io").rstrip("/")
        self.paused_until: float | None = None
        self.settings = {"threshold": {}, "gate": {}, "precision": {}, "dimension": {}, "scoring": {}, "at": {}, "scheme": SCHEME} | self._settings()

    # ---- versions ----

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _names(self, folder: str) -> list[str]:
        system, path = self._fs(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def _parts(self, table: str) -> list[tuple[int, str, bool]]:
        """(number, kind, whether it is committed) of a table's folders: v whole, a appended rows, e recall events, - claimed only."""
        names = self._names(f"{self.root}/{table}")
        folders = {int(n[1:]): n[0] for n in names if n[0] in "vae" and n[1:].isdigit()}
        claims = {int(n[6:]) for n in names if n.startswith("claim-")}
        system, _ = self._fs(self.root)
        done = {i for i, kind in folders.items() if system.exists(self._fs(f"{self.root}/{table}/{kind}{i:09d}/_SUCCESS")[1])}
        return sorted((i, folders.get(i, "-"), i in done) for i in {*folders, *claims})

    def _claim(self, table: str, number: int) -> bool:
        system, path = self._fs(f"{self.root}/{table}/claim-{number:09d}")
        try:
            return system.createNewFile(path)
        except Exception as e:  # some stores raise where others say no
            if "AlreadyExists" in str(e):
                return False
            raise

    def _under_way(self, table: str, parts: list) -> bool:
        """Whether another writer has claimed a number and may still commit it."""
        system, _ = self._fs(self.root)
        for i, _, done in parts:
            path = self._fs(f"{self.root}/{table}/claim-{i:09d}")[1]
            if not done and system.exists(path) and time.time() - system.getFileStatus(path).getModificationTime() / 1000 < ABANDONED:
                return True
        return False

    def table(self, name: str) -> DataFrame:
        """The rows as of now."""
        parts = [(i, kind) for i, kind, done in self._parts(name) if done]
        whole = max((i for i, kind in parts if kind == "v"), default=0)
        rows = [f"{self.root}/{name}/{kind}{i:09d}" for i, kind in parts if kind != "e" and i >= whole]
        events = [f"{self.root}/{name}/e{i:09d}" for i, kind in parts if kind == "e" and i > whole]
        out = self.spark.read.schema(SCHEMAS[name]).parquet(*rows) if rows else self.spark.createDataFrame([], SCHEMAS[name])
        if events:
            out = writes.counted(out, self.spark.read.schema(_EVENTS).parquet(*events)).select(*out.columns)
        return out

    def version(self, name: str) -> int:
        """The number that the next whole version must follow; to be read before the rows it is made from."""
        return max((i for i, *_ in self._parts(name)), default=0)

    def append(self, name: str, rows: DataFrame, kind: str = "a") -> None:
        """Adds rows (or recall events); other writers may do so at the same time. Nothing is written while persistence is paused."""
        if self.persistence_status()["paused"]:
            return
        parts = self._parts(name)
        number = max((i for i, *_ in parts), default=0) + 1
        while not self._claim(name, number):
            number += 1
        schema = _EVENTS if kind == "e" else SCHEMAS[name]
        rows.select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{self.root}/{name}/{kind}{number:09d}")
        if number - max((i for i, k, done in parts if k == "v" and done), default=0) > MOST_PARTS and not self._under_way(name, self._parts(name)):
            self.compact(name)

    def replace(self, name: str, rows: DataFrame, since: int | None = None) -> None:
        """Writes the next whole version, made from the rows of number `since` (by default now)."""
        if self.persistence_status()["paused"]:
            return
        parts = self._parts(name)
        last = max((i for i, *_ in parts), default=0)
        if self._under_way(name, parts) or (since is not None and since != last) or not self._claim(name, last + 1):
            raise Conflict(f"{name} was written meanwhile")
        rows.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).write.parquet(f"{self.root}/{name}/v{last + 1:09d}")

    def compact(self, name: str) -> None:
        """One whole version of what the table's parts come to."""
        try:
            since = self.version(name)
            self.replace(name, self.table(name), since)
        except Conflict:
            pass  # the parts stay; the next write tries again

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Removes what is older than the last `keep` whole versions; readers of it must have ended. Returns the folders removed."""
        parts = self._parts(name)
        whole = sorted(i for i, kind, done in parts if kind == "v" and done)
        if len(whole) <= keep:
            return 0
        system, _ = self._fs(self.root)
        old = [(i, kind) for i, kind, _ in parts if i < whole[-keep]]
        for i, kind in old:
            system.delete(self._fs(f"{self.root}/{name}/claim-{i:09d}")[1], False)
            if kind != "-":
                system.delete(self._fs(f"{self.root}/{name}/{kind}{i:09d}")[1], True)
        return len(old)

    def memories(self) -> DataFrame:
        return self.table("memory").withColumn("seconds", instant(F.col("timestamp")))

    def _settings(self) -> dict:
        names = [n for n in self._names(f"{self.root}/settings") if n.startswith("s")]
        return json.loads(self.spark.read.text(f"{self.root}/settings/{names[-1]}", wholetext=True).first()[0]) if names else {}

    def _save(self) -> None:
        """A new settings file, written aside and renamed; the last five stay. What another writer has set for other agents since is kept."""
        theirs = self._settings()
        for key, value in theirs.items():
            if isinstance(value, dict):
                self.settings[key] = value | self.settings.get(key, {})
        names = [n for n in self._names(f"{self.root}/settings") if n.startswith("s")]
        number = int(names[-1][1:10]) + 1 if names else 1
        system, aside = self._fs(f"{self.root}/settings/.{uuid.uuid4().hex}")
        out = system.create(aside)
        out.write(bytearray(json.dumps(self.settings).encode()))
        out.close()
        while not system.rename(aside, self._fs(f"{self.root}/settings/s{number:09d}.json")[1]):
            number += 1
        for old in names[:-4]:
            system.delete(self._fs(f"{self.root}/settings/{old}")[1], False)

    def _now(self) -> str:
        return datetime.fromtimestamp(self.clock(), UTC).strftime("%Y-%m-%d %H:%M:%S")

    def _one(self, fields: dict, schema: str) -> DataFrame:
        return self.spark.createDataFrame([Row(**fields)], schema)

    def _vector(self, text: str) -> tuple[float, ...]:
        return tuple(self.embed([text])[0]) if self.embed and text.strip() else ()

    # ---- persistence switch and context ----

    def pause_persistence(self, seconds: float = USUAL_PAUSE) -> dict:
        self.paused_until = self.clock() + min(max(0, seconds), LONGEST_PAUSE)
        return self.persistence_status()

    def resume_persistence(self) -> dict:
        self.paused_until = None
        return self.persistence_status()

    def persistence_status(self) -> dict:
        left = (self.paused_until or 0) - self.clock()
        return {"paused": left > 0, "seconds_left": max(0.0, left)}

    def get_operating_context(self) -> dict:
        return {"projects": sorted(self.context.projects), "defaults": self.context.defaults, "mode": self.context.mode, "doctrine": self.context.doctrine}

    # ---- writes ----

    def store_many(self, rows: DataFrame) -> DataFrame:
        """(seq, result) for a batch of messages (seq, agent_id, project_id, channel, msg_id, content, source, metadata, timestamp; more columns of the table are kept)."""
        memory = self.table("memory")
        results = stored(writes.store(memory, rows), "results")
        good = writes.prepared(rows).join(results.where("result = 'stored'").select("seq"), "seq")
        self.append("memory", self._new_memories(good, memory))
        return results

    def _new_memories(self, good: DataFrame, memory: DataFrame) -> DataFrame:
        """Rows of the memory table from prepared messages; what they lack is filled in, embeddings where there are none."""
        top = memory.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # ids by a running number within and an offset over partitions; no single task orders the batch
        new = good.withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id())
        missing = {"created_at": F.lit(self._now()), "recall_count": F.lit(0).cast("long"), "last_recalled": F.lit(None).cast("double"), "locked": F.lit(False), "embedding": F.lit(None).cast("array<float>")}
        for name, value in missing.items():
            new = new.withColumn(name, F.coalesce(name, value) if name in new.columns else value)
        if self.embed:
            new = embedded(new, F.when(F.col("embedding").isNull(), F.col("content")), self.embed, "made").withColumn("embedding", F.coalesce("embedding", "made"))
        return new.select(*memory.columns)

    def store(self, agent_id: str, message: dict, channel: str = "", project_id: str = "") -> str:
        if self.persistence_status()["paused"]:
            return "paused"
        project = self.context.project(project_id, agent_id, True)
        source = message.get("source")
        fields = {"seq": 0, "agent_id": agent_id, "project_id": written_axis(project), "channel": written_axis(channel), "msg_id": message.get("id") or "", "content": message.get("content"), "source": None if source is None else json.dumps(source), "metadata": json.dumps(message.get("metadata") or {}), "timestamp": message.get("timestamp") or ""}
        rows = self._one(fields, "seq long, agent_id string, project_id string, channel string, msg_id string, content string, source string, metadata string, timestamp string")
        return self.store_many(rows).first().result

    def archive_episode(self, agent_id: str, summary: str, history: list[dict] = (), keywords: str = "", channel: str = "", project_id: str = "", resolved: bool = False) -> int:
        if not summary.strip():
            raise Refused("an episode needs a summary")
        times = sorted(h["timestamp"] for h in history if h.get("timestamp"))
        episodes = self.table("episode")
        number = (episodes.agg(F.max("id")).first()[0] or 0) + 1
        fields = {"id": number, "agent_id": agent_id, "project_id": written_axis(self.context.project(project_id, agent_id, True)), "channel": channel, "summary": summary, "keywords": keywords, "embedding": list(self._vector(summary)) or None, "start_time": times[0] if times else None, "end_time": times[-1] if times else None, "resolved": resolved, "created_at": self._now()}
        self.append("episode", self._one(fields, SCHEMAS["episode"]))
        return number

    def update_profile(self, agent_id: str, content: str, user_id: str = "") -> None:
        if content.strip():
            profiles = self.table("profile")
            fields = {"id": (profiles.agg(F.max("id")).first()[0] or 0) + 1, "agent_id": agent_id, "user_id": user_id, "content": content, "updated_at": self._now()}
            self.replace("profile", writes.profiles_upserted(profiles, self._one(fields, SCHEMAS["profile"])))

    def _own(self, memory_id: int, agent_id: str) -> Row:
        row = self.table("memory").where((F.col("id") == memory_id) & (F.col("agent_id") == agent_id)).first()
        if row is None:
            raise Refused(f"agent {agent_id!r} has no memory {memory_id}")
        return row

    def update_memory(self, agent_id: str, memory_id: int, content: str) -> None:
        if self._own(memory_id, agent_id).locked:
            raise Refused(f"memory {memory_id} is locked")
        since = self.version("memory")
        self.replace("memory", writes.updated(self.table("memory"), memory_id, agent_id, content, list(self._vector(content)) or None), since)

    def lock_memory(self, agent_id: str, memory_id: int, on: bool = True) -> None:
        self._own(memory_id, agent_id)
        since = self.version("memory")
        self.replace("memory", writes.locked(self.table("memory"), memory_id, agent_id, on), since)

    def unlock_memory(self, agent_id: str, memory_id: int) -> None:
        self.lock_memory(agent_id, memory_id, False)

    def delete_memory(self, agent_id: str, memory_id: int) -> None:
        if self._own(memory_id, agent_id).locked:
            raise Refused(f"memory {memory_id} is locked")
        since = self.version("memory")
        self.replace("memory", writes.without(self.table("memory"), [memory_id], agent_id), since)

    def delete_episode(self, agent_id: str, episode_id: int) -> None:
        since = self.version("episode")
        self.replace("episode", writes.without(self.table("episode"), [episode_id], agent_id, False), since)

    def delete_agent_data(self, agent_id: str) -> dict[str, int]:
        counts = {name: self.table(name).where(F.col("agent_id") == agent_id).count() for name in SCHEMAS}
        for name, n in counts.items():
            if n:
                self.replace(name, writes.without_agent(self.table(name), agent_id))
        for part in self.settings.values():
            if isinstance(part, dict):
                part.pop(agent_id, None)
        self._save()
        return counts

    # ---- reads ----

    def _options(self, agent_id: str, **more) -> Options:
        least = self.settings["threshold"].get(agent_id, 0.3)
        return Options(agent=agent_id, least=least, now=self.clock(), calibrated=self.settings["gate"].get(agent_id, {}), **more)

    def _texts(self, memory: DataFrame, episode: DataFrame) -> DataFrame:
        told = memory.select(F.lit("mem").alias("kind"), "id", "content", "timestamp")
        return told.unionByName(episode.select(F.lit("ep").alias("kind"), "id", F.concat(F.lit("[Episode] "), "summary").alias("content"), F.coalesce("start_time", "created_at").alias("timestamp")))

    def recall(self, agent_id: str, query: str, limit: int = 10, project_id: str | None = None, channel: str | None = None, source_id: str | None = None, exclude: list[str] = (), deep: bool = False, mode: str = "rrf", use_confidence: bool = False, full_content: bool = False) -> DataFrame:
        """(qid, place, ref, signal, score, match_reason, content, ...), best last, the agent's profiles among them.

        Contents are previews, or with full_content whole within a budget. With
        confidence, counters of returned memories go up, but not of rows that the gate
        refused.
        """
        project = self.context.project(project_id, agent_id, False)
        o = self._options(agent_id, project=project, channel=channel, source=source_id, limit=clamped(limit, MOST_RECALLED), mode=mode, exclude=list(exclude), deep=deep, use_confidence=use_confidence)
        memory, episode = self.memories(), self.table("episode")
        found = stored(plan.recall(memory, episode, [Query(0, query, self._vector(query))], o, self.table("profile")), "recall")
        ids = F.broadcast(found.where("kind <> 'profile'").select("kind", "id"))  # at most `limit`
        texts = self._texts(memory, episode).join(ids, ["kind", "id"])
        own = [c for c in ("content",) if c in found.columns]
        found = found.withColumnsRenamed({c: "told" for c in own}).join(F.broadcast(texts), ["kind", "id"], "left")
        found = found.withColumn("content", F.coalesce("content", "told")).drop("told") if own else found
        found = fusion.full_contents(found, RECALL_CHARS) if full_content else fusion.preview(found)
        if use_confidence and not deep:
            hit = found.where("kind = 'mem'" + (" and not coalesce(fallback, false)" if "fallback" in found.columns else "")).select("id", F.lit(float(self.clock())).alias("seconds"))
            if not hit.isEmpty():
                self.append("memory", hit, "e")
        return found

    def recall_with_context(self, agent_id: str, query: str, context: list[dict], **more) -> DataFrame:
        found = self.recall(agent_id, query, exclude=[c["content"] for c in context], **more)
        rows = self.spark.createDataFrame([(0, i, c.get("role"), c.get("content"), c.get("timestamp")) for i, c in enumerate(context)], "qid int, pos int, role string, content string, timestamp string")
        return plan.with_context(found.select("qid", "kind", "id", "place"), self.table("memory"), rows)

    def get_contents(self, agent_id: str, refs: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([(0, i, r) for i, r in enumerate(refs)], "qid int, pos int, ref string")
        if len(refs) > MOST_REFS:
            raise Refused(f"too many references ({len(refs)}; at most {MOST_REFS})")
        return plan.contents(rows, self.table("memory"), self.table("episode"), agent_id)

    def get_profile(self, agent_id: str) -> str | None:
        row = self.table("profile").where((F.col("agent_id") == agent_id) & (F.col("user_id") == "")).first()
        return row and row.content

    def list_memories(self, agent_id: str, limit: int = 100, project_id: str | None = None) -> DataFrame:
        """The newest memories of an agent (of all agents where it is empty), whole within a budget of characters, beyond it as previews with a `ref`."""
        rows = self.table("memory").drop("embedding").where(visible(agent_id or None, project_id)).orderBy(F.desc("created_at"), "id").limit(clamped(limit, MOST_LISTED))
        return fusion.degraded(rows.withColumn("qid", F.lit(0)), "mem", ("content",), LIST_CHARS, [F.desc("created_at"), F.col("id")]).drop("qid")

    def list_episodes(self, agent_id: str, limit: int = 50, project_id: str | None = None) -> DataFrame:
        rows = self.table("episode").drop("embedding").where(visible(agent_id or None, project_id)).orderBy(F.desc("created_at"), "id").limit(clamped(limit, MOST_EPISODES))
        return fusion.degraded(rows.withColumn("qid", F.lit(0)), "ep", ("summary", "keywords"), EPISODE_CHARS, [F.desc("created_at"), F.col("id")]).drop("qid")

    def get_queue_status(self) -> dict[str, int]:
        return {r.task_type: r["count"] for r in self.table("task").groupBy("task_type").count().collect()}

    # ---- calibration ----

    def calibrate_threshold(self, agent_id: str, sample_size: int = calibrate.SAMPLE, method: str = "separation", percentile: float = calibrate.PERCENTILE, z_factor: float = calibrate.Z, seed: int | None = None, mode: str = "rrf", use_confidence: bool = False) -> float:
        if method not in ("separation", "percentile", "zscore"):
            raise Refused(f"unknown method {method!r}")
        own = self.memories().where(F.col("agent_id") == agent_id)
        few = calibrate.sample(own, sample_size, seed)
        if few.count() < calibrate.LEAST_SAMPLE:
            raise Refused("too few embeddings")
        null = calibrate.pairs(few)
        if method == "percentile":
            found = calibrate.by_percentile(null, percentile)
        elif method == "zscore":
            found = calibrate.by_zscore(null, z_factor)
        else:
            positive = calibrate.adjacent(few.where("seconds is not null")).select("sim")
            if positive.count() < 10:
                positive = calibrate.nearest(null).select("sim")
            found = calibrate.by_separation(null, positive, calibrate.PRECISION[self.settings["precision"].get(agent_id, "balanced")])
        value = found.first().threshold
        self.settings["threshold"][agent_id] = value
        self.settings["dimension"][agent_id] = len(few.first().embedding)
        self.settings["scoring"][agent_id] = SCORING
        self.settings["at"][agent_id] = float(self.clock())
        gate = self.calibrate_gate(agent_id, seed=seed, mode=mode, use_confidence=use_confidence)
        if gate is not None:
            self.settings["gate"][agent_id] = {"confidence" if use_confidence else mode: gate}
        self._save()
        return value

    def calibrate_gate(self, agent_id: str, queries: int = 40, draws: int = 5, seed: int | None = None, mode: str = "rrf", use_confidence: bool = False) -> float | None:
        """Upper median over draws of the threshold that separates results near a simulated query's time from others.

        Each draw takes stored memories as queries and lets the live recall find and
        score rows for them; the score is that of the signal the gate goes by. A row
        counts as relevant if it was written within half an hour of its query. All draws
        are one batch. None where nothing but the vector threshold decides, or too
        little is found.
        """
        signal = "confidence" if use_confidence else mode
        if not self.embed or signal not in ("confidence", "rrf", "rsf"):
            return None
        memory, episode = self.memories(), self.table("episode")
        own = memory.where((F.col("agent_id") == agent_id) & F.col("embedding").isNotNull() & (F.trim(F.coalesce("content", F.lit(""))) != "") & F.col("seconds").isNotNull())
        asked = [(d, r) for d in range(draws) for r in own.orderBy(F.rand((seed or 0) + d), "id").limit(queries).select("id", "seconds", "content").collect()]  # queries x draws rows
        if not asked:
            return None
        batch = [Query(i, r.content, self._vector(r.content)) for i, (_, r) in enumerate(asked)]
        o = self._options(agent_id, limit=20, mode=mode, use_confidence=use_confidence)
        rows, _ = plan.scored(plan.fused(memory, episode, batch, o), memory, episode, batch, o)
        told = self.spark.createDataFrame([(i, d, r.id, r.seconds) for i, (d, r) in enumerate(asked)], "qid long, draw int, own long, q_seconds double")
        rows = rows.join(F.broadcast(told), "qid").where(~((F.col("kind") == "mem") & (F.col("id") == F.col("own"))) & F.col(signal).isNotNull())
        rows = stored(rows.select("draw", F.col(signal).cast("double").alias("sim"), F.coalesce((F.abs(F.col("seconds") - F.col("q_seconds")) <= calibrate.ADJACENT_SECONDS).cast("int"), F.lit(0)).alias("pos")), "gate")
        beta = calibrate.PRECISION[self.settings["precision"].get(agent_id, "balanced")]
        found = []
        for d in range(draws):
            part = rows.where(F.col("draw") == d)
            n = part.agg(F.count_if(F.col("pos") == 0).alias("null"), F.count_if(F.col("pos") == 1).alias("pos")).first()
            if n["null"] >= 10 and n["pos"] >= 5:
                found.append(calibrate.by_separation(part.where("pos = 0").select("sim"), part.where("pos = 1").select("sim"), beta).first().threshold)
        return sorted(found)[len(found) // 2] if found else None

    def set_recall_precision(self, agent_id: str, precision: str) -> None:
        """Changes the precision and calibrates anew; the old one comes back if that fails."""
        if precision not in calibrate.PRECISION:
            raise Refused(f"unknown precision {precision!r}")
        before = dict(self.settings["precision"])
        self.settings["precision"][agent_id] = precision
        try:
            self.calibrate_threshold(agent_id)
        except Exception:
            self.settings["precision"] = before
            raise

    def get_recall_precision(self, agent_id: str) -> str:
        return self.settings["precision"].get(agent_id, "balanced")

    def calibration_stale(self, agent_id: str) -> bool:
        """Whether what was calibrated no longer fits: other vectors, another scoring, or more than 90 days old. Without calibration: whether there is enough to calibrate."""
        own = self.table("memory").where((F.col("agent_id") == agent_id) & F.col("embedding").isNotNull())
        row = own.select(F.size("embedding").alias("wide")).first()
        if row is None:
            return False
        at = self.settings["at"].get(agent_id)
        if at is None:
            return own.limit(50).count() >= 50
        return calibrate.stale(self.settings["dimension"].get(agent_id), self.settings["scoring"].get(agent_id), row.wide, SCORING, (self.clock() - at) / 86_400)

    # ---- transfer ----

    def _confined(self, path: str) -> str:
        """A path below io_root; parts that lead out are refused."""
        parts = PurePosixPath(path).parts
        if path.startswith("/") or ".." in parts or not parts:
            raise Refused(f"{path!r} leaves the transfer folder")
        return f"{self.io_root}/{'/'.join(parts)}"

    def export_memories(self, path: str, agent_id: str | None = None) -> str:
        target = self._confined(path)
        jsonl.export(target, self.table("memory"), self.table("episode"), self.table("profile"), agent_id)
        return target

    def import_memories(self, path: str, agent_id: str | None = None, dry_run: bool = True) -> dict[str, int]:
        """Counts by result; problems in the file abort before anything is written."""
        where = self._confined(path)
        system, folder = self._fs(where)
        if system.getContentSummary(folder).getLength() > MOST_IMPORT_BYTES:
            raise Refused("the file is too large")
        rows = jsonl.load(self.spark, where)
        wrong = {r.problem: r.n for r in jsonl.problems(rows).collect()}
        if any(k.endswith("differs") for k in wrong):
            raise Refused(f"counts differ from the header: {wrong}")
        owner = F.coalesce(F.lit(agent_id), F.col("agent_id"))
        axes = [F.coalesce(c, F.lit("")).alias(c) for c in ("project_id", "channel")]
        vector = jsonl.decode_embedding().alias("embedding")
        memories = rows.where("_type = 'memory'").select("seq", owner.alias("agent_id"), *axes, F.coalesce("msg_id", F.lit("")).alias("msg_id"), "content", "source", "metadata", F.coalesce("timestamp", F.lit("")).alias("timestamp"), "created_at", "locked", "recall_count", "last_recalled", vector)
        episodes = rows.where("_type = 'episode'").select("seq", owner.alias("agent_id"), *axes, "summary", F.coalesce("keywords", F.lit("")).alias("keywords"), "start_time", "end_time", F.coalesce("resolved", F.lit(False)).alias("resolved"), F.coalesce("created_at", F.lit(self._now())).alias("created_at"), vector)
        profiles = rows.where("_type = 'profile'").select("seq", owner.alias("agent_id"), F.coalesce("user_id", F.lit("")).alias("user_id"), "content", F.coalesce("updated_at", F.lit(self._now())).alias("updated_at"))
        results = stored(writes.imported(self.table("memory"), memories), "imported")
        talked = stored(writes.episodes_imported(self.table("episode"), episodes), "imported")
        counts = {r.result: r.n for r in results.groupBy("result").agg(F.count("*").alias("n")).collect()} | wrong
        counts |= {f"episodes_{r.result}": r.n for r in talked.groupBy("result").agg(F.count("*").alias("n")).collect()}
        if told := profiles.where("trim(coalesce(content, '')) <> ''").count():
            counts["profiles_updated"] = told
        if dry_run:
            return counts
        if counts.get("stored"):
            good = writes.prepared(memories).join(results.where("result = 'stored'").select("seq"), "seq")
            self.append("memory", self._new_memories(good, self.table("memory")))
        if counts.get("episodes_stored"):
            top = self.table("episode").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            good = episodes.withColumn("summary", sanitised(F.col("summary"))).join(talked.where("result = 'stored'").select("seq"), "seq")
            self.append("episode", good.withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id()))
        if told:
            since, have = self.version("profile"), self.table("profile")
            top = have.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            self.replace("profile", writes.profiles_imported(have, profiles.withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id())), since)
        return counts

    def merge_memories(self, source: str, target: str, move: bool = False, dry_run: bool = True) -> dict[str, int]:
        """Counts by action for memories, and for episodes and profiles with their names before it. What can't go stays at the source."""
        counts: dict[str, int] = {}
        for name, fn, prefix in (("memory", writes.merged, ""), ("episode", writes.episodes_merged, "episodes_"), ("profile", writes.profiles_merged, "profiles_")):
            since, rows = self.version(name), self.table(name)
            told = stored(fn(rows, source, target, move), "merge")
            counts |= {prefix + r.action: r.n for r in told.groupBy("action").agg(F.count("*").alias("n")).collect()}
            if dry_run or not any(counts.get(prefix + x) for x in ("copied", "moved")):
                continue
            chosen = told.where("action in ('copied', 'moved')").select("id", F.lit(True).alias("taken"))
            if move:
                out = rows.join(chosen, "id", "left").withColumn("agent_id", F.when(F.col("taken"), target).otherwise(F.col("agent_id")))
                self.replace(name, out, since)
            else:
                top = rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
                self.append(name, rows.join(chosen, "id").withColumns({"agent_id": F.lit(target), "id": F.lit(top + 1) + F.monotonically_increasing_id()}))
        return counts

    def migrate_channel_axis(self, agent_id: str = "", dry_run: bool = True, globalise: bool = False) -> dict[str, int]:
        since, memory = self.version("memory"), self.table("memory")
        mine = memory.where(F.col("agent_id") == agent_id) if agent_id else memory
        counts = {r.recovered or "": r.n for r in writes.channels(mine).groupBy("recovered").agg(F.count("*").alias("n")).collect()}  # one row a channel of the bridge
        if not dry_run:
            rest = memory.where(F.col("agent_id") != agent_id) if agent_id else memory.limit(0)
            self.replace("memory", writes.migrated(mine, globalise).select(*memory.columns).unionByName(rest), since)
        return counts

    # ---- maintenance ----

    def check_health(self, agent_id: str = "", fix: bool = False) -> DataFrame:
        """(check, severity, n, repairable) in the registry's order; with fix, what can be repaired is repaired first, and the findings are what is left."""
        mine = lambda df: df.where(F.col("agent_id") == agent_id) if agent_id else df
        others = lambda df: df.where(F.col("agent_id") != agent_id) if agent_id else df.limit(0)
        first = self.table("memory").where("embedding is not null").select(F.size("embedding").alias("wide")).first()
        wide = len(self.embed(["test"])[0]) if self.embed else first.wide if first else 0
        if fix:
            repairs = {"memory": lambda df: health.repaired(df, wide), "episode": lambda df: health.repaired_episodes(df, wide), "profile": health.cut_profiles, "task": lambda df: health.without_waiting(df, self.clock())}
            for name, repair in repairs.items():
                since, rows = self.version(name), self.table(name)
                if since:
                    self.replace(name, repair(mine(rows)).select(*rows.columns).unionByName(others(rows)), since)
            self.embed_missing()
        columns = {c.split()[0]: c.split()[1].replace("long", "bigint") for c in SCHEMAS["memory"].split(", ")}
        found = health.all_checks(mine(self.table("memory")), mine(self.table("episode")), mine(self.table("profile")), wide, self.clock(), mine(self.table("task")), columns=columns, version=(self.settings.get("scheme"), SCHEME), context=(self.context.error, len(self.context.summary)), client=self.embed is not None)
        return health.in_order(found)

    def deep_check(self, agent_id: str, fix: bool = False) -> dict[str, int]:
        """Counts by check; with fix, anonymous rows take the name their content begins with and short ones go first."""
        since, rows = self.version("memory"), self.table("memory")
        own = F.col("agent_id") == agent_id
        if fix:
            self.replace("memory", health.without_short(health.with_names(rows.where(own))).select(*rows.columns).unionByName(rows.where(~own)), since)
        memory, episode = self.table("memory").where(own), self.table("episode").where(own)
        return {
            "anonymous": health.named_sources(memory).count(),
            "short": health.short(memory).first().n,
            "stale_profile": health.stale_profiles(self.table("profile").where(own & (F.col("user_id") == "")), self.clock()).first().n,
            "orphaned_episodes": health.orphaned(episode, memory).count(),
            "near_duplicates": health.near_duplicates(memory).count(),
            "calibration_stale": int(self.calibration_stale(agent_id)),
        }

    def status(self, agent_id: str = "") -> str:
        return health.status(self.check_health(agent_id))

    def embed_missing(self, most: int = 500) -> None:
        """Refills null embeddings of the oldest rows of either table; needs an embedding function."""
        for name, text in (("memory", "content"), ("episode", "summary")) if self.embed else ():
            since, rows = self.version(name), self.table(name)
            gaps = rows.where(F.col("embedding").isNull() & (F.trim(F.coalesce(text, F.lit(""))) != "")).orderBy("id").limit(most)
            if not gaps.isEmpty():
                filled = embedded(gaps.select("id", F.col(text).alias("text")), F.col("text"), self.embed, "made").select("id", "made")
                self.replace(name, rows.join(F.broadcast(filled), "id", "left").withColumn("embedding", F.coalesce("embedding", "made")), since)
