"""Sink for an outside vector index: rows go to it from the executors, in chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 128
#: What a service is told: an action (index, remove or purge), a namespace, and items (id and text) or ids.
Post = Callable[[str, str, list], None]


def namespace(agent: str) -> str:
    return f"memories:{agent}"


def _sent(rows: DataFrame, action: str, post: Post, columns: list[str]) -> DataFrame:
    """(agent_id, sent, failed): what a task has told the service; a chunk that fails is counted and doesn't end the rest."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list] = {}
        counts: dict[str, list[int]] = {}

        def flush(agent: str) -> None:
            items = held.pop(agent)
            told = counts.setdefault(agent, [0, 0])
            try:
                post(action, namespace(agent), items)
                told[0] += len(items)
            except Exception:
                told[1] += len(items)

        for batch in batches:
            for agent, ref, *text in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(agent, []).append({"id": ref, "text": text[0]} if text else ref)
                if len(held[agent]) >= CHUNK:
                    flush(agent)
        for agent in list(held):
            flush(agent)
        if counts:
            agents, told = zip(*counts.items())
            sent, failed = zip(*told)
            yield pa.RecordBatch.from_arrays([pa.array(agents), pa.array(sent, pa.int64()), pa.array(failed, pa.int64())], names=["agent_id", "sent", "failed"])

    done = rows.select(*columns).mapInArrow(run, "agent_id string, sent long, failed long")
    return done.groupBy("agent_id").agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed"))


def upsert(rows: DataFrame, kind: str, post: Post, text: str = "content") -> DataFrame:
    """Tells the index the rows of a table (kind mem or ep); blank texts aren't sent. An index takes an id again as an update, so a repeated task does no harm."""
    told = rows.where(F.trim(F.coalesce(text, F.lit(""))) != "").select("agent_id", F.concat(F.lit(f"{kind}:"), "id").alias("ref"), F.col(text).alias("text"))
    return _sent(told, "index", post, ["agent_id", "ref", "text"])


def remove(rows: DataFrame, kind: str, post: Post) -> DataFrame:
    return _sent(rows.select("agent_id", F.concat(F.lit(f"{kind}:"), "id").alias("ref")), "remove", post, ["agent_id", "ref"])


def purge(agent: str, post: Post) -> None:
    post("purge", namespace(agent), [])
