"""Incremental ingest and usage counters with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

RETRIES = 3


def deduplicated(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """First row of each key; with a time column the state of keys older than `late` goes."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions that a gap of silence ends."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    found = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def recall_counts(stream: DataFrame, key: str, time: str) -> DataFrame:
    """(key, n, last): running counters of recall events."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.max(time).alias("last"))


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there into a Parquet folder (append) or a table of full results (complete) and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return query


def new_rows(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """What a micro-batch adds to a table: keys that are in neither the table nor an earlier row of the batch. Replays add nothing."""
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def work(tasks: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, action) for queued tasks in order of id: done, retry, or discarded after RETRIES failures. failed: ids that failed this time."""
    told = tasks.join(failed.select("id", F.lit(True).alias("failed")), "id", "left")
    action = F.when(F.col("failed").isNull(), "done").when(F.col("retries") + 1 >= RETRIES, "discarded").otherwise("retry")
    return told.select("id", action.alias("action"), F.row_number().over(W.partitionBy("task_type").orderBy("id")).alias("turn"))


def embedding_health(events: DataFrame, key: str = "endpoint") -> DataFrame:
    """(key, seq, state) of a service from its calls (key, seq, ok): unknown, healthy, hint after one failure, fault after two in a row."""
    by = W.partitionBy(key).orderBy("seq")
    last_ok = F.max(F.when(F.col("ok"), F.col("seq"))).over(by)
    rows = events.withColumn("last_ok", last_ok)
    run = F.count_if(~F.col("ok")).over(W.partitionBy(key, "last_ok").orderBy("seq"))
    return rows.select(key, "seq", F.when(F.col("ok"), "healthy").when(run >= 2, "fault").otherwise("hint").alias("state"))
