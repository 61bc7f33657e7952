"""Vector and lexical candidates, for one query or a batch of them.

Candidate rows: qid, kind ('mem' or 'ep'), id, score, ord. Identity is (kind, id).
Equal similarities are ordered newest first, as a scan from the newest row would find them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scoring import dot
from ..functions.text import contains_literal, occurrences, phrases, trigrams
from ..shared import scratch, stored
from .lexical import B, K1, Corpus, Query, idf, matching_batch

SCAN_WINDOW = 10_000
LEAST_SIMILARITY = 0.3
#: Numbers in the query matrix that one pass over the corpus carries.
QUERY_BLOCK = 4 << 20


def newest(rows: DataFrame, n: int = SCAN_WINDOW, dimension: int | None = None) -> DataFrame:
    """The newest n rows that have an embedding (of a dimension); ties by id. Only slim columns are sorted."""
    found = rows.where(F.col("embedding").isNotNull())
    return found.where(F.size("embedding") == dimension).orderBy(F.desc("created_at"), "id").limit(n) if dimension else found.orderBy(F.desc("created_at"), "id").limit(n)


def similar(rows: DataFrame, vector: list[float], least: float = LEAST_SIMILARITY, k: int | None = None) -> DataFrame:
    """rows with a column `cosine` of at least `least`, best first by cosine, created_at and id; whole-stage code only.

    Cosines are rounded to nine places, so that equal vectors tie however they are summed.
    """
    found = rows.where(F.size("embedding") == len(vector)).withColumn("cosine", F.round(dot(F.col("embedding"), vector), 9)).where(F.col("cosine") >= least)
    return found.orderBy(F.desc("cosine"), F.desc("created_at"), "id").limit(k) if k is not None else found


def hydrated(ranked: DataFrame, rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Fetches the wide columns of ranked ids; ranked is a top-k, so Spark broadcasts it."""
    return ranked.join(rows.select("id", *keep), "id")


def by_rank(hits: DataFrame, rows: DataFrame, within: Column | None = None) -> DataFrame:
    """Rows for a ranked id list of an outside index (id, rank), in its order: the predicates are applied again and ids that are gone drop out."""
    found = hits.join(rows if within is None else rows.where(within), "id")
    return found.withColumn("place", F.row_number().over(W.orderBy("rank", "id")))  # a list of at most a query's limit


def query_blocks(queries: DataFrame, wide: int) -> list[str]:
    """Writes the vectors of a query table (qid, vector) to files of at most QUERY_BLOCK numbers in the shared folder; their paths."""
    folder = scratch(queries.sparkSession, "queries")
    step = max(1, QUERY_BLOCK // max(1, wide))

    def write(batches):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        held: list[pa.RecordBatch] = []

        def flush():
            import uuid

            name = uuid.uuid4().hex
            table = pa.Table.from_batches(held)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(np.array([table.num_rows], np.int64).tobytes())
                out.write(table.column(0).to_numpy().astype(np.int64).tobytes())
                out.write(table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                if sum(b.num_rows for b in held) >= step:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    even = queries.where(F.size("vector") == wide).select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).coalesce(8)
    return [r.path for r in stored(even.mapInArrow(write, "path string"), "query-blocks").collect()]  # names; one a block


def read_block(path: str) -> tuple[np.ndarray, np.ndarray]:
    from pyarrow import fs

    system, file = fs.FileSystem.from_uri(path)
    with system.open_input_file(file) as f:
        raw = f.read()
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.float64, -1, 8 + 8 * n).reshape(n, -1)


def best_first(cosines: np.ndarray, made: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by cosine, then newest, then smallest id."""
    if len(ids) > k:  # what is below the k-th cosine can't be among them
        least = np.partition(cosines, len(ids) - k)[len(ids) - k]
        some = np.flatnonzero(cosines >= least)
    else:
        some = np.arange(len(ids))
    age = -np.unique(made[some], return_inverse=True)[1]
    return some[np.lexsort((ids[some], age, -cosines[some]))[:k]]


def similar_batch(rows: DataFrame, queries: list[Query] | DataFrame, k: int, least: float = LEAST_SIMILARITY, wide: int | None = None) -> DataFrame:
    """(qid, id, cosine, created_at, rank) of the k nearest rows of each query, exact, one matrix product a batch of rows.

    A task keeps its k best rows a query, so at most k rows a query and task are
    shuffled. Queries go out in blocks of bounded size, one pass over the rows a
    block; those of a table (qid, vector; of `wide` numbers) never pass through the
    driver. Rows without created_at are ordered by id where they tie.
    """
    spark = rows.sparkSession
    if isinstance(queries, DataFrame):
        wide = wide or (queries.select(F.max(F.size("vector"))).first()[0] or 0)
        blocks = query_blocks(queries, wide)
        reads = [lambda path=path: read_block(path) for path in blocks]
    else:
        wide = max((len(q.vector) for q in queries), default=0)
        step = max(1, QUERY_BLOCK // max(1, wide))
        reads = []
        for at in range(0, len(queries), step):
            part = [q for q in queries[at : at + step] if len(q.vector) == wide]
            told = spark.sparkContext.broadcast((np.array([q.qid for q in part], np.int64), np.array([q.vector for q in part], np.float64).reshape(len(part), wide)))
            reads.append(lambda told=told: told.value)
    made = F.coalesce("created_at", F.lit("")) if "created_at" in rows.columns else F.lit("")
    slim = rows.where(F.size("embedding") == wide).select("id", "embedding", made.alias("created_at"))
    names = "qid long, id long, cosine double, created_at string"
    frames = []
    for read in reads:

        def best(batches, read=read):
            qids, matrix = read()
            held: list[tuple] | None = None  # per query: cosines, times and ids of the best so far
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                times = np.array(batch.column(2).to_pylist(), np.str_)
                cosines = np.round(matrix @ batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64).T, 9)
                held = held or [(np.zeros(0), np.zeros(0, "U1"), np.zeros(0, np.int64))] * len(qids)
                for i, row in enumerate(cosines):
                    near = np.flatnonzero(row >= least)
                    own = [np.concatenate([a, b]) for a, b in zip(held[i], (row[near], times[near], ids[near]))]
                    keep = best_first(*own, k)
                    held[i] = tuple(x[keep] for x in own)
            if held:
                cos, times, ids = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, [len(x[0]) for x in held]), pa.int64()), pa.array(ids.astype(np.int64)), pa.array(cos), pa.array(times.tolist(), pa.string())], names=[n.split()[0] for n in names.split(", ")])

        frames.append(slim.mapInArrow(best, names))
    found = frames[0] if frames else spark.createDataFrame([], names)
    for f in frames[1:]:
        found = found.union(f)
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("cosine"), F.desc("created_at"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# ---- lexical ----------------------------------------------------------------


def postings(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """(kind, id, col, pos, tri): the trigram index of the text columns."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), trigrams(F.col(c)).alias("t")) for i, c in enumerate(columns)]))
    return rows.select(F.lit(kind).alias("kind"), "id", parts.alias("p")).select("kind", "id", "p.col", F.posexplode("p.t").alias("pos", "tri"))


def phrase_hits(index: DataFrame, phrase: str) -> DataFrame:
    """(kind, id, f): rows that hold a phrase, by joining consecutive trigrams of the index."""
    low = phrase.lower()
    grams = [(low[i : i + 3], i) for i in range(len(low) - 2)]
    wanted = index.sparkSession.createDataFrame(grams, "tri string, off int")
    starts = index.join(F.broadcast(wanted), "tri").groupBy("kind", "id", "col", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == len(grams)).groupBy("kind", "id").agg(F.count("*").alias("f"))


def _low(columns: tuple[str, ...]) -> list[Column]:
    return [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]


def _size(columns: tuple[str, ...]) -> Column:
    return sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in _low(columns)[1:]), F.greatest(F.length(_low(columns)[0]) - 2, F.lit(0)))


def _frequency(columns: tuple[str, ...], phrase: str) -> Column:
    first, *rest = [occurrences(c, phrase) for c in _low(columns)]
    return sum(rest, first)


def corpus_stats(rows: DataFrame, terms: list[str], *columns: str) -> Corpus:
    """One aggregate over the table; one row comes back, with a number a phrase."""
    found = rows.agg(F.count("*").alias("n"), F.avg(_size(columns)).alias("l"), *[F.count_if(_frequency(columns, t) > 0).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return Corpus(found.n, found.l or 0.0, {t: found[f"t{i}"] for i, t in enumerate(terms)})


def bm25(stats: Corpus, terms: list[str], *columns: str) -> Column:
    """Score of a row, more being better; null where no phrase occurs."""
    total, any_hit = F.lit(0.0), F.lit(0)
    for t in terms:
        f = _frequency(columns, t)
        total = total + idf(stats, t) * f * (K1 + 1) / (f + K1 * (1 - B + B * _size(columns) / max(stats.average, 1e-9)))
        any_hit = any_hit + f
    return F.when(any_hit > 0, F.round(total, 9))


def matching(rows: DataFrame, query: str, k: int | None = None, within: Column | None = None, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """rows with a column `bm25`, best first. Statistics are over all rows, `within` filters afterwards."""
    terms = phrases(query)
    if not terms:
        return rows.where(F.lit(False)).withColumn("bm25", F.lit(None).cast("double"))
    stats = corpus_stats(rows, terms, *columns)
    found = (rows if within is None else rows.where(within)).withColumn("bm25", bm25(stats, terms, *columns)).where("bm25 is not null")
    return found if k is None else found.orderBy(F.desc("bm25"), "id").limit(k)


def containing(rows: DataFrame, query: str, limit: int, window: int = SCAN_WINDOW) -> DataFrame:
    """The newest rows that contain the query literally."""
    cap = min(window, max(5 * limit, 50))
    return rows.where(contains_literal(F.col("content"), query)).orderBy(F.desc("created_at"), "id").limit(cap).orderBy(F.desc("created_at"), "id").limit(limit)


def keyword(rows: DataFrame, query: str, limit: int, within: Column | None = None) -> DataFrame:
    """Newest rows for an empty query, else BM25, else (no phrase or no match at all) literal containment."""
    own = rows if within is None else rows.where(within)
    if not query.strip():
        return own.orderBy(F.desc("created_at"), "id").limit(limit).withColumn("bm25", F.lit(None).cast("double"))
    found = matching(rows, query, limit, within)
    if phrases(query) and not found.isEmpty():
        return found
    return containing(own, query, limit).withColumn("bm25", F.lit(None).cast("double"))
