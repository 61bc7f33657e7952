"""Lexical search for a batch of queries: one pass over the texts for all phrases of the batch.

An Aho-Corasick automaton of all phrases counts them in lower-cased text, overlaps
included. What is kept of a row is its length and the phrases it holds; statistics
and scores come from these slim rows, so texts are read once a batch, however many
queries it has. Counts of the whole table (BM25's rows, lengths, rows that hold a
phrase) are gathered before any isolation, as a full-text index would.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from math import log
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import lower_ascii, phrases
from ..shared import stored

K1, B = 1.2, 0.75
#: Characters of text after which the rows so far are handed on, and (row, query) scores held at once.
PIECE, SCORES = 4 << 20, 2 << 20
_HITS = "term int, n long, length long, ids binary, sizes binary, starts binary, terms binary, counts binary"


@dataclass(frozen=True)
class Query:
    qid: int
    text: str = ""
    vector: tuple[float, ...] = ()


@dataclass(frozen=True)
class Corpus:
    """What BM25 asks of the whole table."""

    rows: int
    average: float
    holding: dict[str, int]


def automaton(terms: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        found.add_word(t, i)
    found.make_automaton()
    return found


def _lowered(columns: tuple[str, ...]) -> list[Column]:
    return [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"x{i}") for i, c in enumerate(columns)]


def counts(rows: DataFrame, terms: list[str], columns: tuple[str, ...], within: Column | None = None) -> tuple[DataFrame, Corpus]:
    """(packed counts of the rows within, statistics of all rows) for lower-cased distinct terms."""
    slim = rows.select("id", F.coalesce(F.lit(True) if within is None else within, F.lit(False)).alias("mine"), *_lowered(columns))
    many = len(terms)

    def scan(batches):
        machine, second = automaton(terms), itemgetter(1)
        total, rows_, holding = 0, 0, np.zeros(many, np.int64)
        held: tuple[list, list, list, list] = ([], [], [], [])
        chars = 0

        def flush():
            ids, sizes, found, n = held
            starts = np.cumsum([0, *map(len, found)]).astype(np.int32)
            data = [np.array(ids, np.int64), np.array(sizes, np.int32), starts, np.array([t for x in found for t in x], np.int32), np.array([c for x in n for c in x], np.int32)]
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], names=[c.split()[0] for c in _HITS.split(", ")])

        for batch in batches:
            for i, mine, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                size = sum(max(len(t) - 2, 0) for t in texts)
                total, rows_ = total + size, rows_ + 1
                own: Counter = Counter()
                for t in texts:
                    own.update(map(second, machine.iter(t)))
                if own:
                    order = sorted(own)
                    holding[order] += 1
                    if mine:
                        for x, v in zip(held, (i, size, order, [own[o] for o in order])):
                            x.append(v)
                chars += size
                if chars >= PIECE:
                    if held[0]:
                        yield flush()
                    held, chars = ([], [], [], []), 0
        if held[0]:
            yield flush()
        at = np.flatnonzero(holding)
        n = len(at) + 1
        none = [pa.nulls(n, pa.binary())] * 5
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([rows_, *holding[at].tolist()], pa.int64()), pa.array([total] + [0] * len(at), pa.int64()), *none], names=[c.split()[0] for c in _HITS.split(", ")])

    found = stored(slim.mapInArrow(scan, _HITS), "lexical")
    stats = {r.term: (r.n, r.length) for r in found.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()}  # a row a phrase of the batch
    n, length = stats.get(-1, (0, 0))
    return found.where("term is null"), Corpus(n, length / n if n else 0.0, {t: stats.get(i, (0, 0))[0] for i, t in enumerate(terms)})


def idf(stats: Corpus, term: str) -> float:
    n = stats.holding[term]
    x = log((stats.rows - n + 0.5) / (n + 0.5))
    return x if x > 0 else 1e-6


def scores(packed: DataFrame, stats: Corpus, terms: list[str], wanted: dict[int, list[str]], k: int) -> DataFrame:
    """(qid, id, bm25): a task's k best rows of each query. wanted: the phrases of each query."""
    place = {t: i for i, t in enumerate(terms)}
    qids = list(wanted)
    weights = np.array([idf(stats, t) for t in terms])
    pairs = sorted((place[t], q) for q, ts in enumerate(wanted.values()) for t in ts)
    ends = np.searchsorted([t for t, _ in pairs], np.arange(len(terms) + 1))
    told = packed.sparkSession.sparkContext.broadcast((np.array(qids), weights, np.array([q for _, q in pairs], np.int64), ends, max(stats.average, 1e-9)))  # the batch's phrases

    def best(batches):
        qids, weights, queries, ends, average = told.value
        many = len(qids)
        held = [np.zeros((0, 2))] * many
        for batch in batches:
            for raw in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "starts", "terms", "counts"))):
                ids, sizes, starts, found, n = (np.frombuffer(x, kind) for x, kind in zip(raw, (np.int64, np.int32, np.int32, np.int32, np.int32)))
                lengths = np.diff(starts)
                part = weights[found] * n * (K1 + 1) / (n + np.repeat(K1 * (1 - B + B * sizes / average), lengths))
                step = max(1, SCORES // max(1, many))
                for a in range(0, len(ids), step):
                    b = min(len(ids), a + step)
                    own = slice(starts[a], starts[b])
                    row = np.repeat(np.arange(b - a), lengths[a:b])
                    each = (ends[found[own] + 1] - ends[found[own]]).astype(np.int64)
                    at = np.repeat(ends[found[own]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    cell = np.repeat(row, each) * many + queries[at]
                    total = np.bincount(cell, np.repeat(part[own], each), (b - a) * many).reshape(b - a, many)
                    hit = np.bincount(cell, minlength=(b - a) * many).reshape(b - a, many) > 0
                    for q in np.flatnonzero(hit.any(axis=0)).tolist():
                        rows_ = np.flatnonzero(hit[:, q])
                        both = np.concatenate([held[q], np.stack([np.round(total[rows_, q], 9), ids[a:b][rows_].astype(np.float64)], 1)])
                        held[q] = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
        lengths = [len(x) for x in held]
        rows_ = np.concatenate(held) if held else np.zeros((0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, lengths), pa.int64()), pa.array(rows_[:, 1].astype(np.int64)), pa.array(rows_[:, 0])], names=["qid", "id", "bm25"])

    return packed.select("ids", "sizes", "starts", "terms", "counts").mapInArrow(best, "qid long, id long, bm25 double")


def matching_batch(rows: DataFrame, queries: list[Query], k: int, within: Column | None = None, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """(qid, id, bm25, rank) of the k best rows of each query; ties by id. Ids are whole numbers below 2^53."""
    wanted = {q.qid: [t.lower() for t in phrases(q.text)] for q in queries}  # spellings that differ in case count apart
    wanted = {i: ts for i, ts in wanted.items() if ts}
    terms = list(dict.fromkeys(t for ts in wanted.values() for t in ts))
    if not terms:
        return rows.sparkSession.createDataFrame([], "qid long, id long, bm25 double, rank int")
    packed, stats = counts(rows, terms, columns, within)
    found = scores(packed, stats, terms, wanted, k)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bm25"), "id"))).where(F.col("rank") <= k)


def containing_batch(rows: DataFrame, queries: list[Query], k: int, within: Column | None = None, column: str = "content") -> DataFrame:
    """(qid, id, rank) of the newest k rows that hold each query's text literally, ASCII case aside."""
    asked = {q.qid: q.text.translate({i: i + 32 for i in range(65, 91)}) for q in queries if q.text}
    texts = list(dict.fromkeys(asked.values()))
    if not texts:
        return rows.sparkSession.createDataFrame([], "qid long, id long, rank int")
    of = [[i for i, t in asked.items() if t == text] for text in texts]
    slim = (rows if within is None else rows.where(within)).select("id", F.coalesce("created_at", F.lit("")).alias("created_at"), lower_ascii(F.coalesce(F.col(column), F.lit(""))).alias("text"))

    def scan(batches):
        machine = automaton(texts)
        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            for i, made, text in zip(*(c.to_pylist() for c in batch.columns)):
                for term in {t for _, t in machine.iter(text)}:
                    held[term].append((made, i))
                    if len(held[term]) >= 2 * k + 64:
                        held[term] = newest_first(held[term])[:k]
        out = [(q, i, made) for term, own in held.items() for made, i in newest_first(own)[:k] for q in of[term]]
        qid, ids, made = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(ids, pa.int64()), pa.array(made, pa.string())], names=["qid", "id", "created_at"])

    found = slim.mapInArrow(scan, "qid long, id long, created_at string")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("created_at"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "id", "rank")


def newest_first(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    return sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0], reverse=True)


def keywords_batch(rows: DataFrame, queries: list[Query], k: int, within: Column | None = None) -> DataFrame:
    """(qid, id, bm25, rank): BM25 lists; a query without any match in what it may read gets the newest rows that hold its text literally, unscored."""
    found = stored(matching_batch(rows, queries, k, within), "keywords")
    served = {r.qid for r in found.select("qid").distinct().collect()}  # queries of the batch
    rest = [q for q in queries if q.qid not in served and q.text.strip()]
    if not rest:
        return found
    return found.unionByName(containing_batch(rows, rest, k, within).withColumn("bm25", F.lit(None).cast("double")))
