"""Quality classifier: a factorisation machine.

Inputs are the words of the text, hashed into SPACE slots (log counts, scaled to
length one), statistics of its structure cut into bins, and its length as
metadata. Each input i has a weight w_i and a vector v_i of RANK numbers, and

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

whose pairwise sum is 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): linear in
the number of inputs. It is fitted with AdaGrad on the driver, on at most
SAMPLE labelled rows (those with the smallest hash of the key, so the choice is
random but stable) of which WORDS_KEPT words each at most are learned from (those with
the smallest hash); both bound the driver's memory, and the model's size does not
depend on the data. Scoring covers all rows and all their words, one Arrow pass
without a shuffle.

Null texts count as empty and get a score like any other; a very long text has at most
SPACE inputs. Without labelled rows (an empty table of labels, or none allowed) the
score is 0.5 everywhere; an empty table of documents gives no rows. Repeated rows
are all scored; of repeated labels of one key the largest counts, and of rows
of one key one is learned from. Other columns are ignored, or kept as they are.
"""

from __future__ import annotations

from functools import lru_cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_slices, rows_out, word_hashes

#: Most labelled rows that the model is fitted on, and distinct words of each: 8192 x 2048 inputs of 8 bytes are 128 MB.
SAMPLE, WORDS_KEPT = 8192, 2048
SPACE = 1 << 16
RANK = 8
BINS = 16
EPOCHS = 8
STATS = 12


def cases(text: str, raw: bytes) -> tuple[int, int]:
    """Upper- and lower-case letters of any script."""
    if len(raw) == len(text):
        letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
        return int(letters[65:91].sum()), int(letters[97:123].sum())
    kinds = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return int((kinds == 2).sum()), int((kinds == 1).sum())


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point 2 if it is upper case, 1 if it is lower case, else 0."""
    return np.fromiter((2 if (c := chr(i)).isupper() else int(c.islower()) for i in range(0x110000)), np.int8, 0x110000)


def statistics(text: str, words: list[bytes]) -> list[float]:
    """Structure of the text, each between 0 and 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    raw = text.encode()
    upper, lower = cases(text, raw)
    return [
        min(1.0, log1p(len(words)) / 12),
        min(1.0, log1p(len(text)) / 15),
        min(1.0, len(raw) / n / 20),
        min(1.0, sum(map(text.count, "#*$%&|<>")) / chars * 4),
        min(1.0, sum(map(text.count, "!?")) / chars * 8),
        upper / max(1, upper + lower),
        min(1.0, sum(map(text.count, "0123456789")) / chars * 4),
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        sum(map(text.count, ".,;:")) / chars * 4 if chars > 1 else 0.0,
        min(1.0, len(lines) / n),
        (len(raw) - len(text)) / chars / 2,
    ]


def inputs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of the inputs that are not zero; sparse and in order of the index."""
    words = text.encode().split()
    slots, counts = np.unique(word_hashes([w.lower() for w in words]) % SPACE, return_counts=True)
    values = 1 + np.log(counts)
    values = values / max(1e-9, float(np.sqrt((values**2).sum())))
    stats = statistics(text, words)
    bins = [SPACE + s * BINS + min(BINS - 1, int(x * BINS)) for s, x in enumerate(stats)]
    return np.concatenate([slots.astype(np.int32), np.array(bins, np.int32)]), np.concatenate([values, np.full(STATS, 0.5)]).astype(np.float32)


def learned(index: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs that a row is learned from: its statistics and at most WORDS_KEPT words, those with the smallest hash of the slot."""
    words = index < SPACE
    if int(words.sum()) <= WORDS_KEPT:
        return index, x
    order = np.argsort((index[words].astype(np.uint32) * np.uint32(2654435769)) & np.uint32(0xFFFFFFFF), kind="stable")
    keep = np.sort(np.concatenate([np.flatnonzero(words)[order[:WORDS_KEPT]], np.flatnonzero(~words)]))
    return index[keep], x[keep]


class Machine:
    def __init__(self, size: int = SPACE + STATS * BINS, rank: int = RANK):
        rng = np.random.default_rng(7)
        self.bias, self.w = np.float32(0), np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.05, (size, rank)).astype(np.float32)

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.v[index]
        s = x @ v
        return float(self.bias + x @ self.w[index] + 0.5 * (s @ s - (x * x) @ (v * v).sum(1)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, batch: int = 64) -> Machine:
        rng = np.random.default_rng(11)
        if not rows:
            return self
        mean = np.clip(np.mean([y for *_, y in rows]), 0.02, 0.98)
        self.bias = np.float32(np.log(mean / (1 - mean)))
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = [rows[i] for i in order[at : at + batch]]
                index, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
                starts = np.cumsum([0, *(len(p[0]) for p in part[:-1])])
                own = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
                v, xc = self.v[index], x[:, None]
                s = np.add.reduceat(v * xc, starts)
                pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v * xc * xc).sum(1), starts))
                margin = self.bias + np.add.reduceat(x * self.w[index], starts) + pairs
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.array([p[2] for p in part])).astype(np.float32)
                slots, place = np.unique(index, return_inverse=True)
                each = error[own] * x
                dw = np.bincount(place, each, len(slots)).astype(np.float32) + decay * self.w[slots]
                each_v = each[:, None] * (s[own] - v * xc)
                dv = np.stack([np.bincount(place, each_v[:, f], len(slots)) for f in range(v.shape[1])], 1).astype(np.float32) + decay * self.v[slots]
                db = float(error.sum())
                gw[slots] += dw * dw
                gv[slots] += dv * dv
                gb += db * db
                self.w[slots] -= rate * dw / np.sqrt(gw[slots])
                self.v[slots] -= 0.5 * rate * dv / np.sqrt(gv[slots])
                self.bias -= np.float32(rate * db / np.sqrt(gb))
        return self


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Machine:
    """Fits a machine on labelled rows of docs. `allowed` (a column over the key) says which labels may be learned from."""
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.lit(True) if allowed is None else allowed))
    picked = picked.groupBy(F.col(key).alias("key")).agg(F.max(label).alias("y")).orderBy(F.xxhash64("key"), "key").limit(sample)
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = arrow_schema("y long, idx binary, val binary")

    def run(batch: pa.RecordBatch):
        found = [learned(*inputs(t)) for t in batch.column("text").to_pylist()]
        return rows_out(schema, [batch.column("y").cast(pa.int64()), [i.tobytes() for i, _ in found], [v.tobytes() for _, v in found]])

    # `picked` holds at most `sample` slim rows, which bounds the broadcast
    chosen = map_slices(slim.join(F.broadcast(picked), "key").select("key", "text", "y").dropDuplicates(["key"]), run, "y long, idx binary, val binary", text=1)
    rows = [(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32), int(r.y)) for r in sorted(chosen.toLocalIterator(), key=lambda r: (r.idx, r.val, r.y))]
    return Machine().fit(rows)


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, score) for every row; with keep, docs with a column `score` appended."""
    told = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))  # of a fixed size
    frame = docs if keep else docs.select(key, text)
    at = frame.columns.index(text)
    names = [f"c{i}" for i in range(len(frame.columns))]

    def setup():
        m = Machine.__new__(Machine)
        m.bias, m.w, m.v = told.value
        return m

    def run(batch: pa.RecordBatch, m: Machine):
        margins = np.array([m.margin(*inputs(t or "")) for t in batch.column(at).to_pylist()], np.float64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))), pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, frame.schema)) + ", score double"
    out = map_slices(frame.toDF(*names), run, schema, text=at, setup=setup).toDF(*frame.columns, "score")
    return out if keep else out.select(key, "score")
