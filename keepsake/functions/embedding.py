"""Embeddings: a deterministic bag of words for tests and offline use, and a hook for any other function of texts."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 64
Embed = Callable[[list[str]], list[list[float]]]


def bag_of_words(texts: list[str], dimension: int = DIMENSION) -> list[list[float]]:
    """Unit vectors; texts that share words have a large cosine."""
    out = []
    for t in texts:
        v = np.zeros(dimension)
        for word in t.lower().split():
            v += np.random.default_rng(int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")).standard_normal(dimension)
        n = np.linalg.norm(v)
        out.append((v / n if n else np.eye(dimension)[0]).astype(np.float32).tolist())
    return out


class Cached:
    """An embedding function with a memory of its last texts: at most `most` of them, each for `seconds`.

    Every Python worker has its own; texts that aren't known go to the function in one call.
    """

    def __init__(self, embed: Embed, most: int = 1024, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.embed, self.most, self.seconds, self.clock = embed, most, seconds, clock
        self.kept: OrderedDict[str, tuple[float, list[float]]] = OrderedDict()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        now = self.clock()
        known = {t: self.kept[t][1] for t in texts if t in self.kept and now - self.kept[t][0] < self.seconds}
        new = [t for t in dict.fromkeys(texts) if t not in known]
        known |= dict(zip(new, self.embed(new))) if new else {}
        for t in dict.fromkeys(texts):
            self.kept[t] = (now if t in new else self.kept[t][0], known[t])
            self.kept.move_to_end(t)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return [known[t] for t in texts]


def embedded(rows: DataFrame, text: Column, embed: Embed = bag_of_words, column: str = "embedding") -> DataFrame:
    """rows with a vector a text, in Arrow batches; null texts have none. The function runs on the executors."""

    @F.pandas_udf("array<float>")
    def apply(texts: pd.Series) -> pd.Series:
        given = texts.tolist()
        made = iter(embed([t for t in given if t is not None]))
        return pd.Series([None if t is None else next(made) for t in given], dtype=object)

    return rows.withColumn(column, apply(text))
