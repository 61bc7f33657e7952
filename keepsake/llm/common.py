"""Helpers shared by the corpus operators.

Texts travel to Python as Arrow batches and are cut into small slices there, so
that a worker's memory follows the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shared import scratch as shared_path
from ..shared import stored

U64 = np.uint64
#: Rows and text bytes of a slice handed to a worker function at once.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def bucket(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null value falls into bucket 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0))


def integer_key(df: DataFrame, key: str) -> str:
    """The key column's type; keys of operators that compare or pack them are whole numbers."""
    kind = df.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"the key column {key} holds {kind.simpleString()}; whole numbers are needed")
    return kind.simpleString()


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most SLICE_ROWS rows and, but for single rows, about SLICE_BYTES bytes of column `text`."""
    for batch in batches:
        at, n = 0, batch.num_rows
        sizes = None if text is None else pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        while at < n:
            rows = min(SLICE_ROWS, n - at)
            if sizes is not None and rows > 1:
                rows = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + rows]), SLICE_BYTES, "right")))
            yield batch.slice(at, rows)
            at += rows


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator], schema: str, text: int | None = None, setup: Callable | None = None) -> DataFrame:
    """mapInArrow over slices. setup() runs once a task and its result is the second argument of fn."""

    def run(batches):
        state = () if setup is None else (setup(),)
        for piece in slices(batches, text):
            out = fn(piece, *state)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def rows_out(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def raw_texts(column: pa.Array) -> list:
    """Bytes of each text (None for null), without a detour over str."""
    return column.cast(pa.binary()).to_pylist()


# ---- word hashes -----------------------------------------------------------


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    f = xxhash.xxh3_64_intdigest if not seed else (lambda w: xxhash.xxh3_64_intdigest(w, seed))
    return np.fromiter(map(f, words), U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def rolling(h: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """One hash for each run of k consecutive entries: pieces whose lengths are powers of two are joined, so log2(k) passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, block, size, left = None, 0, h, 1, k
    while left:
        shift = U64(pow(base, size, 1 << 64))
        if left & 1:
            m = len(h) - (done + size) + 1
            out = block[:m] if out is None else out[:m] * shift + block[done : done + m]
            done += size
        left >>= 1
        if left:
            block = block[: len(block) - size] * shift + block[size:]
            size *= 2
    return mix(out[:n])


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole short sequence, its length included."""
    x = len(h)
    for v in h.tolist():
        x = (x * _BASE + v) & _MASK
    return int(mix(np.array([x], U64))[0])


def grouped(df: DataFrame, keys: list[str], fn: Callable, schema: str, partitions: int | None = None) -> DataFrame:
    """fn(rows) for every group of rows with equal keys, as columns of numpy arrays or lists by name.

    Partitions are sorted by the keys and read as a stream; unlike a grouped map
    there is no call from the JVM per group, which matters with very many small
    ones. The caller bounds the groups. fn yields record batches. `partitions`
    fixes their number where the rows' size says little of the work they cause.
    """
    names = df.columns

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                key = tuple(c[a] for c in columns)
                if key != now and held:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return (df.repartition(partitions, *keys) if partitions else df.repartition(*keys)).sortWithinPartitions(*keys).select(*names).mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for every id in edges (a, b): root is the smallest id that links lead to.

    Labels travel along edges and then jump to the label of their label, so the
    rounds follow the logarithm of the longest path. Every round ends in a table
    in the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), f"{name}-0")
    for step in range(1, 100):
        seen = both.join(label.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        down = label.join(seen, "id").select("id", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = label.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = stored(down.join(jump, "root", "left").select("id", "was", F.least("root", F.coalesce("next", "root")).alias("root")), f"{name}-{step}")
        if new.where("was <> root").isEmpty():
            return new.select("id", "root")
        label = new.select("id", "root")
    raise RuntimeError("links did not settle")
