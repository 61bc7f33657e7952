"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
trigram's vector binds three letter vectors by multiplication after rotating them
by two, one and no places, so that order counts. A text is the sum of the
vectors of its trigrams; a language is the sum over its texts. A text belongs to
the language whose vector has the largest cosine with its own.

Learning is one pass over the labelled rows: a task bundles the trigram counts of
each language and sends one packed vector a language, and the sums are stored as
prototypes in the shared folder, in blocks of BLOCK languages. Workers read them from
there, one block at a time, so neither the driver nor a worker holds more than a
block, however many languages there are. What a task has gathered of texts is
bounded in bytes.

Texts that are null, empty or without a letter give `und` with score 0 and teach
nothing; so do all texts where nothing was learned, and an empty table gives no rows.
Rows without a language teach nothing. Very long texts are worked on trigram by
distinct trigram. Of equal cosines the first language by name wins. Repeated rows
count and are answered as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, grouped, map_slices, rows_out, shared_path, slices, stored

DIMENSION = 512
#: Trigram vectors that a worker keeps.
KEPT = 24_000
#: Distinct trigrams that a task gathers before it bundles them, and languages of a block of prototypes.
GATHERED, BLOCK = 1 << 20, 1024
UNKNOWN = "und"
_SHIFT = np.uint64(21)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint32)
    known = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(known, points, 0).astype(np.uint32)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the letter trigrams; runs of other characters count as one blank."""
    points = letters()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    if not points.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.concatenate([[0], points, [0]])
    stream = points[(points != 0) | np.concatenate([[True], points[:-1] != 0])].astype(np.uint64)
    return np.unique((stream[:-2] << (_SHIFT + _SHIFT)) | (stream[1:-1] << _SHIFT) | stream[2:], return_counts=True)


class Space:
    """Trigram vectors, made when first asked for and kept up to a bound."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension, self.letter, self.place = dimension, {}, {}
        self.rows = np.empty((KEPT, dimension), np.float32)

    def letter_vector(self, point: int) -> np.ndarray:
        if point not in self.letter:
            self.letter[point] = np.random.default_rng([point, 2021]).integers(0, 2, self.dimension).astype(np.float32) * 2 - 1
        return self.letter[point]

    def vector(self, code: int) -> np.ndarray:
        a, b, c = (self.letter_vector(code >> s & 0x1FFFFF) for s in (42, 21, 0))
        return np.roll(a, 2) * np.roll(b, 1) * c

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimension, np.float32)
        for at in range(0, len(codes), KEPT // 2):
            part = codes[at : at + KEPT // 2].tolist()
            place = self.place
            if len(place) + len(part) > KEPT and len(place) + sum(c not in place for c in part) > KEPT:
                place.clear()
            for c in part:
                if c not in place:
                    self.rows[len(place)] = self.vector(c)
                    place[c] = len(place)
            total += counts[at : at + KEPT // 2].astype(np.float32) @ self.rows[[place[c] for c in part]]
        return total


@lru_cache(maxsize=1)
def space(dimension: int = DIMENSION) -> Space:
    return Space(dimension)


class Profiles:
    """Where the prototypes lie: files of sorted names and of unit vectors, in order of the names."""

    def __init__(self, folder: str, names: list[str], blocks: list[str]):
        self.folder, self.names, self.blocks = folder, names, blocks

    def block(self, at: int) -> tuple[list[str], np.ndarray]:
        system, path = fs.FileSystem.from_uri(f"{self.folder}/{self.blocks[at]}")
        with system.open_input_file(path) as f:
            rows = pa.ipc.open_stream(f.read()).read_all()
        return rows.column(0).to_pylist(), np.frombuffer(b"".join(rows.column(1).to_pylist()), np.float32).reshape(rows.num_rows, -1)


def profiles(docs: DataFrame, allowed: Column | None = None, text: str = "text", lang: str = "lang") -> Profiles:
    """Language prototypes of unit length, from all rows of docs that have a language (and are allowed)."""
    slim = docs.where(F.col(lang).isNotNull() & (F.lit(True) if allowed is None else allowed)).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    folder = shared_path(docs.sparkSession, "languages")
    schema = arrow_schema("lang string, v binary")

    def run(batches):
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def flush():
            out = []
            for name, (codes, counts) in held.items():
                own, place = np.unique(np.concatenate(codes), return_inverse=True)
                out.append((name, space().bundle(own, np.bincount(place, np.concatenate(counts))).astype(np.float64).tobytes()))
            held.clear()
            return rows_out(schema, list(zip(*out)))

        for piece in slices(batches, 0):
            for t, name in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                codes, counts = trigrams(t or "")
                if len(codes):
                    own = held.setdefault(name, ([], []))
                    own[0].append(codes)
                    own[1].append(counts)
                    size += len(codes)
            if size >= GATHERED:
                yield flush()
                size = 0
        if held:
            yield flush()

    def add(rows: pa.Table):
        total = np.sum([np.frombuffer(x, np.float64) for x in rows.column("v").to_pylist()], axis=0)
        yield rows_out(schema, [[rows.column("lang")[0].as_py()], [(total / max(1e-12, float(np.linalg.norm(total)))).astype(np.float32).tobytes()]])

    def write(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(held)
            name = uuid.uuid4().hex
            system, path = fs.FileSystem.from_uri(folder)
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_stream(out, rows.schema) as writer:
                writer.write_table(rows)
            first, last = rows.column(0)[0].as_py(), rows.column(0)[rows.num_rows - 1].as_py()
            return rows_out(arrow_schema("file string, first string, last string"), [[name], [first], [last]])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    # a task's vectors of one language are summed in the next, so a frequent language sends a row a flush
    sums = grouped(slim.mapInArrow(run, "lang string, v binary"), ["lang"], add, "lang string, v binary")
    blocks = stored(sums.orderBy("lang").mapInArrow(write, "file string, first string, last string"), "language-files").orderBy("first").collect()  # a row a block
    return Profiles(folder, [r.first for r in blocks], [r.file for r in blocks])


def identify(docs: DataFrame, known: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row; the score is the cosine with the winner, at least 0. Ties go to the first name."""
    kind = docs.schema[key].dataType.simpleString()
    schema = arrow_schema("lang_pred string, score double")

    def setup():
        return {0: known.block(0)} if len(known.blocks) == 1 else {}

    def run(batch: pa.RecordBatch, held: dict):
        texts = batch.column(1).to_pylist()
        vectors: list = []
        for t in texts:
            codes, counts = trigrams(t or "")
            v = space().bundle(codes, counts) if len(codes) and known.blocks else None
            vectors.append(None if v is None else v / max(1e-12, float(np.linalg.norm(v))))
        asked = [i for i, v in enumerate(vectors) if v is not None]
        out = [(UNKNOWN, 0.0)] * len(texts)
        best = np.full(len(asked), -2.0, np.float32)
        if asked:
            matrix = np.stack([vectors[i] for i in asked])
            for at in range(len(known.blocks)):
                names, own = held[at] if at in held else known.block(at)
                cosines = np.round(matrix @ own.T, 6)
                top = cosines.argmax(axis=1)  # the first of equals; blocks are in order of names
                here = cosines[np.arange(len(asked)), top]
                for j in np.flatnonzero(here > best).tolist():
                    best[j] = here[j]
                    out[asked[j]] = (names[int(top[j])], min(1.0, max(0.0, float(here[j]))))
        return pa.RecordBatch.from_arrays([batch.column(0), *rows_out(schema, list(zip(*out)) or [[], []]).columns], names=["key", *schema.names])

    return map_slices(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, lang_pred string, score double", text=1, setup=setup).withColumnRenamed("key", key)
