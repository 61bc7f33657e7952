"""Removal of word passages that documents with smaller keys hold, too.

A window is WINDOW consecutive words. Each word goes that lies in a window whose
word sequence also starts in a document with a smaller key; windows are judged on
the input. Exact, in two passes around a count-min sketch:

0. Texts are written once, in segments of bounded size, to files in the shared
   folder. From here on segments are named by file and place, and texts are read
   where they are needed; none is shuffled.
1. Sketch. The cell of a window is a hash of its minimiser, the smallest hash of the
   GRAM-word runs in it. Each segment counts, for two rows of cells, the documents
   that hold a window of the cell: its partition sketch. Partition sketches are
   merged shard by shard, and each segment is told which of its cells two
   documents or more hit. Equal windows have equal minimisers and so equal cells;
   hence a cell's count is at least the number of documents that hold any one window
   of the cell, and a window that two documents share is estimated repeated always.
   One that isn't shared passes when its minimiser is or both its cells clash.
2. Grouping. Windows estimated repeated are grouped exactly, by 96 bits of hash. A
   segment sends each distinct window once, with the smallest key that holds it
   there, to the window's shard, and is told for each, by one bit, whether
   another segment has a smaller one. If so, all its documents lose the window; else all
   but the one with the smallest key. Words covered by lost windows go.

A window or minimiser that a third of all documents holds travels once a segment, so
no shard has more entries of one window than there are segments. Shards follow
the size of the input; tasks hold a shard or a segment, whatever the input.

Null texts have no words. Rows with a null key lose nothing and are nobody's
source. Repeated rows don't remove each other. Keys are whole numbers, unique but
for repeated rows. Texts of fewer than WINDOW words lose nothing; a very long one is
a segment of its own. Tables may be empty. Files lie below spark.checkpoint.dir and
may be removed when the result has been written.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_schema, grouped, integer_key, mix, raw_texts, rolling, rows_out, shared_path, slices, stored, word_hashes

WINDOW, GRAM = 50, 25
#: Text bytes of a segment.
SEGMENT = 4 << 20
#: Cells of a sketch's row for each minimiser, and bits of a shard of cells.
LOAD, SHARD_BITS = 8, 24
#: Windows of the input for each shard of windows.
SHARD_WINDOWS = 1_000_000
#: Segments that a task works on one after the other, and most tasks of a stage.
TASK_SEGMENTS, MOST_TASKS = 4, 50_000
_WINDOW_BASE = 0xD6E8FEB86659FD93
_PARTS = "kind int, shard long, segment string, a binary, b binary, c binary, d binary"
_SCHEMA = arrow_schema(_PARTS)
#: Kinds of rows: a segment, its cells of either row (answers have the same kinds), its windows.
SELF, WINDOWS = 9, 5


def minimisers(h: np.ndarray) -> np.ndarray:
    """For each window the smallest hash of the runs in it."""
    grams = rolling(h, GRAM)
    wide = WINDOW - GRAM + 1
    if len(grams) < wide:
        return np.zeros(0, U64)
    least, size = grams, 1
    while size * 2 <= wide:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    rest = wide - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def split(shards: np.ndarray):
    """(shard, slice) of an array in order of its shards."""
    names, starts = np.unique(shards, return_index=True)
    for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(shards)]):
        yield name, slice(a, b)


def cells(m: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of minimisers in the sketch's two rows. Minimisers are small numbers, so they are spread anew."""
    x = mix(m + U64(1))
    return x & U64((1 << bits) - 1), x >> U64(64 - bits)


def own_minimisers(hashes: list[np.ndarray]) -> np.ndarray:
    """The distinct minimisers of each document, one document after the other."""
    return np.concatenate([np.unique(minimisers(h)) for h in hashes if len(h) >= WINDOW] or [np.zeros(0, U64)])


def sketch(m: np.ndarray, bits: int):
    """(row, shard, cells, flags of those hit more than once) of a segment's sketch, in order."""
    for row, own in enumerate(cells(m, bits)):
        own, n = np.unique(own, return_counts=True)
        for shard, part in split((own >> U64(SHARD_BITS)).astype(np.int64)):
            yield row, shard, (own[part] & U64((1 << SHARD_BITS) - 1)).astype(np.uint32), n[part] > 1


def packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


# ---- segments -----------------------------------------------------------------


def write_segments(batches, folder: str, bits: int, most: int):
    """Writes texts in segments to one file a task; yields a row for each segment and its sketch."""
    file, out = uuid.uuid4().hex, None
    schema = arrow_schema("key long, text binary")

    def flush(held: list[pa.RecordBatch]):
        nonlocal out
        if out is None:
            system, path = fs.FileSystem.from_uri(folder)
            system.create_dir(path, recursive=True)
            out = system.open_output_stream(f"{path}/{file}")
        start, sink = out.tell(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for piece in held:
                writer.write_batch(piece)
        data = sink.getvalue()
        out.write(data)
        name = f"{file}:{start}:{len(data)}"
        hashes = [word_hashes((t or b"").split()) for piece in held for k, t in zip(piece.column(0).to_pylist(), raw_texts(piece.column(1))) if k is not None]
        rows = [(SELF, None, name, None, None, None, None)]
        rows += [(row, shard, name, own.tobytes(), packed(more), None, None) for row, shard, own, more in sketch(own_minimisers(hashes), bits)]
        return rows_out(_SCHEMA, list(zip(*rows)))

    held, size = [], 0
    for piece in slices(batches, 1):
        piece = pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], schema=schema)
        held.append(piece)
        size += 64 * piece.num_rows + (piece.column(1).nbytes if piece.num_rows else 0)
        if size >= most:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)
    if out is not None:
        out.close()


def read_segment(folder: str, name: str) -> tuple[list, list]:
    """Keys and texts of a segment."""
    file, start, length = name.split(":")
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{file}") as f:
        rows = pa.ipc.open_stream(f.read_at(int(length), int(start))).read_all()
    return rows.column(0).to_pylist(), rows.column(1).to_pylist()


class Windows:
    """The windows of a segment that are estimated repeated, in order of their hashes.

    first, second, key: hash and smallest key of each distinct one. at, doc, start:
    for each place of a window its distinct one, its document and its first word.
    """

    def __init__(self, keys: list, words: list[list[bytes]], answers: dict[tuple[int, int], bytes], bits: int):
        hashes = [word_hashes(w) if k is not None and len(w) >= WINDOW else np.zeros(0, U64) for k, w in zip(keys, words)]
        each = [minimisers(h) for h in hashes]
        m = np.unique(np.concatenate([np.zeros(0, U64), *each]))
        hit = np.ones(len(m), bool)
        for row, own in enumerate(cells(m, bits)):
            distinct = np.unique(own)
            flags = np.zeros(len(distinct), bool)
            for shard, part in split((distinct >> U64(SHARD_BITS)).astype(np.int64)):
                if (row, shard) in answers:
                    flags[part] = unpacked(answers[row, shard], part.stop - part.start)
            hit &= flags[np.searchsorted(distinct, own)]
        wanted = m[hit]
        first, second, doc, start = [], [], [], []
        for i, (h, own) in enumerate(zip(hashes, each)):
            if len(own) and len(wanted):
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own)
                if len(at):
                    first.append(rolling(h, WINDOW)[at])
                    second.append((rolling(h, WINDOW, _WINDOW_BASE)[at] >> U64(32)).astype(np.uint32))
                    doc.append(np.full(len(at), i, np.int32))
                    start.append(at.astype(np.int32))
        first, second, doc, start = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((first, U64), (second, np.uint32), (doc, np.int32), (start, np.int32)))
        order = np.lexsort((second, first))
        first, second, self.doc, self.start = first[order], second[order], doc[order], start[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.at = np.cumsum(new) - 1
        self.first, self.second = first[new], second[new]
        self.keys = np.array([k if k is not None else 0 for k in keys], np.int64)
        self.key = np.minimum.reduceat(self.keys[self.doc], np.flatnonzero(new)) if len(first) else np.zeros(0, np.int64)

    def shards(self, bits: int):
        """(shard, slice) of the distinct windows."""
        yield from split((self.first >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.first), np.int64))

    def lost(self, smaller: np.ndarray) -> dict[int, np.ndarray]:
        """By document the starts of the windows it loses; smaller: distinct windows that a smaller key holds elsewhere."""
        gone = smaller[self.at] | (self.keys[self.doc] > self.key[self.at])
        doc, start = self.doc[gone], self.start[gone]
        order = np.argsort(doc, kind="stable")
        return {i: start[order[part]] for i, part in split(doc[order])}


def cut(words: list[bytes], starts: np.ndarray) -> tuple[int, bytes]:
    """Number of words within windows at the starts, and the other words joined by one space."""
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.unique(starts).astype(np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist()) if not c])


# ---- the plan -----------------------------------------------------------------


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(key, n_words, n_removed, kept, words_sha256) for every row of docs.

    kept: the words that stay, joined by one space, where words went, else null
    (the text stays as it is); words_sha256: digest of all words so joined.
    """
    kind = integer_key(docs, key)
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # words of six bytes and more on average, and two minimisers for so many windows as have room in one; both only size shards
    bits = max(10, (LOAD * size // 6 * 2 // (WINDOW - GRAM + 2)).bit_length())
    window_bits = max(0, (size // 6 // SHARD_WINDOWS).bit_length())
    folder = shared_path(docs.sparkSession, "substring")
    parts = stored(slim.mapInArrow(lambda batches: write_segments(batches, folder, bits, segment), _PARTS), "substring-sketches")
    segments = parts.where(F.col("kind") == SELF)
    many = segments.count()
    tasks = min(MOST_TASKS, max(many // TASK_SEGMENTS, min(many, 64), 1))

    def merge(rows: pa.Table):
        total = np.zeros(1 << min(bits, SHARD_BITS), np.uint8)
        own = [np.frombuffer(x, np.uint32) for x in rows.column("a").to_pylist()]
        for at, more in zip(own, rows.column("b").to_pylist()):
            total[at] = np.minimum(total[at] + 1 + unpacked(more, len(at)), 2)
        yield rows_out(_SCHEMA, [rows.column("kind").combine_chunks(), rows.column("shard").combine_chunks(), rows.column("segment").combine_chunks(), [packed(total[at] > 1) for at in own], *[[None] * len(own)] * 3])

    answers = stored(grouped(parts.where(F.col("kind") != SELF), ["kind", "shard"], merge, _PARTS), "substring-cells")
    told = segments.union(answers)

    def opened(rows: pa.Table):
        kinds, shards, data = (rows.column(c).to_pylist() for c in ("kind", "shard", "a"))
        name = rows.column("segment")[0].as_py()
        keys, texts = read_segment(folder, name)
        words = [(t or b"").split() for t in texts]
        return name, keys, words, Windows(keys, words, {(k, s): x for k, s, x in zip(kinds, shards, data) if k < WINDOWS}, bits), {s: x for k, s, x in zip(kinds, shards, data) if k == WINDOWS}

    def send(rows: pa.Table):
        name, _, _, own, _ = opened(rows)
        for shard, part in own.shards(window_bits):
            names, place = np.unique(own.key[part], return_inverse=True)
            place = place.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
            yield rows_out(_SCHEMA, [[WINDOWS], [shard], [name], [own.first[part].tobytes()], [own.second[part].tobytes()], [names.tobytes()], [place.tobytes()]])

    def settle(rows: pa.Table):
        first, second, keys, ends = [], [], [], [0]
        for a, b, c, d in zip(*(rows.column(x).to_pylist() for x in "abcd")):
            names = np.frombuffer(c, np.int64)
            first.append(np.frombuffer(a, U64))
            second.append(np.frombuffer(b, np.uint32))
            keys.append(names[np.frombuffer(d, np.uint16 if len(names) <= 1 << 16 else np.uint32)])
            ends.append(ends[-1] + len(first[-1]))
        first, second, keys = map(np.concatenate, (first, second, keys))
        order = np.lexsort((second, first))
        new = np.ones(len(order), bool)
        a, b = first[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = np.minimum.reduceat(keys[order], np.flatnonzero(new))
        smaller = np.zeros(len(order), bool)
        smaller[order] = least[np.cumsum(new) - 1] < keys[order]
        yield rows_out(_SCHEMA, [rows.column("kind").combine_chunks(), rows.column("shard").combine_chunks(), rows.column("segment").combine_chunks(), [packed(smaller[x:y]) for x, y in zip(ends, ends[1:])], *[[None] * (len(ends) - 1)] * 3])

    settled = grouped(grouped(told, ["segment"], send, _PARTS, tasks), ["shard"], settle, _PARTS)
    spec = "key long, n_words long, n_removed long, kept string, words_sha256 string"
    schema = arrow_schema(spec)

    def finish(rows: pa.Table):
        _, keys, words, own, bits_of = opened(rows)
        smaller = np.zeros(len(own.first), bool)
        for shard, part in own.shards(window_bits):
            smaller[part] = unpacked(bits_of[shard], part.stop - part.start)
        lost = own.lost(smaller)
        out = []
        for i, (k, w) in enumerate(zip(keys, words)):
            n, kept = cut(w, lost[i]) if i in lost else (0, None)
            out.append((k, len(w), n, None if kept is None else kept.decode(), hashlib.sha256(b" ".join(w)).hexdigest()))
        if out:
            yield rows_out(schema, list(zip(*out)))

    found = grouped(told.union(settled), ["segment"], finish, spec, tasks)
    return found.select(F.col("key").cast(kind).alias(key), "n_words", "n_removed", "kept", "words_sha256")
