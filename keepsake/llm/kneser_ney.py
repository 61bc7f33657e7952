"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Counting. A first pass counts words; those that make up more than a HOT-th of all
tokens are few, and are told to the tasks of the second, which counts the bigrams
(history, word) of its rows in numpy and sends one packed array a shard. A history
and all that follows it go to one shard, named by the history's leading hash bits;
bigrams of a hot history are dealt by their own hash instead. A shard is merged by one
task, whose memory follows the shard; the number of shards follows the input. The
merged shard knows, of each of its histories, how often it occurred and how many words
followed it once, twice and more often; these parts, of which a hot history has one
a shard, and the number of histories a word has had are sent on and added up.

Storing. Each shard is a file in the shared folder: sorted 64-bit hashes, then
their counts, each column in the least type that holds it. Names are new for each attempt, and the manifest names the files of
attempts that counted, so lost executors do no harm. The first pass leaves the words'
counts in such files too, which go when they are merged. Tasks write all of them without
Hadoop, whose local file system starts processes that share the executor's memory and
are counted with it. Workers map the files into memory; pages are shared between the
workers of a machine.

Scoring. Each slice of texts looks its distinct words and bigrams up in order.

    P(w | v) = max(c(v w) - D(c(v w)), 0) / c(v .) + g(v) P(w)
    P(w)     = max(n(. w) - D'(n(. w)), 0) / n(. .) + g' / (V + 1)

with discounts D1, D2, D3+ from the counts of counts of each order, and g the mass
that they free. Unknown words share the last term, so P sums to 1 over V words and
one unknown. Words and bigrams have 64 bits of hash of their own, whatever names their
shard; a clash merges two entries.

Tokens are words, A-Z lower-cased, and one end a text; a null text is only an end.
Repeated rows count and are scored as often as they occur. A very long text is scored
whole. Without training rows all scores are 0; empty tables give no rows; other columns are
ignored. Files lie below spark.checkpoint.dir and are needed as long as the model is.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_schema, grouped, map_slices, mix, rows_out, shared_path, slices, word_hashes

END, START = (int(x) for x in word_hashes([b" ", b"\n"]))
#: Training tokens for which a shard is made, bits of a hash that may name shards, and tokens a task counts at once.
SHARD_TOKENS, MOST_BITS, FLUSH = 600_000, 24, 4 << 20
#: Share of all tokens from which on a history's bigrams are dealt by themselves.
HOT = 4096
#: Entries worked on at once where that needs arrays of its own, and bytes of a batch of packed counts.
BLOCK, PACKED = 1 << 18, 4 << 20
_PARTS = "kind int, shard int, a binary, b binary, c binary, note string"
_PARTS_SCHEMA = arrow_schema(_PARTS)
#: Columns of a word's entry after its hash: count, histories, followers in all, followers seen once, twice, more often.
WORD_COLUMNS = 6


def sequences(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history hashes, token hashes, tokens a text) of the texts one after the other."""
    words, lengths = [], []
    for t in texts:
        own = (t or b"").lower().split()
        words += own
        lengths.append(len(own) + 1)
    ends = np.cumsum(lengths)
    w = np.full(int(ends[-1]) if len(ends) else 0, END, U64)
    inner = np.ones(len(w), bool)
    inner[ends - 1] = False
    w[inner] = word_hashes(words)
    lengths = np.array(lengths, np.int64)
    return histories(w, lengths), w, lengths


def histories(w: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash before each token."""
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.cumsum(lengths) - lengths] = START
    return v


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.empty(len(w), U64)
    for a in range(0, len(w), BLOCK):
        part = slice(a, a + BLOCK)
        out[part] = mix(v[part] * U64(0x9E3779B97F4A7C15) + w[part])
    return out


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    change = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=change[1:])
    return np.flatnonzero(change)


def split(shards: np.ndarray):
    """(shard, slice) of an array that is in order of its shards."""
    starts = run_starts(shards)
    for name, a, b in zip(shards[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(shards)]):
        yield name, slice(a, b)


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def leads(v: np.ndarray, keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The hashes that name the shards of bigrams; hot: sorted hashes of hot histories."""
    if not len(hot):
        return v
    out = v.copy()
    for a in range(0, len(v), BLOCK):
        part = slice(a, a + BLOCK)
        split_ = hot[np.minimum(np.searchsorted(hot, v[part]), len(hot) - 1)] == v[part]
        out[part][split_] = keys[part][split_]
    return out


def packed(rows):
    """Record batches of about PACKED bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row[2:] if x)
        if size >= PACKED:
            yield rows_out(_PARTS_SCHEMA, list(zip(*held)))
            held, size = [], 0
    if held:
        yield rows_out(_PARTS_SCHEMA, list(zip(*held)))


def count_words(batches, bits: int):
    """Packed counts of words (kind 1)."""
    held, size = [], 0

    def flush():
        words = np.concatenate(held)
        held.clear()
        words.sort()
        starts = run_starts(words)
        n = np.diff(starts, append=len(words)).astype(np.uint32)
        words = words[starts]
        for name, part in split(shard_of(words, bits)):
            yield 1, name, words[part].tobytes(), n[part].tobytes(), None, None

    for piece in slices(batches, 0):
        held.append(sequences(piece.column(0).to_pylist())[1])
        size += len(held[-1])
        if size >= FLUSH:
            yield from packed(flush())
            size = 0
    if size:
        yield from packed(flush())


def count(batches, bits: int, hot: np.ndarray):
    """Packed counts of bigrams (kind 2): histories, their lengths, words and counts."""
    held, size = [], 0

    def flush():  # all arrays are as long as the tokens held, so each goes as soon as it can
        w, lengths = (np.concatenate(x) for x in zip(*held))
        held.clear()
        keys = pair(histories(w, lengths), w)
        order = np.argsort(keys)
        keys = keys[order]
        starts = run_starts(keys)
        n = np.diff(starts, append=len(keys)).astype(np.uint32)
        keys, order = keys[starts], order[starts]
        del starts
        v = histories(w, lengths)[order]
        w = w[order]
        lead = leads(v, keys, hot)
        del keys
        order = np.argsort(lead)
        lead = lead[order]
        v = v[order]
        w = w[order]
        n = n[order]
        del order
        lead = shard_of(lead, bits)
        for name, part in split(lead):
            within = np.argsort(v[part])
            own = v[part][within]
            starts = run_starts(own)
            runs = np.diff(starts, append=len(own)).astype(np.uint64)
            yield 2, name, own[starts].tobytes() + runs.tobytes(), w[part][within].tobytes(), n[part][within].tobytes(), None

    for piece in slices(batches, 0):
        held.append(sequences(piece.column(0).to_pylist())[1:])
        size += len(held[-1][0])
        if size >= FLUSH:
            yield from packed(flush())
            size = 0
    if size:
        yield from packed(flush())


def write(folder: str, name: str, keys: np.ndarray, table: np.ndarray) -> dict:
    """Writes hashes and their columns of counts, each in the least type that holds it; returns what read needs."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    columns = [x.astype(np.min_scalar_type(x.max())) for x in table]
    with system.open_output_stream(f"{path}/{file}") as out:
        for x in (keys, *columns):
            out.write(x.data)
    return {"file": file, "rows": len(keys), "columns": [x.dtype.name for x in columns]}


def read(folder: str, note: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hashes, columns) of such a file."""
    system, path = fs.FileSystem.from_uri(f"{folder}/{note['file']}")
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:  # a store without files to map: the shard is read whole
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    out, at = [], 0
    for kind in (U64, *note["columns"]):
        end = at + note["rows"] * np.dtype(kind).itemsize
        out.append(raw[at:end].view(kind))
        at = end
    return out[0], out[1:]


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, place = np.unique(np.concatenate(keys), return_inverse=True)
    return names, np.bincount(place, np.concatenate(values).astype(np.float64), len(names)).astype(np.int64)


def merge_bigrams(rows: pa.Table, folder: str, bits: int):
    """Writes a shard of bigrams; sends on words' histories (kind 3), histories' statistics (kind 4) and the file (kind 5)."""
    v, w, n = [], [], []
    for a, b, c in zip(*(rows.column(x).to_pylist() for x in "abc")):
        own, runs = np.split(np.frombuffer(a, U64), 2)
        v.append(np.repeat(own, runs.astype(np.int64)))
        w.append(np.frombuffer(b, U64))
        n.append(np.frombuffer(c, np.uint32))
    v, w, n = np.concatenate(v), np.concatenate(w), np.concatenate(n)
    keys, first, place = np.unique(pair(v, w), return_index=True, return_inverse=True)
    n = np.bincount(place, n, len(keys)).astype(np.int64)
    v, w = v[first], w[first]
    shard = rows.column("shard")[0].as_py()
    note = write(folder, f"bigrams-{shard}", keys, n[None]) | {"kind": 2, "shard": shard, "of": np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()}
    out = [(5, shard, None, None, None, json.dumps(note))]
    words, histories = np.unique(w, return_counts=True)
    for name, part in split(shard_of(words, bits)):
        out.append((3, name, words[part].tobytes(), histories[part].astype(np.uint32).tobytes(), None, None))
    own, place = np.unique(v, return_inverse=True)
    stats = np.stack([np.bincount(place, n, len(own)), *(np.bincount(place, n == k, len(own)) for k in (1, 2)), np.bincount(place, n > 2, len(own))]).astype(np.int64)
    for name, part in split(shard_of(own, bits)):  # those of a hot history go to the history's shard
        out.append((4, name, own[part].tobytes(), np.ascontiguousarray(stats[:, part]).tobytes(), None, None))
    yield rows_out(_PARTS_SCHEMA, list(zip(*out)))


def merge_words(rows: pa.Table, folder: str):
    """Writes a shard of words with all their counts; passes the notes on files on. Rows of kind 1 name the file of the words' own counts."""
    kinds, a, b, notes = (rows.column(x).to_pylist() for x in ("kind", "a", "b", "note"))
    out = [x for k, x in zip(kinds, notes) if k == 5]
    for i, k in enumerate(kinds):
        if k == 1:
            a[i], (n,) = read(f"{folder}/counts", json.loads(notes[i]))
            b[i] = n.astype(np.int64)
    keys = [np.frombuffer(x, U64) for k, x in zip(kinds, a) if k in (1, 3, 4)]
    if keys:
        names = np.unique(np.concatenate(keys))
        table = np.zeros((WORD_COLUMNS, len(names)), np.int64)
        for k, x, y in zip(kinds, a, b):
            if k in (1, 3):
                table[0 if k == 1 else 1, np.searchsorted(names, np.frombuffer(x, U64))] += np.frombuffer(y, np.int64 if k == 1 else np.uint32).astype(np.int64)
            elif k == 4:
                at = np.searchsorted(names, np.frombuffer(x, U64))
                table[2:, at] += np.frombuffer(y, np.int64).reshape(4, -1)
        shard = rows.column("shard")[0].as_py()
        note = write(folder, f"words-{shard}", names, table) | {"kind": 1, "shard": shard, "of": np.bincount(np.minimum(table[1], 5), minlength=6)[1:5].tolist(), "many": int((table[1] > 2).sum()), "types": int((table[0] > 0).sum()), "tokens": int(table[0].sum()), "bigrams": int(table[1].sum())}
        out.append(json.dumps(note))
    yield rows_out(arrow_schema("note string"), [out])


def discounts(n: list[int]) -> np.ndarray:
    """D by count 0, 1, 2 and more; where counts of counts are missing, half a count is taken."""
    n1, n2, n3, n4 = n
    d = [0.0, 0.5, 0.75, 0.9]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            if a and 0.05 < (x := k - (k + 1) * y * b / a) < k:
                d[k] = x
    return np.array(d)


class Model:
    """A reader of the manifest's files."""

    def __init__(self, folder: str, bits: int, notes: list[dict], hot: np.ndarray):
        self.folder, self.bits, self.hot = folder, bits, hot
        self.files = {(x["kind"], x["shard"]): {k: x[k] for k in ("file", "rows", "columns")} for x in notes}
        words = [x for x in notes if x["kind"] == 1]
        self.tokens, self.types, self.bigrams = (sum(x[k] for x in words) for k in ("tokens", "types", "bigrams"))
        of = [[sum(x["of"][i] for x in notes if x["kind"] == k) for i in range(4)] for k in (1, 2)]
        self.low, self.high = map(discounts, of)
        many = sum(x["many"] for x in words)
        self.free = float(self.low[1:] @ np.array([of[0][0], of[0][1], many])) / max(1, self.bigrams) if self.bigrams else 1.0
        self.open = lru_cache(maxsize=4096)(self._open)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "open"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.open = lru_cache(maxsize=4096)(self._open)

    def _open(self, kind: int, shard: int):
        return read(self.folder, self.files[kind, shard])

    def look_up(self, kind: int, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Entries of distinct hashes in order of shard and hash; zeros where there is none."""
        out = np.zeros((1 if kind == 2 else WORD_COLUMNS, len(keys)), np.int64)
        for name, part in split(shards):
            if (kind, name) in self.files:
                known, table = self.open(kind, name)
                at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
                hit = known[at] == keys[part]
                to, at = np.arange(part.start, part.stop)[hit], at[hit]
                for row, column in zip(out, table):
                    row[to] = column[at]
        return out

    def scores(self, texts: list) -> tuple:
        """(tokens, known tokens, base score, score) of each text, as arrays."""
        v, w, lengths = sequences(texts)
        own = np.repeat(np.arange(len(lengths)), lengths)
        words, place = np.unique(np.concatenate([w, v]), return_inverse=True)
        table = self.look_up(1, words, shard_of(words, self.bits))
        here, before = place[: len(w)], place[len(w) :]
        c = table[0][here]
        base = np.log10((c + 1) / (self.tokens + self.types + 1))
        seen = table[1][here]
        lower = self.free / (self.types + 1)
        if self.bigrams:
            lower = lower + np.maximum(seen - self.low[np.minimum(seen, 3)], 0) / self.bigrams
        keys, first, place = np.unique(pair(v, w), return_index=True, return_inverse=True)
        shards = shard_of(leads(v[first], keys, self.hot), self.bits)
        order = np.argsort(shards, kind="stable")
        found = np.empty(len(keys), np.int64)
        found[order] = self.look_up(2, keys[order], shards[order])[0]
        n = found[place]
        total, once, twice, more = (table[k][before] for k in (2, 3, 4, 5))
        some = np.maximum(total, 1)
        free = (self.high[1] * once + self.high[2] * twice + self.high[3] * more) / some
        p = np.where(total > 0, np.maximum(n - self.high[np.minimum(n, 3)], 0) / some + free * lower, lower)
        add = lambda x: np.bincount(own, x, len(lengths))
        return lengths, add(c > 0).astype(np.int64), add(base), add(np.log10(p))


def train(docs: DataFrame, allowed: Column | None = None, text: str = "text") -> Model:
    """Counts all rows of docs (that are allowed) into a model in the shared folder."""
    spark = docs.sparkSession
    slim = docs.where(F.lit(True) if allowed is None else allowed).select(F.col(text).cast("binary").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = size // 6  # words of so many bytes, blanks among them; only sizes shards and says what is hot
    bits = min(MOST_BITS, max(0, (tokens // SHARD_TOKENS).bit_length()))
    folder = shared_path(spark, "kneser-ney")
    spec = "shard int, note string, hot binary"

    def merge_counts(rows: pa.Table):
        words, n = summed([np.frombuffer(x, U64) for x in rows.column("a").to_pylist()], [np.frombuffer(x, np.uint32) for x in rows.column("b").to_pylist()])
        shard = rows.column("shard")[0].as_py()
        yield rows_out(arrow_schema(spec), [[shard], [json.dumps(write(f"{folder}/counts", f"counts-{shard}", words, n[None]))], [words[n * HOT >= max(HOT, tokens)].tobytes()]])

    # one row a file, as below; words of a HOT-th of so many tokens each: some thousands at most. Every text has a beginning
    known = grouped(slim.mapInArrow(lambda batches: count_words(batches, bits), _PARTS), ["shard"], merge_counts, spec).collect()
    hot = np.unique(np.concatenate([np.frombuffer(bytes(r.hot), U64) for r in known] + [np.array([START], U64)]))
    words = spark.createDataFrame([(1, r.shard, None, None, None, r.note) for r in known], _PARTS)

    def merge(rows: pa.Table):
        yield from merge_bigrams(rows, folder, bits)

    def merge_all(rows: pa.Table):
        yield from merge_words(rows, folder)

    merged = grouped(slim.mapInArrow(lambda batches: count(batches, bits, hot), _PARTS), ["shard"], merge, _PARTS)
    # one row a file, so twice the number of shards
    notes = [json.loads(r.note) for r in grouped(merged.union(words), ["shard"], merge_all, "note string").collect()]
    if known:
        system, path = fs.FileSystem.from_uri(f"{folder}/counts")
        system.delete_dir(path)
    return Model(folder, bits, notes, hot)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row; log10 probabilities of the whole texts."""
    kind = docs.schema[key].dataType.simpleString()
    spec = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(spec)
    told = docs.sparkSession.sparkContext.broadcast(model)  # names of files only

    def run(batch: pa.RecordBatch):
        n, known, base, own = told.value.scores(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), *rows_out(schema, [n, known, np.full(len(n), told.value.tokens), base, own]).columns], names=["key", *schema.names])

    return map_slices(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), run, f"key {kind}, {spec}", text=1).withColumnRenamed("key", key)
