"""Benchmark decontamination by SimHash windows.

Words are lower-cased runs without ASCII punctuation. An item of n words is
compared with the windows of n words of every document (documents shorter than
that are one window). Both are weighted sets of five-word shingles: a shingle
weighs the more the fewer items hold it, and counts as often as it occurs.

1. Items get a 64-bit SimHash each, from whole-number weights, so that sums are
   exact and ties break alike in items and windows. An index cuts fingerprints into
   eight blocks of a byte; for each block and byte it lists the items whose byte
   differs in at most two bits. A fingerprint within 23 bits of an item's differs
   from it in at most two bits in some block, so looking up the eight bytes of a
   window's fingerprint finds all items within that radius.
2. Windows are fingerprinted where shingles that some item holds make up 0.8 of
   their weight; others are less similar than that to all items.
3. Candidates are verified with the exact weighted Jaccard similarity, 0.8 or more.

Each document is worked on alone: one Arrow pass, no shuffle. The items travel to
the workers in blocks of at most BLOCK_BYTES of text, one pass a block; an index is a
few arrays of about seven times that. In how many items a shingle occurs is counted
over the whole benchmark before, so blocks change no similarity. A benchmark is a
query set of bounded size, and the documents may be of any number.

Null and empty texts and items match nothing, and empty tables give no rows. An item
of fewer than five words is one shingle and is found in documents of just these words
only: so few words in a row say nothing of a longer text. A very long text is looked at
whole, some thousands of windows at a time. Of windows of equal similarity the first
counts. Repeated rows are all returned. Items of equal text all match. Item keys are
whole numbers; other columns are ignored, or kept as they are.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_schema, integer_key, map_slices, mix, rolling, rows_out, sequence_hash, stored, word_hashes

WORDS, SIMILARITY, RADIUS = 5, 0.8, 23
#: Bits that a byte may differ in: eight blocks of one bit more exceed the radius.
BYTE_BITS = RADIUS // 8
#: Units of a weight of 1 where fingerprints are summed; sums of many words stay exact.
UNITS = 1 << 20
BLOCK_BYTES = 8 << 20
#: Pairs of windows and items that are checked at once.
PAIRS = 2 << 20
SCHEMA = "item_id long, start long, n_words long, similarity double"
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_BITS = np.arange(64, dtype=U64)
_NEAR = np.array([[b for b in range(256) if (a ^ b).bit_count() <= BYTE_BITS] for a in range(256)])


def word_list(text: str) -> list[bytes]:
    return text.lower().encode().translate(_PUNCTUATION).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes in text order, repeats included."""
    h = word_hashes(words)
    return rolling(h, WORDS) if len(h) >= WORDS else np.array([sequence_hash(h)] if len(h) else [], U64)


class Index:
    """Items with their fingerprints and the block index, in arrays. df and count: of the whole benchmark, where items are a block of it."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int] | None = None, count: int | None = None):
        words = [(i, word_list(text)) for i, text in items]
        words = [(i, w) for i, w in words if w]
        own = [shingles(w) for _, w in words]
        self.ids, self.lengths = [i for i, _ in words], [len(w) for _, w in words]
        sets = [np.unique(s, return_counts=True) for s in own]
        self.ends = np.cumsum([0, *(len(s) for s, _ in sets)])
        self.shingle = np.concatenate([s for s, _ in sets] or [np.zeros(0, U64)])
        self.times = np.concatenate([n for _, n in sets] or [np.zeros(0, np.int64)])
        self.count = len(self.ids) if count is None else count
        self.known, held = np.unique(self.shingle, return_counts=True)
        if df is not None:
            held = np.array([df[x] for x in self.known.tolist()], np.int64)
        self.weights = 1 + np.log((1 + self.count) / (1 + held))
        self.rare = self.weight(0)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & U64((1 << 20) - 1)).astype(np.int64)] = True
        self.each = self.weigh(self.shingle) * self.times if len(self.shingle) else np.zeros(0)
        self.total = np.add.reduceat(self.each, self.ends[:-1]) if len(self.ids) else np.zeros(0)
        self.groups: dict[int, tuple] = {}
        by_length = defaultdict(list)
        for at, n in enumerate(self.lengths):
            by_length[n].append(at)
        for n, members in by_length.items():
            prints = np.array([self.fingerprint(own[m]) for m in members], U64)
            # places of items by block and byte, one list after the other
            keys = np.concatenate([256 * block + _NEAR[(prints >> U64(8 * block) & U64(255)).astype(np.int64)] for block in range(8)], axis=1)
            order = np.argsort(keys, axis=None, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(keys.ravel(), minlength=2048))])
            self.groups[n] = (members, prints, (order // keys.shape[1]).astype(np.int32), ends)

    def weight(self, df: int) -> float:
        return 1 + log((1 + self.count) / (1 + df))

    def weigh(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return np.where(self.known[at] == s, self.weights[at], self.rare)

    def signs(self, s: np.ndarray) -> np.ndarray:
        """What each shingle adds to each bit's sum."""
        units = np.rint(self.weigh(s) * UNITS).astype(np.int64)
        return (((mix(s)[:, None] >> _BITS) & U64(1)).astype(np.int64) * 2 - 1) * units[:, None]

    def fingerprint(self, s: np.ndarray) -> int:
        return int((self.signs(s).sum(axis=0) > 0).astype(U64) @ (U64(1) << _BITS))

    def near(self, group: tuple, found: np.ndarray):
        """(window, item) of all items of a group within RADIUS of each of the fingerprints, in order of both: for each block the
        list of items whose byte is near the window's, joined over the blocks and checked; so many windows at once as give PAIRS."""
        members, prints, places, ends = group
        at = 256 * np.arange(8)[:, None] + ((found[None, :] >> (U64(8) * np.arange(8, dtype=U64)[:, None])) & U64(255)).astype(np.int64)
        low, many = ends[at], ends[at + 1] - ends[at]
        total = np.cumsum(many.sum(axis=0))
        a = 0
        while a < len(found):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            n = many[:, a:b].ravel()
            window = np.repeat(np.tile(np.arange(a, b), 8), n)
            member = places[np.repeat(low[:, a:b].ravel(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            both = np.unique(window * len(members) + member)
            window, member = both // len(members), both % len(members)
            hit = np.bitwise_count(prints[member] ^ found[window]) <= RADIUS
            for w, m in zip(window[hit].tolist(), member[hit].tolist()):
                yield w, members[m]
            a = b

    def anchored(self, s: np.ndarray) -> np.ndarray:
        """Places of shingles that some item holds."""
        at = np.flatnonzero(self.filter[(s & U64((1 << 20) - 1)).astype(np.int64)])
        if len(at):
            at = at[self.known[np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)] == s[at]]
        return at

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity; shingles count as often as they occur."""
        got, n = np.unique(window, return_counts=True)
        own, part = self.shingle[(a := self.ends[item]) : (b := self.ends[item + 1])], slice(a, b)
        at = np.minimum(np.searchsorted(got, own), len(got) - 1)
        hit = got[at] == own
        both = float((np.minimum(self.times[part], n[at]) * (self.each[part] / self.times[part]))[hit].sum())
        return both / (float(self.total[item]) + float((self.weigh(got) * n).sum()) - both)

    def matches(self, text: str):
        """(item, start, words, similarity) of the best window of each item found in the text."""
        words = word_list(text)
        s = shingles(words)
        if not len(s) or not self.ids:
            return
        anchors = self.anchored(s)
        if not len(anchors):
            return
        known, weights = np.zeros(len(s)), self.weigh(s)
        known[anchors] = weights[anchors]
        of_known, of_all = (np.concatenate([[0.0], np.cumsum(w)]) for w in (known, weights))
        best: dict[int, tuple] = {}
        for n, group in self.groups.items():
            wide = min(len(s), max(1, n - WORDS + 1))  # shingles of a window
            # what an item and a window share weighs no more than the window's known shingles
            starts = np.flatnonzero((of_known[wide:] - of_known[:-wide]) >= (SIMILARITY - 1e-6) * (of_all[wide:] - of_all[:-wide]))
            for part in np.split(starts, range(4096, len(starts), 4096)):
                if not len(part):
                    continue
                low, high = int(part[0]), int(part[-1]) + wide
                if high - low > 8 * (len(part) + wide):  # scattered: fingerprint run by run
                    runs = np.split(part, np.flatnonzero(np.diff(part) > wide) + 1)
                else:
                    runs = [part]
                for run in runs:
                    low, high = int(run[0]), int(run[-1]) + wide
                    sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(self.signs(s[low:high]), axis=0)])
                    own = ((sums[run - low + wide] - sums[run - low]) > 0).astype(U64) @ (U64(1) << _BITS)
                    for w, item in self.near(group, own):
                        start = int(run[w])
                        x = self.similarity(item, s[start : start + wide])
                        if x >= SIMILARITY and (item not in best or x > best[item][3]):
                            best[item] = (self.ids[item], start, min(n, len(words)), x)
        yield from (best[i] for i in sorted(best))


def blocks(items: DataFrame, key: str, text: str):
    """Indices of the benchmark's items in blocks of bounded size."""
    integer_key(items, key)
    slim = items.where(F.col(key).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def cut(batch: pa.RecordBatch):
        own = [np.unique(shingles(word_list(t))).view(np.int64) for t in batch.column(1).to_pylist()]
        starts = np.cumsum([0, *map(len, own)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(starts, np.concatenate(own))], names=["key", "text", "shingles"])

    each = stored(map_slices(slim, cut, "key long, text string, shingles array<long>", text=1).where(F.size("shingles") > 0), "benchmark")
    count = each.count()
    df = each.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    often = each.select("key", "text", F.explode("shingles").alias("shingle")).join(df, "shingle").groupBy("key", "text").agg(F.map_from_entries(F.collect_set(F.struct("shingle", "n"))).alias("often"))
    held, counts, size = [], {}, 0
    for r in each.join(often, ["key", "text"], "left").select("key", "text", "shingles", "often").orderBy("key", "text").toLocalIterator():
        held.append((r.key, r.text))
        counts |= {x & (1 << 64) - 1: (r.often or {}).get(x, 1) for x in r.shingles}
        size += len(r.text)
        if size >= BLOCK_BYTES:
            yield Index(held, counts, count)
            held, counts, size = [], {}, 0
    yield Index(held, counts, count)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, start, n_words, similarity): for each document and item it holds, the best window (first on ties); start counts words."""
    kind = docs.schema[key].dataType.simpleString()
    schema = arrow_schema(SCHEMA)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def scan(index: Index) -> DataFrame:
        told = docs.sparkSession.sparkContext.broadcast(index)  # of at most BLOCK_BYTES of text

        def run(batch: pa.RecordBatch):
            rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) if t for m in told.value.matches(t)]
            if rows:
                at, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *rows_out(schema, columns).columns], names=["key", *schema.names])

        return map_slices(slim, run, f"key {kind}, {SCHEMA}", text=1)

    return reduce(DataFrame.union, map(scan, blocks(benchmark, item, item_text))).withColumnRenamed("key", key)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns. Between two blocks of items what is left is stored, so that a task holds one index."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    frame = docs.toDF(*names)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    for number, index in enumerate(blocks(benchmark, item, item_text)):
        frame = stored(frame, "decontaminated") if number else frame
        told = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, told=told):
            yield batch.filter(pa.array([not t or next(told.value.matches(t), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        frame = map_slices(frame, run, schema, text=at)
    return frame.toDF(*docs.columns)
