"""N-gram Jaccard join and near-duplicate groups, exact, by prefix trees.

Two texts link when the Jaccard similarity of their sets of five-word shingles is
0.8 or more. The plan:

1. One pass makes each text's set, gives it a 128-bit id, and counts shingles in a
   sketch of fixed size. Texts with equal sets are one class from here on.
2. Shingles are put in one global order, estimated count first, so that passages
   which very many texts share come last. A set of n shingles that links with
   another shares one of its n - ceil(0.8 n) + 1 first shingles with it (prefix
   filter); only those are shuffled, and those held by one class go.
3. The smallest class that holds a shingle is its pivot. Classes meet in the group
   of their pivot, which loses no pair: both classes of a pair hold a common
   shingle and so meet at its pivot. Large groups are cut into classes of set sizes,
   each 1.25 times the one before, and classes are dealt over blocks of bounded size
   that all hold the pivot. Before any set is fetched, groups of one block are
   cut by parity bitmaps (each shingle flips one of about n bits): two bitmaps
   differ in at most as many bits as the sets in shingles, and sets that link
   differ in at most a ninth of their joint sizes. What stays connected by pairs
   that pass becomes a smaller group; most classes have no such partner.
4. In a block, members that link with the pivot are settled. The others probe a
   prefix tree: the block's sets, most common shingle first, so that overlaps
   along shared beginnings are counted once. A subtree goes when what the
   probe and the subtree have left can't reach the needed overlap, when its sizes
   don't fit, and, by the triangle inequality of Jaccard distance, a member goes
   when its distance to the pivot differs from the probe's by more than 0.2.
   Members that are already joined aren't compared.
5. Unsettled members of large groups probe the other blocks of their class and of the
   two next to it, too: sets that link have sizes within a factor of 1.25.
6. Links become components in rounds of label passing over stored tables.

A null text has no words and links with nothing; a text of fewer than five words
is one shingle. Rows with a null key are returned without a component. Repeated
rows are all returned. Keys are whole numbers, unique but for repeated rows. A very
long text is one set like any other; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import U64, arrow_schema, components, grouped, integer_key, map_slices, rolling, rows_out, sequence_hash, slices, stored, word_hashes

WORDS = 5
#: Counters of the sketch that orders shingles, and the rows they are merged in.
CELLS, PARTS = 1 << 20, 64
#: A block holds about so many shingles and classes.
BLOCK_SHINGLES, BLOCK_CLASSES = 1_000_000, 2_000
#: Blocks that a class of sizes may have in the numbering of blocks.
STRIDE = 1 << 24
#: Set ids whose prefixes a task remembers having sent.
SENT = 200_000


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z are lower-cased."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    return np.unique(rolling(h, WORDS)) if len(h) >= WORDS else np.array([sequence_hash(h)], U64)


def set_id(s: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def cells(s: np.ndarray) -> np.ndarray:
    return (s & U64(CELLS - 1)).astype(np.int64)


def prefix(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set of which any set that links with it holds at least one."""
    n = len(s)
    return s[np.lexsort((s, counts[cells(s)]))[: n - (4 * n + 4) // 5 + 1]]


def parity(s: np.ndarray) -> bytes:
    """A bitmap of at least 64 and at least len(s) bits, in which each shingle flips the bit its low bits name."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def plausible(n: list[int], bitmaps: list[bytes]) -> list[int]:
    """For each set the smallest member it is connected with by pairs that sizes and bitmaps allow to link."""
    joined, sizes = Joined(len(n)), np.array(n)
    by: dict[int, tuple] = {}
    for length in {len(b) for b in bitmaps}:
        members = np.array([i for i, b in enumerate(bitmaps) if len(b) == length])
        by[length] = (members, np.stack([np.frombuffer(bitmaps[i], U64) for i in members]))
    for length, (members, table) in by.items():
        for at, i in enumerate(members.tolist()):
            for other in (length, length // 2):
                if other in by:
                    theirs, there = by[other]
                    own = table[at] if other == length else table[at][: other // 8] ^ table[at][other // 8 :]
                    ok = (5 * np.minimum(sizes[theirs], sizes[i]) >= 4 * np.maximum(sizes[theirs], sizes[i])) & (9 * np.bitwise_count(there ^ own).sum(1, dtype=np.int64) <= sizes[theirs] + sizes[i])
                    for j in theirs[ok].tolist():
                        joined.join(i, j)
    return [joined.find(i) for i in range(len(n))]


class Tree:
    """Prefix tree over sorted rank arrays; `size` has the full sizes of the sets they stand for."""

    def __init__(self, ranks: list[np.ndarray], size: list[int]):
        order = sorted(range(len(ranks)), key=lambda i: ranks[i].astype(">i4").tobytes())
        arrays = [ranks[i] for i in order]
        shared = [0]
        for a, b in zip(arrays, arrays[1:]):
            m = min(len(a), len(b))
            other = np.flatnonzero(a[:m] != b[:m])
            shared.append(int(other[0]) if len(other) else m)
        # a node: its part of the arrays, its last rank, members that end in it, children, least and most size, most left below it
        self.nodes: list[tuple] = []
        stack = [(0, len(arrays), 0, None)] if arrays else []
        while stack:
            low, high, depth, above = stack.pop()
            end = len(arrays[low]) if high - low == 1 else min(shared[low + 1 : high])
            part = arrays[low][depth:end]
            sizes = [size[order[i]] for i in range(low, high)]
            here = low
            while here < high and len(arrays[here]) == end:
                here += 1
            node = (part, int(part[-1]) if len(part) else (-1 if above is None else self.nodes[above][1]), [order[i] for i in range(low, here)], [], min(sizes), max(sizes), max(len(arrays[i]) for i in range(low, high)) - end)
            if above is not None:
                self.nodes[above][3].append(len(self.nodes))
            me = len(self.nodes)
            self.nodes.append(node)
            at = here
            for i in range(here + 1, high + 1):
                if i == high or shared[i] <= end:
                    if at < i:
                        stack.append((at, i, end, me))
                    at = i

    def matches(self, probe: np.ndarray, n: int, space: int):
        """(member, overlap) of all sets that reach the similarity with a probe of n shingles, of which `probe` are ranked."""
        mark = np.zeros(space, bool)
        mark[probe] = True
        known = probe.tolist()
        stack = [(0, 0)] if self.nodes else []
        while stack:
            at, overlap = stack.pop()
            part, last, members, children, least, most, left = self.nodes[at]
            if 5 * most < 4 * n or 5 * n < 4 * least:
                continue
            if len(part):
                overlap += int(mark[part].sum())
            if 9 * (overlap + min(left, len(known) - bisect_right(known, last))) < 4 * (n + max(least, (4 * n + 4) // 5)):
                continue
            for m in members:
                yield m, overlap
            stack.extend((c, overlap) for c in children)


class Joined:
    """Which members are joined, with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def links(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= 80 * (a + b - inter)


def block_links(ids: list[int], sets: list[np.ndarray], near: list[float], probing: list[int], settled: list[int]) -> list[tuple[int, int]]:
    """Links that join, directly or in steps, all members of a block that should be joined.

    near: similarity with the pivot. probing: members that probe the tree;
    settled: members that are joined already.
    """
    if not probing:
        return []
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets)
    tokens, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(counts > 1)
    rank = np.full(len(tokens), -1, np.int32)
    rank[common[np.argsort(-counts[common], kind="stable")]] = np.arange(len(common), dtype=np.int32)
    ranks, at = [], 0
    for n in sizes:
        r = rank[place[at : at + n]]
        ranks.append(np.sort(r[r >= 0]))
        at += n
    tree, joined, found = Tree(ranks, sizes), Joined(len(sets)), []
    for i in settled[1:]:
        joined.join(settled[0], i)
    for i in probing:
        for j, overlap in tree.matches(ranks[i], sizes[i], len(common)):
            if i != j and abs(near[i] - near[j]) <= 0.2 + 1e-9 and links(overlap, sizes[i], sizes[j]) and joined.join(i, j):
                found.append((ids[i], ids[j]))
    return found


def signatures(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """(key, n, s1, s2, bits) a row, and the sketch's counts over all shingles."""
    spec = "key long, n long, s1 long, s2 long, bits binary, part int, counts binary"
    schema = arrow_schema(spec)

    def run(batches):
        total = np.zeros(CELLS, np.uint32)
        for piece in slices(batches, 1):
            out, seen = [], []
            for t in piece.column(1).to_pylist():
                s = shingles(t or b"")
                out.append((len(s), *set_id(s), parity(s)) if len(s) else (0, 0, 0, b""))
                seen.append(s)
            total += np.bincount(cells(np.concatenate(seen)), minlength=CELLS).astype(np.uint32)
            n, a, b, bits = zip(*out)
            yield rows_out(schema, [piece.column(0), n, a, b, bits, [None] * len(n), [None] * len(n)])
        used = [(p, zlib.compress(x.tobytes(), 1)) for p, x in enumerate(np.split(total, PARTS)) if x.any()]
        if used:
            none = [None] * len(used)
            yield rows_out(schema, [none, none, none, none, none, [p for p, _ in used], [x for _, x in used]])

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    table = stored(slim.mapInArrow(run, spec), "jaccard-sets")
    schema_parts = arrow_schema("part int, counts binary")

    def add(rows: pa.Table):
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in rows.column("counts").to_pylist())
        yield rows_out(schema_parts, [[rows.column("part")[0].as_py()], [total.tobytes()]])

    counts = np.zeros((PARTS, CELLS // PARTS), np.uint64)
    for r in grouped(table.where("part is not null").select("part", "counts"), ["part"], add, "part int, counts binary").collect():  # PARTS rows of fixed size
        counts[r.part] = np.frombuffer(r.counts, np.uint64)
    return table.where("part is null").select("key", "n", "s1", "s2", "bits"), counts.reshape(-1)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): component_id is the smallest key that links lead to, the row's own included."""
    spark = docs.sparkSession
    kind = integer_key(docs, key)
    sets, counts = signatures(docs, key, text)
    classes = sets.where("n > 0 and key is not null").groupBy("s1", "s2").agg(F.min("key").alias("rep"), F.max("n").alias("n"))
    sole = sets.where("n > 3").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).where("key = rep").select("rep", "bits")  # twice for repeated rows
    order = spark.sparkContext.broadcast(counts)  # CELLS numbers, whatever the input
    slim = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))

    spec = "token long, s1 long, s2 long"
    schema = arrow_schema(spec)

    def prefixes(batches):
        sent: set = set()
        for piece in slices(batches, 1):
            tokens, a, b, n = [], [], [], []
            for t in piece.column(1).to_pylist():
                s = shingles(t or b"")
                if len(s) < 4 or (i := set_id(s)) in sent:  # smaller sets link with equal ones only
                    continue
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(i)
                p = prefix(s, order.value)
                tokens.append(p)
                a.append(i[0])
                b.append(i[1])
                n.append(len(p))
            if n:
                yield rows_out(schema, [pa.array(np.concatenate(tokens).view(np.int64)), np.repeat(a, n), np.repeat(b, n)])

    by = W.partitionBy("token")
    held = slim.mapInArrow(prefixes, spec)
    held = held.withColumns({"u": F.min("s1").over(by), "v": F.max("s1").over(by), "x": F.min("s2").over(by), "y": F.max("s2").over(by)}).where("u <> v or x <> y")
    held = stored(held.join(classes, ["s1", "s2"]).select("token", "rep", "n", "s1", "s2").distinct(), "jaccard-prefixes")
    pivots = held.groupBy("token").agg(F.min("rep").alias("pivot"))
    members = held.join(pivots, "token").select("pivot", "rep", "n").distinct()
    blocks = members.groupBy("pivot").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    members = stored(members.join(blocks, "pivot"), "jaccard-members")

    spec_cut = "pivot long, rep long, n long"

    def cut(rows: pa.Table):
        ids, n, bitmaps = rows.column("rep").to_pylist(), rows.column("n").to_pylist(), rows.column("bits").to_pylist()
        at = list({i: k for k, i in enumerate(ids)}.values())
        ids, n, bitmaps = ([x[k] for k in at] for x in (ids, n, bitmaps))
        roots = plausible(n, bitmaps)
        least: dict[int, int] = {}
        for i, r in zip(ids, roots):
            least[r] = min(i, least.get(r, i))
        many = Counter(roots)
        out = [(least[r], i, k) for i, r, k in zip(ids, roots, n) if many[r] > 1]
        if out:
            yield rows_out(arrow_schema(spec_cut), list(zip(*out)))

    small = members.where("blocks = 1").join(sole, "rep").select("pivot", "rep", "n", "bits")
    small = grouped(small, ["pivot"], cut, spec_cut).distinct()  # of one block still
    # a pivot may name a large group and a smaller one that was cut from another: told apart by `kind`
    members = stored(small.select("pivot", "rep", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("class")).union(members.where("blocks > 1").select("pivot", "rep", F.lit(1).alias("kind"), F.floor(F.ln("n") / log(1.25)).alias("class")).distinct()), "jaccard-groups")
    sizes = members.where("kind = 1").join(classes.select("rep", "n"), "rep")
    parts = stored(sizes.groupBy("pivot", "class").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("long").alias("parts")), "jaccard-parts")

    wanted = members.select("rep").distinct().join(classes.select("rep", "s1", "s2"), "rep").withColumnRenamed("rep", "key")
    spec_sets = "rep long, shingles binary"
    schema_sets = arrow_schema(spec_sets)

    def whole(batch: pa.RecordBatch):
        found = [shingles(t or b"") for t in batch.column(1).to_pylist()]
        out = [(k, s.tobytes()) for k, s, a, b in zip(batch.column(0).to_pylist(), found, batch.column(2).to_pylist(), batch.column(3).to_pylist()) if len(s) and set_id(s) == (a, b)]
        if out:
            yield rows_out(schema_sets, list(zip(*out)))

    full = stored(map_slices(slim.join(wanted, "key").select("key", "text", "s1", "s2"), whole, spec_sets, text=1), "jaccard-full")

    large = members.where("kind = 1 and rep <> pivot").join(parts, ["pivot", "class"]).withColumn("block", F.col("class") * STRIDE + F.pmod(F.xxhash64("rep"), "parts"))
    every = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("pivot", "class", (F.col("class") * STRIDE + F.col("part")).alias("to"))
    lead = every.select(F.lit(1).alias("kind"), "pivot", F.col("pivot").alias("rep"), F.col("to").alias("block"))
    own = members.where("kind = 0").withColumn("block", F.lit(0).cast("long"))
    spec_out = "a long, b long, kind int, pivot long, block long, near double"
    schema_out = arrow_schema(spec_out)

    def first(rows: pa.Table):
        pivot, kind = rows.column("pivot")[0].as_py(), rows.column("kind")[0].as_py()
        each = dict(zip(rows.column("rep").to_pylist(), rows.column("shingles").to_pylist()))
        ids, found = list(each), [np.frombuffer(x, U64) for x in each.values()]
        p = found[ids.index(pivot)]
        out, near, settled = [], [], []
        for i, s in enumerate(found):
            inter = int((p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s).sum())
            near.append(inter / (len(s) + len(p) - inter))
            if links(inter, len(s), len(p)):
                settled.append(i)
        done = set(settled)
        loose = [i for i in range(len(ids)) if i not in done]
        block = rows.column("block")[0].as_py()
        out += [(ids[i], pivot, kind, pivot, block, near[i]) for i in settled if ids[i] != pivot]
        out += [(a, b, kind, pivot, block, None) for a, b in block_links(ids, found, near, loose, settled)]
        if kind:  # its loose members are to probe the other blocks
            out += [(ids[i], None, kind, pivot, block, near[i]) for i in loose]
        if out:
            yield rows_out(schema_out, list(zip(*out)))

    cols = ["kind", "pivot", "rep", "block"]
    dealt = own.select(*cols).union(large.select(*cols)).union(lead.select(*cols)).join(full, "rep").select(*cols, "shingles")
    found = stored(grouped(dealt, ["kind", "pivot", "block"], first, spec_out), "jaccard-links")
    edges = found.where("b is not null").select("a", "b")

    loose = found.where("b is null").select("kind", "pivot", F.col("a").alias("rep"), "block", "near")
    if not loose.isEmpty():
        at = ["kind", "pivot", "block"]
        near_by = loose.withColumn("class", F.explode(F.array(*[F.floor(F.col("block") / STRIDE) + d for d in (-1, 0, 1)])))
        far = near_by.join(every, ["pivot", "class"]).where("to <> block").select("kind", "pivot", F.col("to").alias("block"), "rep", "near", F.lit(True).alias("probe"))
        told = found.where("b = pivot and near is not null").select(*at, F.col("a").alias("rep"), "near").union(loose.select(*at, "rep", "near"))
        there = told.join(far.select(*at).distinct(), at, "left_semi").select(*at, "rep", "near", F.lit(False).alias("probe"))
        meeting = far.union(there).join(full, "rep").select(*at, "rep", "near", "probe", "shingles")

        def second(rows: pa.Table):
            each = {i: x for i, *x in zip(*(rows.column(c).to_pylist() for c in ("rep", "near", "probe", "shingles")))}
            ids, (near, probe, found_) = list(each), zip(*each.values())
            got = block_links(ids, [np.frombuffer(x, U64) for x in found_], near, [i for i, x in enumerate(probe) if x], [i for i, x in enumerate(near) if not probe[i] and x >= 0.8])
            if got:
                yield rows_out(arrow_schema("a long, b long"), list(zip(*got)))

        edges = edges.union(stored(grouped(meeting, at, second, "a long, b long"), "jaccard-far"))

    roots = components(edges, "jaccard")
    named = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"))
    out = sets.drop("bits").join(named, ["s1", "s2"], "left").select("key", F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("root", "key")).alias("component_id"))
    return out.select(F.col("key").cast(kind).alias(key), "n_shingles", F.col("component_id").cast(kind))
