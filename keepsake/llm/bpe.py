"""BPE encoding and decoding with a public vocabulary file.

Each word is a doubly linked list of symbols. A heap holds the merge rank of
every adjacent pair; the lowest rank, leftmost on ties, is merged first. A
merge makes new pairs and leaves old heap entries behind, which are skipped
when they come up because the symbols they were made from are gone. That is
O(n log n) for a word of n symbols, however long.

Rows are independent: no shuffle, and lost executors cost only their own tasks. A
very long text, or word, is encoded whole. Empty tables give no rows; ties of ranks
can't be, as each pair has its own.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_schema, map_slices, rows_out

#: Entries of each of a worker's two caches (pre-tokens, and runs between white space); beyond that the younger half stays.
CACHE_WORDS = 300_000
SCHEMA = "ids binary, decoded string"
_WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def letters_and_numbers(path: str) -> tuple[dict[str, str], dict[int, str]]:
    """Letters and numbers as ranges for a pattern, and how characters are folded that Python's tables don't know.

    Three versions of Unicode meet here: Python's, the pattern library's, and that of
    the library which reads the file. The last one is right. What the first two agree on,
    it agrees on; what only the newer one knows is asked of the file's own pre-tokenizer
    and normalizer, a character at a time.
    """
    kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8).copy()
    unknown = "".join(chr(i) for i in np.flatnonzero(kinds == ord("C")).tolist() if unicodedata.category(chr(i)) == "Cn")
    reader = Tokenizer.from_file(path)
    folded = {}
    for c in regex.findall(r"[\p{L}\p{N}]", unknown):
        if len(reader.pre_tokenizer.pre_tokenize_str("a" + c)) == 1:
            kinds[ord(c)] = ord("L")
        elif len(reader.pre_tokenizer.pre_tokenize_str(c + c)) == 2:
            kinds[ord(c)] = ord("N")
        if (other := reader.normalizer.normalize_str(c)) != c:
            folded[ord(c)] = other
    out = {}
    for name in "LN":
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kinds == ord(name), [0]]).astype(np.int8)))
        out[name] = "".join(f"\\U{a:08X}-\\U{b - 1:08X}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out, folded


def keep(cache: dict, key: str, value: bytes) -> None:
    """Puts short keys into a cache of bounded size."""
    if len(key) <= 64:
        if len(cache) >= CACHE_WORDS:
            for old in list(cache)[: CACHE_WORDS // 2]:
                del cache[old]
        cache[key] = value


class Bpe:
    """Encoder and decoder for a vocabulary file of byte-level BPE whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        strings = {i: s for s, i in {**self.vocab, **self.added}.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        byte = byte_symbols()
        self.inner = [self.vocab[c] for c in byte]
        self.last = [self.vocab[c + self.suffix] for c in byte]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        kinds = [s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        pattern = kinds[0].replace(r"[^\s", "[^" + _WHITE)
        ranges_of, self.folded = letters_and_numbers(path)
        for name, ranges in ranges_of.items():
            pattern = pattern.replace(rf"[\p{{{name}}}]", f"[{ranges}]").replace(rf"\p{{{name}}}]", f"{ranges}]").replace(rf"\p{{{name}}}\p", rf"{ranges}\p")
        self.pieces = regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies merges to a symbol list, lowest rank first."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        heap = []
        for i in range(n - 1):
            hit = merges.get((symbols[i], symbols[i + 1]))
            if hit:
                heap.append((hit[0], i, symbols[i], symbols[i + 1], hit[1]))
        if not heap:
            return symbols
        heapq.heapify(heap)
        symbols = symbols[:]
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # stale: one of its symbols has since been merged
            symbols[i] = made
            symbols[j] = -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                hit = merges.get((made, symbols[k]))
                if hit:
                    heapq.heappush(heap, (hit[0], i, made, symbols[k], hit[1]))
            h = before[i]
            if h >= 0:
                hit = merges.get((symbols[h], made))
                if hit:
                    heapq.heappush(heap, (hit[0], h, symbols[h], made, hit[1]))
        return [s for s in symbols if s >= 0]

    def word(self, piece: str) -> bytes:
        """Ids of one pre-token, packed as little-endian unsigned 32-bit integers."""
        got = self.words.get(piece)
        if got is None:
            raw = piece.encode()
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            got = _PACK[n](*ids) if (n := len(ids := self.merge(symbols))) < len(_PACK) else np.array(ids, "<u4").tobytes()
            keep(self.words, piece, got)
        return got

    def run(self, text: str) -> bytes:
        """Ids of text between white space."""
        got = b"".join([self.word(p) for p in self.pieces.findall(text)])
        keep(self.runs, text, got)
        return got

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ").translate(self.folded)  # lower-cased letter by letter
                part = part.lower()
                # no pre-token holds white space; U+001C to U+001F are white space to split() alone
                words, run, cache = [part] if _SEPARATORS.search(part) else part.split(), self.run, self.runs
                out.extend([cache.get(w) or run(w) for w in words])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings of the ids; the file names no decoder, so they are set apart by blanks."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) for every row of docs.

    ids: little-endian unsigned 32-bit integers, packed; decoded: the decoded
    string. A null text counts as empty and gives no ids. Repeated rows and null
    keys are kept as they are; other columns are ignored. `tokenizer` is a path
    that every worker can read.
    """
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = arrow_schema(SCHEMA)

    def run(batch: pa.RecordBatch):
        bpe = load(tokenizer)
        at, size, ids, texts = 0, 0, [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            ids.append(bpe.encode(t))
            texts.append(bpe.decode(ids[-1]))
            size += len(ids[-1]) + len(texts[-1])
            if size > 4 << 20 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), *rows_out(schema, [ids, texts]).columns], names=["key", "ids", "decoded"])
                at, size, ids, texts = i + 1, 0, [], []

    return map_slices(slim, run, f"key {kind}, {SCHEMA}", text=1).withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 of ids and decoded text, computed in the JVM."""
    return encoded.select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
