"""Quality rules from tokeniser fertility.

Public vocabularies are yardsticks that nothing here was trained for: natural text of
a script they cover takes few tokens a character, few tokens that spell bytes, and
spreads over many different tokens. Two are held against each text, one with byte
fallback and one of byte pairs learned from many languages. Each has a band for the
script that most letters of the text belong to, for three measures:

  chars_per_token   code points in words over tokens
  byte_share        tokens that spell a part of a code point over all tokens
  token_entropy     entropy of the token distribution in bits, over the most that
                    so many tokens could have (log2 of their number, at most 9)

A text is in band if it is in both. The least characters a token are lowered by a
quarter of the standard error of the text's own mean, which narrows with the root of
the number of tokens. The entropy of few tokens is nearer to its most than that of many,
and needs no such allowance.

Beside the verdict come plain counts (symbols, repeated lines, words in repeated
five-word windows), which a caller may use for a base rule. Null and empty texts
have no words and are in no band. A very long text is encoded whole. Rows are
independent; repeated rows are all returned, other columns ignored, and an empty table
gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_slices, rolling, rows_out, word_hashes

#: First code points of blocks and the script each belongs to; "" has no say.
BLOCKS = ((0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xF00, "other"), (0x1000, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFE00, ""), (0x20000, "han"), (0x32000, ""))
SCRIPTS = sorted({s for _, s in BLOCKS})
#: Accepted ranges by script: least and most characters a token, most byte share, least token entropy; with byte fallback,
#: and with byte pairs of many languages. Sentences of 18 languages lie inside, random letters of each script (of the scripts
#: that a vocabulary covers) outside of one of the two.
FALLBACK_BANDS = {
    "latin": (1.75, 8.0, 0.05, 0.64),
    "greek": (0.55, 4.0, 0.10, 0.35),
    "cyrillic": (1.3, 8.0, 0.10, 0.50),
    "hebrew": (0.5, 3.0, 0.10, 0.33),
    "arabic": (0.5, 4.0, 0.15, 0.35),
    "indic": (0.5, 3.0, 0.50, 0.33),
    "kana": (0.5, 3.0, 0.45, 0.45),
    "han": (0.5, 3.0, 0.60, 0.50),
    "hangul": (0.45, 3.0, 0.50, 0.40),
    "other": (0.25, 4.0, 0.92, 0.30),
    "": (1.0, 8.0, 0.50, 0.50),
}
PAIRS_BANDS = {
    "latin": (1.70, 8.0, 0.08, 0.62),
    "greek": (1.2, 5.0, 0.25, 0.50),
    "cyrillic": (1.4, 8.0, 0.12, 0.50),
    "hebrew": (1.15, 5.0, 0.18, 0.50),
    "arabic": (1.2, 6.0, 0.20, 0.50),
    "indic": (0.5, 4.0, 0.75, 0.33),
    "kana": (0.75, 4.0, 0.45, 0.50),
    "han": (0.6, 3.0, 0.65, 0.50),
    "hangul": (0.7, 4.0, 0.60, 0.50),
    "other": (0.3, 4.0, 1.00, 0.30),
    "": (1.0, 8.0, 0.50, 0.50),
}
#: Standard errors by which a text's characters a token may fall short of the least of its band.
SPREADS = 0.25
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, pairs_tokens long, pairs_chars_per_token double, pairs_byte_share double, pairs_token_entropy double, script string, in_band boolean"
_STARTS = np.array([b for b, _ in BLOCKS])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in BLOCKS])


class Fallback:
    """A sentencepiece vocabulary with byte fallback."""

    bands = FALLBACK_BANDS

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        pieces = [self.model.id_to_piece(i) for i in range(len(self.bytes))]
        #: Code points a token spells; of a code point's bytes the first has it.
        self.chars = np.array([not 0x80 <= int(p[3:-1], 16) < 0xC0 if b else len(p.replace("\u2581", "")) for p, b in zip(pieces, self.bytes)], float)

    def tokens(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)


class Pairs:
    """A byte-pair vocabulary of ranks, with its pattern of words."""

    bands = PAIRS_BANDS

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes, self.chars = np.zeros(max(ranks.values()) + 1, bool), np.zeros(max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = not _whole(piece)
            self.chars[i] = sum(not 0x80 <= b < 0xC0 for b in piece if b != 0x20)

    def tokens(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_ordinary(text), np.int32)


def _whole(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def load(fallback: str, pairs: str, pattern: str) -> tuple[Fallback, Pairs]:
    return Fallback(fallback), Pairs(pairs, pattern)


def script_of(text: str) -> str:
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else ""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = np.bincount(_SCRIPT[np.searchsorted(_STARTS, points, "right") - 1], minlength=len(SCRIPTS))
    counts[SCRIPTS.index("")] = 0
    return SCRIPTS[int(counts.argmax())] if counts.any() else ""


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words within windows of k words that occur twice or more, first ones included."""
    grams = rolling(word_hashes(words), k)
    if len(grams) < 2:
        return 0
    _, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hit = counts[place] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int32)
    edge[: len(hit)] += hit
    edge[k : k + len(hit)] -= hit
    return int((np.cumsum(edge) > 0).sum())


def held(ids: np.ndarray, chars: int, yardstick: Fallback | Pairs, script: str) -> tuple[int, float, float, float, bool]:
    """(tokens, characters a token, byte share, entropy, whether they are in band)."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0, False
    per_token, byte_share = chars / n, float(yardstick.bytes[ids].mean())
    error = float(yardstick.chars[ids].std()) / n**0.5
    counts = np.unique(ids, return_counts=True)[1] / n
    entropy = max(0.0, float(-(counts * np.log2(counts)).sum())) / min(9.0, log2(n)) if n > 1 else 0.0
    low, high, most_bytes, least_entropy = yardstick.bands[script]
    return n, per_token, byte_share, entropy, low - SPREADS * error <= per_token <= high and byte_share <= most_bytes and entropy >= least_entropy


def measure(text: str, yardsticks: tuple[Fallback, Pairs]) -> tuple:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    chars = len(text) - sum(map(text.count, WHITE))
    script = script_of(text)
    plain = b" ".join(words).decode()
    (*first, in_first), (*second, in_second) = (held(y.tokens(plain), chars, y, script) for y in yardsticks)
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), *first, *second, script, in_first and in_second


def rules(docs: DataFrame, fallback: str, pairs: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, measures, script, in_band) for every row of docs. The vocabularies are paths that every worker can read; `pattern` cuts words for the second."""
    kind = docs.schema[key].dataType.simpleString()
    schema = arrow_schema(SCHEMA)

    def run(batch: pa.RecordBatch):
        yardsticks = load(fallback, pairs, pattern)
        found = [measure(t or "", yardsticks) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *rows_out(schema, list(zip(*found)) or [[]] * len(schema)).columns], names=["key", *schema.names])

    return map_slices(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, {SCHEMA}", text=1).withColumnRenamed("key", key)
