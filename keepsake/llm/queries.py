"""One query per corpus operator, each over the whole of its table.

A query takes (spark, sf_dir), applies its operator with production parameters
and derives the digest columns of its result from the operator's outputs.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fertility, jaccard, kneser_ney, langid, pii, quality, substring, warc
from .common import bucket


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; every machine has the package."""
    return importlib.import_module("public_tokenizers").path(name)


def yardsticks() -> tuple[str, str, str]:
    """Two vocabularies for fertility, and the pattern of the second."""
    return tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_multi_50k.tiktoken"), importlib.import_module("public_tokenizers").PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs, bucket(F.col("doc_id"), 7) != 2)
    return kneser_ney.score(docs, model).select("doc_id", (bucket(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats(table(spark, sf_dir, "documents"))
    digest = F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), F.col("words_sha256"))
    return found.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"), bucket(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, machine)
    return scored.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(folder, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.rules(table(spark, sf_dir, "documents"), *yardsticks())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measures = ("n_tokens", "chars_per_token", "byte_share", "token_entropy", "pairs_tokens", "pairs_chars_per_token", "pairs_byte_share", "pairs_token_entropy", "script")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("in_band")).alias("kept"), *measures)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = langid.profiles(docs, bucket(F.col("doc_id"), 3) != 1)
    found = langid.identify(docs, known)
    return found.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_bpe": op1_bpe, "op2_decontaminate": op2_decontaminate, "op3_substring": op3_substring, "op4_quality": op4_quality, "op5_jaccard": op5_jaccard, "op6_warc": op6_warc, "op7_fertility": op7_fertility, "op8_langid": op8_langid, "op9_kneser_ney": op9_kneser_ney, "op10_pii": op10_pii}
#: The two operators that SQL can express, and the archive's rows, as DuckDB reads the tables.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "op3_substring": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) y),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM x JOIN f USING (h) WHERE doc_id > first GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op5_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0) y),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
x AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM x""",
}
