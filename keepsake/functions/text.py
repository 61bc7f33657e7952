"""Text, JSON and timestamp functions with the semantics that memory rows need."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code point ranges that are searched by trigrams for lack of spaces.
CJK = "぀-ヿ㐀-䶿一-鿿ｦ-ﾟ"
_RUNS = re.compile(f"[{CJK}]+|[^\\s{CJK}]+")
_CJK = re.compile(f"[{CJK}]")
EXCLUDE_PREFIX = 32
MAX_CONTENT = 16_000
ANNOTATION = r"\[Memory from [^\]]*\]\s*"
MENTION = r"<@!?\d+>"


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def contains_literal(c: Column, query: str) -> Column:
    return F.contains(lower_ascii(c), lower_ascii(F.lit(query)))


def source_starts(prefix: str, column: str = "source") -> Column:
    """$.id of a JSON column starts with a literal prefix, ASCII case aside."""
    return F.coalesce(F.startswith(lower_ascii(F.get_json_object(column, "$.id")), lower_ascii(F.lit(prefix))), F.lit(False))


def stripped(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sanitised(c: Column, cap: int | None = MAX_CONTENT) -> Column:
    """Without memory annotations and mentions, stripped, cut to cap characters (None: whole)."""
    clean = stripped(F.regexp_replace(F.regexp_replace(c, ANNOTATION, ""), MENTION, ""))
    return clean if cap is None else F.substring(clean, 1, cap)


def trigrams(c: Column) -> Column:
    """All runs of three characters of the lower-cased text, in order; linear in its length."""
    chars = F.split(F.lower(c), "")
    n = F.greatest(F.size(chars) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(chars, 2, n), F.slice(chars, 3, n), lambda a, b: F.concat(a, b))
    return F.coalesce(F.zip_with(F.slice(chars, 1, n), pairs, lambda a, b: F.concat(a, b)), F.array().cast("array<string>"))


def phrases(query: str) -> list[str]:
    """The search phrases of a query: trigrams of CJK runs, other runs whole; shorter than three characters goes."""
    found: dict[str, None] = {}
    for run in _RUNS.findall(query):
        if len(run) >= 3:
            found.update(dict.fromkeys([run[i : i + 3] for i in range(len(run) - 2)] if _CJK.match(run) else [run]))
    return list(found)


def occurrences(low: Column, phrase: str) -> Column:
    """How often a phrase occurs in a lower-cased text, overlaps included."""
    own = phrase.lower()
    if any(own[:k] == own[-k:] for k in range(1, len(own))):  # occurrences may overlap
        quoted = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", own)
        return F.regexp_count(low, F.lit(f"(?={quoted})"))
    gone = F.length(low) - F.length(F.replace(low, F.lit(own), F.lit("")))
    return (gone / len(own)).cast("int")


def excluded(c: Column, texts: list[str]) -> Column:
    """Whether a content matches one of the caller's own texts: equal, or for 32 characters and more one begins with the other."""
    own = F.lower(stripped(c))
    hit = F.lit(False)
    for t in dict.fromkeys(x.strip().lower() for x in texts):
        if t and len(t) < EXCLUDE_PREFIX:
            hit = hit | (own == t)
        elif t:
            hit = hit | (own == t) | ((F.length(own) >= EXCLUDE_PREFIX) & (F.startswith(own, F.lit(t)) | F.startswith(F.lit(t), own)))
    return hit & (own != "")


def json_valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def instant(c: Column) -> Column:
    """Seconds since 1970 of an ISO date or time; without an offset it is UTC. Null where it can't be read."""
    plain = F.regexp_replace(c, " ", "T")
    full = F.when(F.length(plain) == 10, F.concat(plain, F.lit("T00:00:00"))).otherwise(plain)
    full = F.regexp_replace(full, r"^(.{10}T\d\d:\d\d)(Z|[+-]|$)", "$1:00$2")
    zoned = F.when(full.rlike(r"(Z|[+-]\d\d:?\d\d)$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.unix_micros(zoned.try_cast("timestamp")) / 1e6)


def utc_text(seconds: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'+00:00'") -> Column:
    """Seconds since 1970 as UTC text, whatever the session's time zone."""
    whole = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.floor(seconds))
    return F.date_format(whole, pattern)


def local_text(seconds: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1970 as text in a time zone, for people to read beside the UTC text."""
    whole = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.floor(seconds))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), whole), pattern)


def zone_class(c: Column) -> Column:
    """utc, aware (another offset) or naive."""
    return F.when(F.endswith(c, F.lit("Z")) | F.endswith(c, F.lit("+00:00")), "utc").when(c.rlike(r"^.{10}.*[+-]\d{2}:?\d{2}$") & instant(c).isNotNull(), "aware").otherwise("naive")


def memory_key(agent: Column, ts: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", agent, ts, content).cast("binary"), 256), 1, 8)


#: Spellings of producer types and what they stand for.
TYPES = ("User", "Agent", "System")
TYPE_WORDS = {"user": "User", "agent": "Agent", "system": "System", "assistant": "Agent", "ai": "Agent", "session": "System"}
BARE_WORDS = {"user": "User", "assistant": "Agent", "ai": "Agent"}


def bound(value: Column, fn) -> Column:
    """fn(value), where fn's expression may use the value many times while it is computed once."""
    return F.transform(F.array(value), lambda x: fn(x))[0]


def _told(words: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.lower(stripped(key)))


def normalised_source(c: Column) -> Column:
    """Struct (type, id, name, mapped) of a JSON source; mapped says that a known legacy shape was rewritten. Unknown shapes have a null type."""
    keys = F.json_object_keys(c)

    def facts(v: Column) -> Column:
        text = lambda path: F.try_variant_get(v, path, "string")
        shape = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        inner = [F.struct(shape(f"$.{t}").alias("shape"), text(f"$.{t}").alias("text"), text(f"$.{t}.id").alias("id"), text(f"$.{t}.name").alias("name")).alias(t) for t in TYPES]
        sole = F.when(F.size(keys) == 1, F.element_at(keys, 1))
        return F.struct(F.schema_of_variant(v).alias("shape"), shape("$.type").alias("kind"), _told(BARE_WORDS, text("$")).alias("bare"), text("$.type").alias("type"), _told(TYPE_WORDS, text("$.type")).alias("word"), text("$.id").alias("id"), text("$.name").alias("name"), sole.alias("sole"), *inner)

    def struct(t, i, n, mapped):
        return F.struct(t.alias("type"), i.alias("id"), n.alias("name"), F.lit(mapped).alias("mapped"))

    def decided(f: Column) -> Column:
        empty, none = F.lit(""), F.lit(None).cast("string")
        is_object, typed = F.startswith(f["shape"], F.lit("OBJECT")), f["kind"] == "STRING"
        out = F.when((f["shape"] == "STRING") & f["bare"].isNotNull(), struct(f["bare"], empty, empty, True))
        out = out.when(is_object & typed & f["type"].isin(*TYPES), struct(f["type"], f["id"], f["name"], False))
        out = out.when(is_object & typed & f["word"].isNotNull(), struct(f["word"], f["id"], f["name"], True))
        for t in TYPES:
            alone = is_object & F.coalesce(f["kind"] == "VOID", F.lit(True)) & (f["sole"] == t)
            out = out.when(alone & (f[t]["shape"] == "STRING"), struct(F.lit(t), f[t]["text"], empty if t == "System" else f[t]["text"], True))
            out = out.when(alone & F.startswith(f[t]["shape"], F.lit("OBJECT")), struct(F.lit(t), F.coalesce(f[t]["id"], empty), F.coalesce(f[t]["name"], empty), True))
        return out.otherwise(struct(none, none, none, False))

    return bound(bound(F.try_parse_json(c), facts), decided)
