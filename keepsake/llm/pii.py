"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL
schemes and identifier cues such as "iban" or "password". A deterministic parser
belongs to each kind of anchor; it expands to the left and right only as far as
the kind's characters go and then validates what it got (label structure, octets,
Luhn, mod 97, digit counts). Texts without anchors cost one pass in C.

Kinds, in the order in which spans are listed:
  email, ip, card, phone   the base kinds
  account                  a valid IBAN, or a cue followed by an identifier with digits
  secret                   a cue such as token or password, = or :, and a value of 8 characters or more
  url                      an address with user and password in it

Null texts count as empty, and empty tables give no rows. Rows are independent,
repeated rows are all returned, other columns are ignored or kept as they are. A very
long text is searched whole; a parser goes no farther than the run of characters it
expands. Of spans of one kind that would overlap the first counts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_slices, rows_out

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret", "url")
ACCOUNT_CUES = ("iban", "account number", "account no", "acct", "konto", "kontonummer", "cuenta", "compte", "ssn", "social security", "passport", "reisepass", "pasaporte", "passeport", "tax id", "steuer-id")
SECRET_CUES = ("token", "password", "passwd", "passwort", "secret", "api key", "api_key", "apikey", "access key", "access_key", "private key")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"[0-9.]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CARD_RUN = re.compile(r"[0-9 -]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|#|:|=|is)){0,3}\s*([A-Za-z]{0,3}[0-9](?:[ -]?[0-9]){5,23})(?![0-9])")
_SECRET = re.compile(r"\s*[:=]\s*[\"']?([^\s\"']{8,})")
_USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+@[^\s]+")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def iban_ok(text: str) -> bool:
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _octet(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and (not bare or int(bare) <= 255)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("scheme", SCHEMES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in code points, by kind and start; spans of one kind don't overlap."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(_ASCII_LOWER)
    ends = dict.fromkeys((*KINDS, "ip_run", "card_run"), 0)
    spans: dict[str, list] = {k: [] for k in KINDS}

    def add(kind: str, start: int, end: int) -> None:
        spans[kind].append((kind, start, end))

    for at, (anchor, length) in automaton().iter(lower):
        if anchor == "digit":
            if at >= ends["ip_run"]:
                ends["ip_run"] = end = _IP_RUN.match(text, at).end()
                if end - at >= 7:
                    for m in _IP.finditer(text, at, end):
                        if all(map(_octet, m.groups())):
                            add("ip", *m.span())
            if at >= ends["card_run"]:
                ends["card_run"] = end = _CARD_RUN.match(text, at).end()
                if end - at >= 16:
                    for m in _CARD.finditer(text, at, end):
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            add("card", *m.span())
        elif anchor == "at":
            start, least = at, ends["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                ends["email"] = m.end()
                add("email", start, m.end())
        elif anchor == "plus":
            if m := _PHONE.match(text, at):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", *m.span())
        else:
            after = at + 1
            if anchor == "scheme":
                start = after - length
                if start >= ends["url"] and (m := _USERINFO.match(text, after)):
                    ends["url"] = m.end()
                    add("url", start, m.end())
            elif after - length > 0 and lower[after - length - 1].isalnum():
                continue  # within a longer word
            elif anchor == "secret":
                if after >= ends["secret"] and (m := _SECRET.match(text, after)):
                    ends["secret"] = m.end()
                    add("secret", *m.span(1))
            elif after >= ends["account"]:
                gap = re.compile(r"[\s:=#]*").match(text, after).end()
                m = _IBAN.match(text, gap)
                while m and not iban_ok(m[0]) and m.end() - m.start() > 15:
                    m = _IBAN.match(text, gap, m.end() - 1)
                if m and iban_ok(m[0]):
                    ends["account"] = m.end()
                    add("account", *m.span())
                elif m := _ACCOUNT.match(text, after):
                    ends["account"] = m.end()
                    add("account", *m.span(1))
    return [s for k in KINDS for s in spans[k]]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first names the whole."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts of the base kinds, base, spans) a row; base and spans are kind:start:end lists joined by commas."""
    kind = docs.schema[key].dataType.simpleString()
    schema = arrow_schema(SCHEMA)

    def run(batch: pa.RecordBatch):
        found = [find(t or "") for t in batch.column(1).to_pylist()]
        counts = [[sum(s[0] == k for s in f) for f in found] for k in BASE_KINDS]
        out = rows_out(schema, [*counts, [listed(s for s in f if s[0] in BASE_KINDS) for f in found], list(map(listed, found))])
        return pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["key", *schema.names])

    return map_slices(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, {SCHEMA}", text=1).withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans in `text` replaced by placeholders; all other columns stay as they are, null texts stay null."""
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batch: pa.RecordBatch):
        done = [None if t is None else redacted(t, find(t)) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, names[at], pa.array(done, pa.string()))

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    return map_slices(docs.toDF(*names), run, schema, text=at).toDF(*docs.columns)
