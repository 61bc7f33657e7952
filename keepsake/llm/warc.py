"""WARC archives: written once, found again through an index.

Writing. Every record is a gzip member of its own. A task writes its records to
archives of bounded size in the shared folder and writes beside them, for each record,
where it lies: file, offset, length, URL and digest. These rows are the index, a Parquet
table. File names are new for each attempt; a task returns the name of its piece of the
index, and the pieces of attempts that counted are moved into it, so a lost executor
leaves at most a file that nothing refers to. Executors write no file through Hadoop,
whose local file system starts a process for each (chmod): until that process is under
way it shares all memory with the executor, and tools that add up processes count it twice.

Pages with equal payloads (by SHA-1, SHA-256 and length) are written once: the one
with the smallest id as response, the others as revisit records without payload
that refer to it. Which page that is comes from partial aggregates; pages are then
joined with it by digest, a join that Spark may split where one payload is frequent.

Reading. The wanted index rows are dealt by file and stretch of the file and
sorted by offset; ranges that lie close together are read at once, up to a bound,
and records are cut out, unpacked, parsed and checked against their digest.

Null pages have an empty payload. Rows with a null id can't be referred to; they
are written as responses. Repeated rows of one id are written as often as they
occur, each as a record with an id of its own; which of them is the response doesn't
matter, as a revisit names page, URL and date. Ids are whole numbers. A very large
payload is one record. Empty tables give an empty index. Archives begin with a warcinfo
record. They lie below spark.checkpoint.dir, or in a folder of the caller's, who
removes them; `drop` does.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, grouped, integer_key, rows_out, shared_path, slices

#: An archive is closed beyond so many bytes; a read spans at most READ bytes and skips at most GAP; a stretch is read by one task,
#: and a task reads about TASK bytes where there is work for more tasks than there are shuffle partitions.
ARCHIVE, READ, GAP, STRETCH, TASK = 256 << 20, 4 << 20, 64 << 10, 8 << 20, 256 << 20
#: Slices of index rows in a row group.
ROW_GROUP = 64
INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def record(where: str, date: str, page_id: int | None, url: str, payload: bytes, kind: str, sha1: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record, uncompressed. `where` (archive and offset) makes its id."""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, where)}>",
        "WARC-Date": date,
        "WARC-Target-URI": one_line(url),
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    body = payload if kind == "response" else b""
    if kind == "response":
        head["Content-Type"] = "text/html; charset=utf-8"
    else:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": one_line(refers_url or ""), "WARC-Refers-To-Date": date, "X-Refers-To-Page-Id": str(refers_to)}
    return _framed(head, body)


def _framed(head: dict[str, str], body: bytes) -> bytes:
    head["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def opening(name: str, date: str) -> bytes:
    """The record that tells what an archive is."""
    body = b"format: WARC File Format 1.1\r\nsoftware: keepsake\r\n"
    return _framed({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, body)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; raises ValueError where it is damaged."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if first != "WARC/1.1" or not gap or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"damaged record: {first!r}")
    return fields, rest[:size]


def write(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, date: str | None = None) -> tuple[str, DataFrame]:
    """Writes archives and index; (folder, index). Payloads of fewer than `least` bytes are never revisits. `date` (UTC) is that of all records, by default now."""
    spark = pages.sparkSession
    integer_key(pages, key)
    folder = folder or shared_path(spark, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    slim = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    slim = slim.withColumns({"sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256), "size": F.octet_length("payload")})
    same = ["sha1", "sha256", "size"]
    firsts = slim.where(f"size >= {least} and page_id is not null").groupBy(*same).agg(F.min(F.struct("page_id", "url")).alias("first"))
    late = F.col("page_id") > F.col("first.page_id")
    told = slim.join(firsts, same, "left").select("page_id", "url", "payload", F.when(late, F.col("first.page_id")).alias("refers_to"), F.when(late, F.col("first.url")).alias("refers_url"))
    schema = arrow_schema(INDEX)

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/pending", recursive=True)
        out, name, at, rows_at, index, held = None, "", 0, f"{uuid.uuid4().hex}.parquet", None, []

        def flush():
            nonlocal index
            if held:
                index = index or pq.ParquetWriter(f"{root}/pending/{rows_at}", schema, filesystem=system)
                index.write_table(pa.Table.from_batches(held))
                held.clear()

        try:
            for piece in slices(batches, 2):
                rows = []
                for page_id, u, payload, refers, refers_url in zip(*(c.to_pylist() for c in piece.columns)):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                        out.write(first := gzip.compress(opening(name, date), 6, mtime=0))
                        at = len(first)
                    kind = "response" if refers is None else "revisit"
                    packed = gzip.compress(record(f"{name}:{at}", date, page_id, u, payload, kind, sha := digest(payload), refers, refers_url), 6, mtime=0)
                    out.write(packed)
                    rows.append((page_id, u, name, at, len(packed), len(payload), sha, kind, refers))
                    at += len(packed)
                held.append(rows_out(schema, list(zip(*rows))))
                if len(held) >= ROW_GROUP:
                    flush()
            flush()
        finally:
            for x in (out, index):
                if x is not None:
                    x.close()
        if index is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rows_at])], names=["name"])

    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{root}/index").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an index already")
    names = [r.name for r in told.mapInArrow(run, "name string").collect()]  # one a task
    for part in ("pending", "index"):
        system.create_dir(f"{root}/{part}", recursive=True)
    for name in names:
        system.move(f"{root}/pending/{name}", f"{root}/index/{name}")
    system.delete_dir(f"{root}/pending")
    return folder, spark.read.schema(INDEX).parquet(f"{folder}/index")


def drop(folder: str) -> None:
    """Removes archives and index."""
    system, root = fs.FileSystem.from_uri(folder)
    system.delete_dir(root)


def read(folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that index rows name, from the archives; revisits have a null payload. With payloads=False it isn't returned."""
    wanted = index.select("file", (F.col("offset") / STRETCH).cast("long").alias("stretch"), "offset", "length")
    schema = arrow_schema(RECORDS)
    # index rows are small and what they point at isn't: the number of tasks follows the bytes to read
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // STRETCH), max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))))

    def run(rows: pa.Table):
        system, root = fs.FileSystem.from_uri(folder)
        file = rows.column("file")[0].as_py()
        offsets, lengths = (rows.column(c).to_numpy() for c in ("offset", "length"))
        order = np.argsort(offsets, kind="stable")
        offsets, lengths = offsets[order], lengths[order]
        with system.open_input_file(f"{root}/{file}") as f:
            at = 0
            while at < len(offsets):
                end, low, high = at + 1, int(offsets[at]), int(offsets[at] + lengths[at])
                while end < len(offsets) and offsets[end] - high <= GAP and offsets[end] + lengths[end] - low <= READ:
                    high = max(high, int(offsets[end] + lengths[end]))
                    end += 1
                f.seek(low)
                raw = f.read(high - low)
                out = []
                for o, n in zip(offsets[at:end].tolist(), lengths[at:end].tolist()):
                    head, block = parse(gzip.decompress(raw[o - low : o - low + n]))
                    sha, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    if kind == "response" and digest(block) != sha:
                        raise ValueError(f"{file} at {o}: payload and digest differ")
                    page, refers = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
                    out.append((int(page) if page else None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), sha, kind, refers and int(refers), block if payloads and kind == "response" else None))
                yield rows_out(schema, list(zip(*out)))
                at = end

    return grouped(wanted, ["file", "stretch"], run, RECORDS, tasks)
