"""WARC archives, index first: offset, length, URL and digest of each record, then coalesced sorted range reads.

Each task appends its records to archive files of its own (rolled at ROLL_BYTES) in the shared folder; every record is
a gzip member of its own, or plain bytes.  The index is a table written by the same job, so only archives of task
attempts that succeeded are in it.  Selected records are dealt by segments of files, sorted by offset, and records with
gaps of at most GAP bytes are read at once.

Payloads of at least ``revisit_from`` bytes that occur more than once are stored once, with the largest page id; the others are
revisit records.  Digests and lengths find the copies, so no payload is shuffled to find them.  The list of revisits
goes to the pages by a broadcast where its counted bytes are few; else pages are shuffled once, by id and digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cairn.llm._files import read_range, write_file
from cairn.llm._spark import Scratch, sized_join
from cairn.llm._text import pieces

ROLL_BYTES, GAP, MOST = 32 << 20, 64 << 10, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone, whose Content-Length tells the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    body = http + payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        body = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Of one record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit).

    The digest of a response is that of the payload as read; ValueError if the header says another, or lengths don't fit.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(field["content-length"])
    body = rest[:n]
    if len(body) < n or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't fit")
    http, _, payload = body.partition(b"\r\n\r\n")
    declared = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    ident = lambda x: int(x[10:-1]) if len(x) > 11 else None
    sha1 = field["warc-payload-digest"].removeprefix("sha1:")
    revisit = field["warc-type"] == "revisit"
    if not revisit and (len(payload) != declared or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError("the payload isn't what was written")
    return {
        "page_id": ident(field["warc-record-id"]), "url": field.get("warc-target-uri"), "payload_bytes": declared, "payload_digest": sha1, "record_type": field["warc-type"],
        "refers_to": ident(field["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
    }


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, compress: bool = True) -> DataFrame:
    """Writes archives under ``path`` and returns the index table.

    Null html is an empty payload, a null url leaves out the target URI.  Rows with a null id are always responses
    and no other refers to them; rows that share the largest id of a payload are all responses.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    light = base.select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= revisit_from))
    heads = light.groupBy("sha1", "size").agg(F.min("page_id").alias("low"), F.max("page_id").alias("refers_to")).where("low < refers_to").drop("low")
    revisits = scratch.table(light.join(heads, ["sha1", "size"]).where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct(), "revisits")
    full = sized_join(base.withColumn("sha1", F.sha1("html")), revisits, ["page_id", "sha1"], "left").select("page_id", "url", "html", "sha1", "refers_to")

    def run(parts):
        task, number, buffer, rows = TaskContext.get().partitionId(), 0, io.BytesIO(), []

        def flush():
            nonlocal number, buffer, rows
            name = f"{path}/pages-{task:06d}-{number:04d}-{uuid.uuid4().hex}.warc{'.gz' * compress}"
            write_file(name, buffer.getvalue())
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols[:6], [name] * len(rows), *cols[6:]], types, strict=True)], names=names)
            number, buffer, rows = number + 1, io.BytesIO(), []
            return out

        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in INDEX.split(", ")]
        for part in pieces(parts):
            for page, url, html, sha1, refers in zip(*(part[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                data = record(page, url, payload, sha1, refers)
                data = gzip.compress(data, 2, mtime=0) if compress else data
                rows.append((page, url, sha1, len(payload), "response" if refers is None else "revisit", refers, buffer.tell(), len(data)))
                buffer.write(data)
                if buffer.tell() >= ROLL_BYTES:
                    yield flush()
        if rows:
            yield flush()

    return scratch.table(full.mapInArrow(run, INDEX), "index")


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the index's rows, in any selection: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    want = index.select("file", "offset", "length", "url").repartition(n, F.xxhash64("file", F.floor(F.col("offset") / MOST))).sortWithinPartitions("file", "offset")

    def fetch(run):
        file, begin, end = run[0][0], run[0][1], run[-1][1] + run[-1][2]
        data = memoryview(read_range(file, begin, end - begin))
        out = []
        for _, offset, length, url in run:
            raw = bytes(data[offset - begin : offset - begin + length])
            out.append(parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw) | {"url": url})
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in zip(names, types, strict=False)], names=names)

    def run(parts):
        held: list[tuple] = []
        for part in pieces(parts):
            for row in zip(*(part[c].to_pylist() for c in ("file", "offset", "length", "url")), strict=True):
                if held and (row[0] != held[0][0] or row[1] - (held[-1][1] + held[-1][2]) > GAP or row[1] + row[2] - held[0][1] > MOST):
                    yield fetch(held)
                    held = []
                held.append(row)
        if held:
            yield fetch(held)

    return want.mapInArrow(run, schema)


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` and reads every record back; without a path the archives go when the driver's process ends."""
    path = path or Scratch(pages.sparkSession, "warc").path("archives")
    return read(write(pages, path, **options)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
