"""Line dedup by content-defined line chunks.

A text's units are its non-blank lines; blank lines belong to the one before them.  A unit's digest is the md5 of its
line's bytes.  The rolling value at unit i is ``(31 * head[i-1] + head[i]) mod 2^31``, with the digests' first 32 bits
as heads (head[-1] = 0); a boundary lies after unit i unless that value is divisible by ``divisor``.  So boundaries depend
on two lines alone and move with them.

The chunks of a text are, for each unit, the run from it to the next boundary, and the run to it from the last
boundary, each of 2 to MOST units: wherever a repeated passage begins and ends among other text, chunks begin and end
there too.  A line of more than LONG words is a chunk by itself.  Chunks that occur more than once, in one text or in
several, go but for the first (smallest id, then text hash, then position), so the first occurrence of every line stays.

Digests only nominate: a chunk goes only if one byte string has each of its lines' digests, and one sequence of line
digests has the chunk's, in all nominated occurrences.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cairn.llm._spark import Scratch
from cairn.llm._text import pieces

MASK = (1 << 31) - 1
#: Units of a chunk at most, and words of a line at most that is no chunk by itself.
MOST, LONG = 16, 50
#: Parts that the occurrences of one chunk are dealt to.
SALTS = 8


def units(text: str) -> tuple[list[bytes], list[int]]:
    """The lines, and the positions of those that aren't blank."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.md5(data).digest()[:size]


def chunks(lines: list[bytes], divisor: int, digests: list[bytes] | None = None) -> list[tuple[int, int]]:
    """(first unit, units) of each chunk of a text whose units have these lines, in order."""
    heads = [int.from_bytes((d or b"")[:4]) for d in (digests or map(digest, lines))]
    n = len(lines)
    cut = [(31 * (heads[i - 1] if i else 0) + heads[i] & MASK) % divisor != 0 for i in range(n)]
    out = set()
    end = n - 1
    for i in range(n - 2, -1, -1):  # to the first boundary from unit i + 1 on
        if cut[i + 1]:
            end = i + 1
        out.add((i, min(end, i + MOST - 1) - i + 1))
    start = 0
    for j in range(1, n):  # from the last boundary up to unit j - 2
        if j >= 2 and cut[j - 2]:
            start = j - 1
        begin = max(start, j - MOST + 1)
        out.add((begin, j - begin + 1))
    out.update((i, 1) for i, x in enumerate(lines) if len(x) > 2 * LONG and len(x.split()) > LONG)
    return sorted(out)


def _prints(divisor: int, size: int):
    """id, h, text -> id, h, start, n, and the chunk's digest as two integers."""

    def run(parts):
        for part in pieces(parts):
            ids, hs, starts, ns, fps = [], [], [], [], []
            for i, h, text in zip(part["id"].to_pylist(), part["h"].to_pylist(), part["text"].to_pylist(), strict=True):
                lines, at = units(text)
                own = [lines[k] for k in at]
                prints = list(map(digest, own))
                found = chunks(own, divisor, prints)
                ids += [i] * len(found)
                hs += [h] * len(found)
                for s, n in found:
                    starts.append(s), ns.append(n), fps.append(digest(b"".join([p[:size] for p in prints[s : s + n]]), size).ljust(16, b"\0"))
            flat = struct.unpack(f"<{2 * len(fps)}q", b"".join(fps))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ns, pa.int32()), pa.array(flat[::2], pa.int64()), pa.array(flat[1::2], pa.int64())],
                names=["id", "h", "start", "n", "f1", "f2"],
            )

    return run


def _evidence(size: int):
    """text, spans -> (digest, data): each nominated line with its digest, each nominated chunk's line digests with its digest."""

    def run(parts):
        for part in pieces(parts):
            seen = set()
            for text, spans in zip(part["text"].to_pylist(), part["spans"].to_pylist(), strict=True):
                lines, at = units(text)
                prints = {}
                for x in spans:
                    for k in range(x["start"], x["start"] + x["n"]):
                        if k not in prints:
                            prints[k] = digest(lines[at[k]], size)
                            seen.add((b"l" + prints[k], lines[at[k]]))
                    key = b"".join([prints[k] for k in range(x["start"], x["start"] + x["n"])])
                    seen.add((b"c" + digest(key, size), key))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary())], names=["digest", "data"])

    return run


def _remove(text_at: int, spans_at: int, names: list[str], mixed: frozenset, size: int):
    """Takes all columns and the spans; puts the text that stays in its place and adds the two counts."""

    def run(parts):
        for part in pieces(parts):
            texts, gone, stretches = [], [], []
            for text, spans in zip(part.column(text_at).to_pylist(), part.column(spans_at).to_pylist(), strict=True):
                later = [x for x in spans or () if x["later"]]
                if not later:
                    texts.append(text), gone.append(0), stretches.append(0)
                    continue
                lines, at = units(text)
                drop: set[int] = set()
                for x in later:
                    own = range(x["start"], x["start"] + x["n"])
                    if mixed:
                        prints = [digest(lines[at[k]], size) for k in own]
                        if b"c" + digest(b"".join(prints), size) in mixed or any(b"l" + p in mixed for p in prints):
                            continue
                    drop.update(own)
                ends = [*at[1:], len(lines)]
                stay = lines[: at[0]]
                for k, (a, b) in enumerate(zip(at, ends, strict=True)):
                    if k not in drop:
                        stay += lines[a:b]
                texts.append(b"\n".join(stay).decode("utf-8", "surrogatepass") if drop else text)
                gone.append(len(drop)), stretches.append(sum(k - 1 not in drop for k in drop))
            cols = [pa.array(texts, pa.string()) if j == text_at else part.column(j) for j in range(spans_at)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.int64()), pa.array(stretches, pa.int64())], names=names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, digest_bytes: int = 16) -> DataFrame:
    """All rows and columns of ``docs`` with the text that stays, and ``lines_removed`` (non-blank ones), ``chunks_removed`` (stretches of neighbouring lines).

    Null texts stay null, empty ones empty; a text whose lines all go becomes empty.  Rows with a null id pass
    unchanged and don't count as occurrences.  Rows that repeat an id and text are treated alike: where one keeps
    a chunk, both do; rows that share an id alone are documents of their own.  Columns named lines_removed or
    chunks_removed are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("lines_removed", "chunks_removed")
    key = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h")]
    base = docs.select(*key, F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    runs = scratch.table(base.mapInArrow(_prints(divisor, digest_bytes), "id long, h long, start int, n int, f1 long, f2 long"), "chunks")
    place = F.struct("id", "h", "start")
    # least and largest place instead of a count: a repeated row isn't another occurrence
    first = scratch.table(runs.groupBy("f1", "f2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("f1", "f2", "lo"), "first")
    dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = runs.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int")).join(dealt, ["f1", "f2", "salt"])
    one = F.struct("start", "n", (place != F.col("lo")).alias("later"))
    spans = scratch.table(named.groupBy("id", "h").agg(F.collect_set(one).alias("spans")), "spans")
    scratch.drop(runs, first)
    where = (F.col("__cairn_id") == F.col("id")) & (F.col("__cairn_h") == F.col("h"))
    rows = docs.withColumns({"__cairn_id": F.col(id_col).cast("long"), "__cairn_h": F.xxhash64(F.col(text_col).cast("string"))})
    slim = spans.withColumnsRenamed({"id": "__cairn_id", "h": "__cairn_h", "spans": "__cairn_spans"})
    # texts are shuffled once, at every size in the same way, and read twice from there
    joined = scratch.table(rows.join(slim.hint("merge"), ["__cairn_id", "__cairn_h"], "left"), "joined")
    scratch.drop(spans)
    names = docs.columns
    text_at = names.index(text_col)
    evidence = joined.where("__cairn_spans is not null").select(F.col(text_col).cast("string").alias("text"), F.col("__cairn_spans").alias("spans"))
    same = evidence.mapInArrow(_evidence(digest_bytes), "digest binary, data binary").groupBy("digest").agg(F.min("data").alias("low"), F.max("data").alias("high"))
    # 128-bit digests of different bytes: none is expected
    mixed = frozenset(bytes(r.digest) for r in same.where("low <> high").select("digest").collect())
    schema = T.StructType([*docs.schema.fields, T.StructField("lines_removed", T.LongType()), T.StructField("chunks_removed", T.LongType())])
    return joined.select(*[joined[c] for c in names], "__cairn_spans").mapInArrow(_remove(text_at, len(names), schema.names, mixed, digest_bytes), schema)
