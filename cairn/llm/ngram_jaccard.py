"""N-gram Jaccard join: MinHash banding, then verification on the full shingle sets.

1. One pass makes each document's set of five-word shingles (64-bit fingerprints), a 128-bit digest of the
   set and the band hashes.  Documents with one digest are one class; from here on only classes move.
2. Bands and rows are chosen for a target recall at the threshold (``choose_bands``).  Classes are shuffled on
   band hashes; buckets of one class go, and of buckets with the same members one stays.
3. The sets of classes in a bucket are made again from one text each (a set is about as long as its text, so
   it isn't kept), and large buckets are cut into blocks: a class meets each block once, no task holds a bucket.
4. A pair is counted in the first kept bucket that both have, so that no list of pairs is shuffled: each block
   returns a count of links and a local root for each class, and star rounds join the roots.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm._spark import Scratch, connected_components, sized_join
from cairn.llm._text import U, Words, batches, mix, pieces, shingle_sets

#: Classes, and bytes of their sets, that a block of a bucket holds on average.
BLOCK_ROWS, BLOCK_BYTES = 1024, 12 << 20


def choose_bands(threshold: float = 0.8, recall: float = 0.9999, most: int = 24) -> tuple[int, int]:
    """The (bands, rows) with most rows, hence fewest false candidates, whose recall at the threshold is reached with at most ``most`` bands."""
    best = (most, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if bands <= most:
            best = (max(1, bands), rows)
    return best


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, 2 * n + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """int64 [len(sets), bands]; every set must have a shingle."""
    n = bands * rows
    mult = _multipliers(n)
    x = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), bands), U)
    for b in range(bands):
        h = np.full(len(sets), b + 1, U)
        for r in range(rows):
            j = b * rows + r
            h = mix(h * U(0x9E3779B97F4A7C15) + np.minimum.reduceat((x ^ mult[n + j]) * mult[j], at))
        out[:, b] = h
    return out.view(np.int64)


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signatures(k: int, bands: int, rows: int):
    def run(parts):
        for part in pieces(parts):
            for group in batches(zip(part["id"].to_pylist(), part["text"].to_pylist(), part["md5"].to_pylist(), strict=True), 1):
                sets = shingle_sets(Words([t for _, t, _ in group]), k)
                full = [s for s in sets if len(s)]
                hashes = band_hashes(full, bands, rows) if full else np.zeros((0, bands), np.int64)
                counts = np.array([len(s) for s in sets], np.int32)
                ends = np.concatenate(([0], np.cumsum((counts > 0) * bands))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in group], pa.int64()), pa.array([m for _, _, m in group], pa.string()), pa.array([digest(s) for s in sets], pa.binary()), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel()))],
                    names=["id", "md5", "cls", "n", "bands"],
                )

    return run


def _sets(k: int):
    def run(parts):
        for part in pieces(parts):
            for group in batches(zip(part["cls"].to_pylist(), part["text"].to_pylist(), strict=True), 1):
                keep = [(c, s) for (c, _), s in zip(group, shingle_sets(Words([t for _, t in group]), k), strict=True) if digest(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in keep], pa.binary()), pa.array([s.tobytes() for _, s in keep], pa.binary())], names=["cls", "grams"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over the shingles that both sides have."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    ia, ib = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    both = np.intersect1d(a, b)
    ka, kb = np.isin(a, both), np.isin(b, both)
    ca, cb, ia, ib = np.searchsorted(both, a[ka]), np.searchsorted(both, b[kb]), ia[ka], ib[kb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, cb, ia, ib = ca[oa], cb[ob], ia[oa], ib[ob]
    step = 2048
    for lo in range(0, len(both), step):
        width = min(step, len(both) - lo)
        ma, mb = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        s, e = np.searchsorted(ca, [lo, lo + width])
        ma[ia[s:e], ca[s:e] - lo] = 1
        s, e = np.searchsorted(cb, [lo, lo + width])
        mb[ib[s:e], cb[s:e] - lo] = 1
        out += ma @ mb.T
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with Jaccard similarity of at least the threshold; right=None: pairs i < j within left."""
    other = left if right is None else right
    inter = intersections(left, other).astype(np.float64)
    na, nb = np.array([len(s) for s in left], float), np.array([len(s) for s in other], float)
    hit = inter >= threshold * (na[:, None] + nb[None, :] - inter) - 1e-9
    if right is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def _verify(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, lo, hi = (x.as_py() for x in key)
        cls, size = table["cls"].to_pylist(), np.array(table["size"].to_pylist(), np.int64)
        sets = [np.frombuffer(x, U) for x in table["grams"].to_pylist()]
        mine = np.array(table["kept"].to_pylist(), np.int64).reshape(len(cls), -1)
        block = np.array(table["c"].to_pylist())
        i = np.flatnonzero(block == lo)
        j = i if lo == hi else np.flatnonzero(block == hi)
        p = q = np.zeros(0, np.int64)
        if len(i) and len(j):
            p, q = similar_pairs([sets[x] for x in i], None if lo == hi else [sets[x] for x in j], threshold)
            p, q = i[p], j[q]
            first = np.concatenate([np.zeros(0, bool)] + [_first(mine[p[s : s + 65536]], mine[q[s : s + 65536]], h) for s in range(0, len(p), 65536)])
            p, q = p[first], q[first]
        links = np.bincount(p, size[q], len(cls)) + np.bincount(q, size[p], len(cls)) if len(p) else np.zeros(len(cls))
        order = np.argsort(np.array(cls, object), kind="stable")
        rank = np.empty(len(cls), np.int64)
        rank[order] = np.arange(len(cls))
        root = rank.copy()
        while len(p):
            low = np.minimum(root[p], root[q])
            before = root.copy()
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            if (before == root).all():
                break
        got = np.flatnonzero(links > 0)
        return pa.table({"cls": pa.array([cls[x] for x in got], pa.binary()), "root": pa.array([cls[order[root[x]]] for x in got], pa.binary()), "links": pa.array(links[got].astype(np.int64))})

    return run


def _first(a: np.ndarray, b: np.ndarray, h: int) -> np.ndarray:
    """Whether h is the first kept bucket that both rows of band hashes have (0: not kept)."""
    same = (a == b) & (a != 0)
    return np.take_along_axis(a, same.argmax(1)[:, None], 1)[:, 0] == h if len(a) else np.zeros(0, bool)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.9999, most_bands: int = 24, by_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, component_id, n_links, class_size, n_shingles``.

    n_links counts the other documents whose shingle sets have a Jaccard similarity of at least ``threshold``
    with this one's (equal sets included); component_id is the smallest id that links reach, itself included.

    Null or wordless texts link with nothing: n_links 0, component_id their own id.  A null id can't be
    reached: such a row comes out with null component_id and 0 links.  Rows that repeat an id count as documents
    of their own; with ``by_text`` there are two more columns: text_md5, which tells such rows apart, and component,
    one value for all rows that links reach (null where there is none but equal rows' sets).  Texts of one to four
    words have one shingle, all their words.  Other columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    bands, rows = choose_bands(threshold, recall, most_bands)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), (F.md5(text) if by_text else F.lit("")).alias("md5"))
    sig = scratch.table(base.where("id is not null").mapInArrow(_signatures(k, bands, rows), "id long, md5 string, cls binary, n int, bands array<long>"), "signatures")
    classes = scratch.table(sig.where("n > 0").groupBy("cls").agg(F.count("*").alias("size"), F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    slots = classes.select("cls", "n", F.posexplode("bands").alias("b", "h"))
    buckets = (
        slots.groupBy("h")
        .agg(F.count("*").alias("members"), F.sum("n").alias("grams"), F.bit_xor(F.xxhash64("cls")).alias("s1"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("s2"))
        .where("members > 1")
        .groupBy("members", "s1", "s2")
        .agg(F.min("h").alias("h"), F.max("grams").alias("grams"))
        .select("h", F.ceil(F.greatest(F.col("members") / BLOCK_ROWS, F.col("grams") * 8.0 / BLOCK_BYTES)).cast("int").alias("blocks"))
    )
    members = scratch.table(slots.join(buckets, "h").select("cls", "b", "h", "blocks"), "members")
    cands = scratch.table(
        members.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("b", "h"))).alias("m"))
        .join(classes.select("cls", "size", "rep"), "cls")
        .select("cls", "size", "rep", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long"))).alias("kept")),
        "candidates",
    )
    texts = sized_join(base, cands.select(F.col("rep").alias("id"), "cls"), "id", "inner")
    sets = texts.select("cls", "text").mapInArrow(_sets(k), "cls binary, grams binary").dropDuplicates(["cls"])
    blocks = members.withColumn("c", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("cls", "h", "c", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"))
    full = blocks.join(cands.select("cls", "size", "kept").join(sets, "cls"), "cls")
    found = scratch.table(full.groupBy("h", "lo", "hi").applyInArrow(_verify(threshold), "cls binary, root binary, links long"), "found")
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    reached = roots.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    lowest = reached.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = reached.join(lowest, "root").select(F.col("node").alias("cls"), "component_id", "root")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = scratch.table(
        classes.select("cls", "size", "rep").join(counts, "cls", "left").join(linked, "cls", "left")
        .select("cls", "size", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")),
        "info",
    )
    long = lambda c, least: F.coalesce(c, F.lit(least)).cast("long")
    result = scratch.table(
        sig.select("id", "md5", "cls", "n").join(info, "cls", "left")
        .select(F.col("id").alias("doc_id"), F.coalesce("component_id", "id").alias("component_id"), long("n_links", 0).alias("n_links"), long("size", 1).alias("class_size"), long("n", 0).alias("n_shingles"), F.col("md5").alias("text_md5"), F.col("root").alias("component")),
        "result",
    )
    scratch.drop(sig, classes, members, cands, found, info)
    unknown = base.where("id is null").select(
        F.col("id").alias("doc_id"), F.col("id").alias("component_id"), long(F.lit(0), 0).alias("n_links"), long(F.lit(1), 1).alias("class_size"), long(F.lit(0), 0).alias("n_shingles"), F.col("md5").alias("text_md5"), F.lit(None).cast("binary").alias("component")
    )
    out = result.unionAll(unknown)
    return out if by_text else out.drop("text_md5", "component")
