"""Operators 11 to 13 against brute force, with nulls, empties, long texts, ties, repeats and clashing columns."""

import datetime
import glob
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn.llm import elkan, merkle, schema_rewrite
from cairn.llm._spark import Scratch
from cairn.llm.oracles import MERKLE, clusters_sql
from cairn.llm.queries import queries

# 11: drifted schema rewrite

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, rank int, file_no string"


def clients(rng, n):
    rows = []
    for i in range(n):
        some = lambda x: None if rng.random() < 0.1 else x  # noqa: E731, B023
        rows.append((i, some(i // 2), some("crm"), some(datetime.datetime(1969, 12, 31) + datetime.timedelta(microseconds=rng.randrange(10**15))), some(f"n|{i}"), some("é" * rng.randrange(4)), some(""), some(rng.randrange(25)), some("retail"), some(rng.choice([-0.1, 0.1, 1e-9, -3.75, 16777217.5, 1e30, -0.0])), 7, "x"))
    return rows


def brute_rewrite(rows, files, seed=19):
    crc = lambda r: zlib.crc32(str(r[0]).encode())
    rows = sorted(rows, key=lambda r: (crc(r), r[0]))
    size, out = 1 + len(rows) // files, []
    names = list(schema_rewrite.EVOLVED)
    for no in range(-(-len(rows) // size)):
        v = zlib.crc32(f"{seed}:{no}".encode()) % 24
        v = 0 if v > 15 else v
        start = [{"name": "email", "email": "name"}.get(c, c) if v & 1 else c for c in names if not (v & 4 and c in ("nation_id", "segment"))]
        start = start[:1] + start[:0:-1] if v & 2 else start
        lines, nulls = [], 0
        for r in rows[no * size : (no + 1) * size]:
            r = list(r[:10])
            if v & 4:
                r[7], r[8] = -1, "none"
            if v & 8 and r[9] is not None:
                r[9] = struct.unpack("f", struct.pack("f", r[9]))[0]
            nulls += r.count(None)
            if r[3] is not None:
                r[3] = (r[3] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
            if r[9] is not None:
                r[9] = math.floor(1048576 * r[9])
            lines.append(["?" if x is None else str(x) for x in r])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((no, v, len(lines), nulls, sha(",".join(x[0] for x in lines)), sha("\n".join("|".join(x) for x in lines)), ",".join(start), ",".join(names), v != 0))
    return out


REPORT = ["file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "rewritten"]


def test_rewrite_against_brute_force(spark, tmp_path):
    rows = clients(random.Random(3), 700)
    df = spark.createDataFrame(rows, CLIENTS).repartition(5)
    got = schema_rewrite.schema_rewrite(df, f"file://{tmp_path}/out", files=30).orderBy("file_no")
    found = got.collect()
    assert [tuple(r[c] for c in REPORT) for r in found] == brute_rewrite(rows, 30)
    assert {r.version for r in found} >= {0, 1, 2} and any(r.version & 8 for r in found) and any(r.version & 4 for r in found)
    there = glob.glob(f"{tmp_path}/out/files/*")
    assert sorted(f"file://{p}" for p in there) == sorted(r.path for r in found) and not glob.glob(f"{tmp_path}/out/staging/*")
    for p in there:
        schema = pq.read_schema(p)
        assert [(f.name, f.type, int(f.metadata[b"PARQUET:field_id"]), f.nullable) for f in schema] == [(f.name, f.type, i, True) for i, f in enumerate(schema_rewrite.evolved_schema(), 1)]


def test_rewrite_of_the_given_table(spark, small):
    rows = [tuple(r) for r in duckdb.sql(f"SELECT * FROM '{small}/clients.parquet'").fetchall()]
    got = queries()["op11_schema_rewrite"](spark, small)
    assert [tuple(r[c] for c in REPORT) for r in got.orderBy("file_no").collect()] == brute_rewrite(rows, 250)


def test_rewrite_edges(spark, tmp_path):
    empty = spark.createDataFrame([], CLIENTS)
    assert schema_rewrite.schema_rewrite(empty, f"{tmp_path}/none").count() == 0
    row = (5, 1, "a", None, "n", "e", None, 3, "s", float("nan"), 1, "x")
    rows = [row] * 40 + [(None, *row[1:])] * 3 + [(6, *row[1:9], float("inf"), 1, "x")]
    found = schema_rewrite.schema_rewrite(spark.createDataFrame(rows, CLIENTS).repartition(3), f"{tmp_path}/odd", files=4).orderBy("file_no").collect()
    assert sum(r.n_rows for r in found) == 44 and [r.n_rows for r in found] == [12, 12, 12, 8]
    ids = [x for r in found for f in [pq.read_table(r.path.removeprefix("file://"))] for x in f["client_id"].to_pylist()]
    assert ids[:3] == [None] * 3 and sorted(ids[3:]) == [5] * 40 + [6]


def test_rewrite_again_finds_originals_until_all_are_there(spark, tmp_path):
    """A task that runs twice gives the same file; a file of the evolved schema isn't touched; one without ids is an error."""
    scratch, path = Scratch(spark, "t"), f"file://{tmp_path}/x"
    rows, n = schema_rewrite.ranked(spark.createDataFrame(clients(random.Random(1), 60), CLIENTS).drop("rank", "file_no"), ["client_id"], scratch)
    files = schema_rewrite.write_files(rows, 5, n, path, scratch)
    once, twice = (schema_rewrite.rewrite(files, path, scratch).orderBy("file_no").collect() for _ in range(2))
    assert once == twice and len(glob.glob(f"{tmp_path}/x/files/*")) == 12 + sum(r.rewritten for r in once)
    with pytest.raises(ValueError, match="no field id"):
        schema_rewrite.by_id(__import__("pyarrow").schema([("a", "int64")]))


@pytest.mark.parametrize("hot", [False, True])
def test_ranks(spark, hot):
    rng = random.Random(5)
    keys = [None if rng.random() < 0.1 else 7 if hot and rng.random() < 0.5 else rng.randrange(1000) for _ in range(3000)]
    df = spark.createDataFrame([(k, 0) for k in keys], "k long, rank0 int").repartition(6)
    out, n = schema_rewrite.ranked(df, ["k"], Scratch(spark, "t"))
    got = sorted((r["rank"], r["k"]) for r in out.collect())
    assert n == 3000 and [r for r, _ in got] == list(range(3000))
    assert [k for _, k in got] == sorted(keys, key=lambda k: (k is not None, k or 0))


# 12: document fingerprints


def brute_print(text):
    lines = (text or "").split("\n")
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    blank = [x.strip(" ") == "" for x in lines]
    starts = [i for i in range(len(lines)) if i == 0 or digests[i][0] == "0" or re.match(r"#{1,6}\s", lines[i]) or (blank[i - 1] and not blank[i])]
    spans = list(zip(starts, [*starts[1:], len(lines)], strict=True))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    root = sha(";".join(sha(",".join(digests[a:b])) for a, b in spans))
    leaf = lambda x: "".join(hashlib.md5(p.encode()).hexdigest()[:6] for p in re.findall(r"[^.!?]{1,128}[.!?]*|[.!?]+", x))
    return root + "".join(":" + ",".join(leaf(x) for x in lines[a:b]) for a, b in spans)


def brute_near(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = (set(re.findall("[0-9a-f]{6}", p[64:])) for p in (a, b))
    n = len(x) + len(y)
    return min(2.0 * len(x & y), n - 1.0) / n if n else 0.0


def brute_documents(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{'?' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()))
    out = []
    for j, (i, t) in enumerate(rows):
        nxt = rows[(j + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        p, e = brute_print(t), brute_print(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), p, e, round(brute_near(p, e), 9), round(brute_near(p, brute_print(nxt)), 9)))
    return sorted(map(repr, out))


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["αβγ", "naïve", "word", "x😀y", "long" * 30]) for _ in range(rng.randrange(1, 12))) + rng.choice([".", "!", "", "?!"])
    text = lambda: "\n".join(rng.choice(["", "  ", "# Head", sentence() + " " + sentence(), sentence()]) for _ in range(rng.randrange(1, 30)))
    rows = [(i, text()) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, "."), (104, "a" * 200_000), (105, "x. " * 30_000), (106, "a\n" * 20_000)]
    rows += [(7, rows[7][1])] * 5 + [(8, "another of 8"), (None, "no id"), (None, None), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "k", 1, "n") for i, t in rows], "doc_id long, text string, key string, part int, next string").repartition(7)
    got = sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))) for r in merkle.document_fingerprints(df).collect())
    assert got == brute_documents(rows)


def test_fingerprint_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert merkle.document_fingerprints(df([])).count() == 0
    one = merkle.document_fingerprints(df([(1, "abcdefgh")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    same = merkle.document_fingerprints(df([(5, "same text.")] * 200)).collect()
    assert len(same) == 200 and len({r.fingerprint for r in same}) == 1 and all(r.near_next == 1.0 for r in same)


def test_fingerprint_plan_has_no_python(spark, small):
    plan = queries()["op12_merkle"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edits_are_located(spark):
    rng = random.Random(2)
    lines = [f"line {i} {rng.random()}." for i in range(200)]
    changed = list(lines)
    changed[20], changed[150] = "something else.", changed[150] + " and more."
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    r = df.select(merkle.edits(F.col("a"), F.col("b")).alias("e"), merkle.edits(F.col("a"), F.col("a")).alias("none"), merkle.likeness(F.col("a"), F.col("b")).alias("n"), "b").first()
    sections = [s.split(",") for s in r.b[65:].split(":")]
    at = [sum(map(len, sections[: e.section])) + e.paragraph for e in r.e]
    assert at == [20, 150] and r.none == [] and 0.95 < r.n < 1.0


def test_likeness_tells_edited_from_next(spark, small):
    rows = queries()["op12_merkle"](spark, small).where("n_chars > 600").collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


# 13: centroid clustering


def brute_clusters(rows, k, rounds, dim, scale, seed):
    keep = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [q for _, q in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in keep if i is not None)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, v, strict=True)), j) for j, v in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in keep]
        for j in range(len(c)):
            if mine := [q for (_, q), a in zip(keep, own, strict=True) if a == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    d = [near(q) for _, q in keep]
    total = lambda j=None: sum(x for x, a in d if j is None or a == j)
    return sorted(repr((i, a, x, total(a), total(), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest())) for (i, _), (x, a) in zip(keep, d, strict=True))


def rows_of(df):
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in df.collect())


VECTORS = "vec_id long, embedding array<float>, cluster int, q string, distance int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "q", 2) for i, v in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("kind", ["grid", "groups", "large"])
def test_clusters_against_brute_force(spark, kind):
    """A coarse grid is full of ties; groups make the bounds prune; large components leave the range of exact floating-point products."""
    rng = random.Random(kind)
    if kind == "grid":
        rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(400)]
    elif kind == "groups":
        mid = [[rng.uniform(-5, 5) for _ in range(4)] for _ in range(8)]
        rows = [(i, [x + rng.gauss(0, 0.05) for x in mid[i % 8]]) for i in range(400)]
    else:
        rows = [(i, [float(rng.randrange(-260_000, 260_000)) for _ in range(4)]) for i in range(300)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [1.0, 1.0, 1.0, float("-inf")]), (None, [0.5] * 4), (3, rows[3][1]), (3, rows[4][1])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = elkan.clusters(vectors(spark, rows), k=12, rounds=5, dim=4)
    assert rows_of(got) == brute_clusters(rows, 12, 5, 4, 256, 2)
    if kind == "groups":
        assert got.agg(F.sum("computed")).first()[0] < 0.5 * got.count() * 12 * 6


def test_cluster_edges(spark):
    assert elkan.clusters(vectors(spark, []), dim=2).count() == 0
    assert elkan.clusters(vectors(spark, [(1, None), (None, [1.0, 2.0])]), dim=2).count() == 0
    rows = [(i, [1.0, 2.0]) for i in range(50)]
    assert rows_of(elkan.clusters(vectors(spark, rows), dim=2)) == brute_clusters(rows, 40, 5, 2, 256, 2)
    few = [(1, [0.0, 0.0]), (2, [3.0, 4.0])]
    assert rows_of(elkan.clusters(vectors(spark, few), dim=2)) == brute_clusters(few, 40, 5, 2, 256, 2)
    with pytest.raises(ArithmeticError, match="need not fit"):
        elkan.clusters(vectors(spark, [(1, [1e30, 0.0])]), dim=2)


def test_bounds_are_outward():
    rng = np.random.default_rng(1)
    squares = np.concatenate([rng.integers(0, 1 << 62, 5000), rng.integers(0, 1000, 500) ** 2])
    for s, up, down in zip(squares.tolist(), elkan._root_up(squares).tolist(), elkan._root_down(squares).tolist(), strict=True):
        a, b = up.as_integer_ratio(), down.as_integer_ratio()
        assert a[0] ** 2 >= s * a[1] ** 2 and b[0] ** 2 <= s * b[1] ** 2
    x = rng.random(2000) * 1e6
    assert (elkan._single_down(x).astype(np.float64) <= x).all()


@pytest.mark.parametrize("name", ["op12_merkle", "op13_elkan"])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    rel = con.execute({"op12_merkle": MERKLE, "op13_elkan": clusters_sql(40, 5, 64, 256, 2)}[name])
    names = [d[0] for d in rel.description]
    df = queries()[name](spark, small)
    plain = lambda r: repr([round(r[n], 9) if isinstance(r[n], float) else r[n] for n in sorted(names)])
    assert sorted(names) == sorted(df.columns)
    assert sorted(plain(r) for r in df.collect()) == sorted(plain(dict(zip(names, r, strict=True))) for r in rel.fetchall())
