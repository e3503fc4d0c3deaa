"""An inverted index of a text column: terms with the places of their occurrences, and character trigrams of the terms.

A term is a run of the lower-cased text without white space.  A keyword's words hold no white space either, so each of
their occurrences lies inside one term: the terms that contain a word (found by their trigrams) and those terms' postings
give the word's count and first place in every text, which is all that the keyword and hybrid scores need.  Texts are read
only to verify whole phrases, and only those of rows that have all of a phrase's words.

The index is a list of segments.  ``add`` writes one for the new rows, ``remove`` one of ids that no longer count in older
segments, and ``merge`` makes one of all.  Postings are sorted in blocks of some texts, as the tasks that read the texts
write them, so that adding shuffles no postings; ``merge`` can sort them over all files.  Terms and trigrams are
range-partitioned and sorted.  Row groups are small, so their statistics let a search read few of them.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.operators import search
from cairn.operators.snapshots import Snapshots

#: Values that are looked up by a filter which the row groups' statistics meet; more are joined.
INLINE = 500
#: Words of a query whose postings are joined; texts of queries of more words are read for what the JOINED longest leave.
JOINED = 8
#: Rows that are Python objects at once beside a block; a quarter of an Arrow batch.
ROWS = 256
#: Characters of the texts that one block of postings, and terms that one block of trigrams, is made of.
BLOCK_CHARS, BLOCK_TERMS = 8 << 20, 20_000
#: Bytes of postings that are unpacked at once; a posting's row of more is unpacked by itself.
UNPACK = 1 << 20
#: Bytes of a row group.
ROW_GROUP = 4 << 20
NAMES = ["term", "low", "texts", "packed"]
TABLES = {
    "docs": "id long, n_chars int, n_lower int, content string", "postings": "term string, low long, texts int, packed binary",
    "terms": "term string, texts long, number long", "grams": "gram string, low long, numbers array<long>", "gone": "id long",
}


@functools.cache
def _space() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)


def _starts(text: str) -> np.ndarray:
    """The places where the words of a text begin."""
    try:
        code = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = _space()[code]
    return np.flatnonzero(~space & np.concatenate(([True], space[:-1]))[: len(space)]).astype(np.int32)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _settled(run):
    """A task's function that gives the memory it no longer uses back to the system when it ends: Python workers live on."""

    @functools.wraps(run)
    def settled(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return settled


def _block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """The postings of some texts, a row a term: packed are the ids of its texts after ``low`` (two words each), how often it is in each, and all its places."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    coded = split.flatten().dictionary_encode()
    # white space at an end of a text leaves an empty word there
    c = coded.indices.to_numpy(zero_copy_only=False)
    word = c != coded.dictionary.index(pa.scalar("", pa.large_string())).as_py()
    c, d = c[word], np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(split).to_numpy())[word]
    del split, word
    if not len(c):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int32(), pa.binary())], names=NAMES)
    order = pc.array_sort_indices(coded.dictionary)
    terms = coded.dictionary.take(order).cast(pa.string())
    rank = np.empty(len(order), np.uint64)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.uint64)
    p = np.concatenate([_starts(t) for t in texts])
    key = np.sort((rank[c] << np.uint64(32)) | np.arange(len(c), dtype=np.uint64))  # texts and places stay in order inside a term
    del coded
    order = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    c, d, p = (key >> np.uint64(32)).astype(np.int32), d[order], p[order]
    del key, order
    terms = terms.slice(1) if c[0] else terms  # the empty word is the first
    new_term = np.concatenate(([True], c[1:] != c[:-1]))
    new_text = new_term | np.concatenate(([True], d[1:] != d[:-1]))
    at, term_at = np.flatnonzero(new_text), np.flatnonzero(new_term)
    own, times, first = np.array(ids, np.int64)[d[at]], np.diff(np.append(at, len(c))), np.searchsorted(at, term_at)
    low = own[first]
    # differences are small numbers, which compress: ids from the one before, places from the one before in their text
    step = np.diff(own, prepend=0)
    step[first] = 0
    step = step.view(np.uint64)
    p = np.where(new_text, p, np.diff(p, prepend=0))
    n, m = np.diff(np.append(first, len(at))), np.diff(np.append(term_at, len(c)))
    base = np.cumsum(3 * n + m) - (3 * n + m)
    words, t = np.empty(int((3 * n + m).sum()), np.uint32), np.repeat(np.arange(len(n)), n)
    j = np.arange(len(at)) - first[t]
    words[base[t] + 2 * j], words[base[t] + 2 * j + 1] = (step & np.uint64(0xFFFFFFFF)).astype(np.uint32), (step >> np.uint64(32)).astype(np.uint32)
    words[base[t] + 2 * n[t] + j] = times
    words[np.repeat(base + 3 * n - term_at, m) + np.arange(len(p))] = p
    cuts = np.append(base, len(words)).astype(np.int32) * 4
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(words)])
    return pa.RecordBatch.from_arrays([terms, pa.array(low), pa.array(n, pa.int32()), packed], names=NAMES)


def _running(steps: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums inside groups that begin at ``begin`` and have n members each."""
    total = np.cumsum(steps)
    return total - np.repeat(total[begin] - steps[begin], n) if len(steps) else total


def _unpack(part: pa.RecordBatch):
    """Of some blocks: for each text its row in ``part``, id, times and first place, and all places in the order of the texts."""
    n = part["texts"].to_numpy().astype(np.int64)
    values = part["packed"].to_pylist()
    words = np.frombuffer(b"".join(values), np.uint32).astype(np.int64)
    size = np.array([len(v) for v in values], np.int64) // 4
    base, first = np.cumsum(size) - size, np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - first[row]
    ids = _running(words[base[row] + 2 * j] | (words[base[row] + 2 * j + 1] << 32), first, n) + part["low"].to_numpy()[row]
    times = words[base[row] + 2 * n[row] + j]
    m = size - 3 * n
    places = words[np.repeat(base + 3 * n - (np.cumsum(m) - m), m) + np.arange(m.sum())]
    begin = np.cumsum(times) - times
    places = _running(places, begin, times)
    return row, ids, times, places[begin], places


def _slices(parts):
    """The rows of a task's batches in slices of about UNPACK bytes of postings: a frequent term has a large row in every block, and a batch may hold many."""
    for b in parts:
        size = pc.binary_length(b["packed"]).to_numpy().astype(np.int64)
        part = np.cumsum(size) // UNPACK
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


@_settled
def _counted(parts):
    """(segment, inside, offset, texts, packed) -> segment, id, n, at."""
    for b in _slices(parts):
        row, ids, times, firsts, _ = _unpack(b)
        inside, offset = b["inside"].to_numpy()[row], b["offset"].to_numpy()[row]
        yield pa.RecordBatch.from_arrays([b["segment"].take(pa.array(row)), pa.array(ids), pa.array((inside * times).astype(np.int64)), pa.array((firsts + offset).astype(np.int32))], names=["segment", "id", "n", "at"])


@_settled
def _placed(parts):
    """(segment, shift, texts, packed) -> segment, id, at: every place of the terms, moved by shift."""
    for b in _slices(parts):
        row, ids, times, _, places = _unpack(b)
        each = np.repeat(row, times)
        yield pa.RecordBatch.from_arrays([b["segment"].take(pa.array(each)), pa.array(np.repeat(ids, times)), pa.array((places + b["shift"].to_numpy()[each]).astype(np.int32))], names=["segment", "id", "at"])


@_settled
def _whole(parts):
    """(segment, texts, packed) -> segment, id."""
    for b in _slices(parts):
        row, ids, *_ = _unpack(b)
        yield pa.RecordBatch.from_arrays([b["segment"].take(pa.array(row)), pa.array(ids)], names=["segment", "id"])


@_settled
def _postings(batches):
    """(id, lower) -> blocks of postings."""
    ids, texts, size = [], [], 0
    for whole in batches:
        for b in (whole.slice(lo, ROWS) for lo in range(0, whole.num_rows, ROWS)):
            for rid, low in zip(b["id"].to_pylist(), b["lower"].to_pylist(), strict=True):
                ids.append(rid)
                texts.append(low or "")
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    yield _block(ids, texts)
                    ids, texts, size = [], [], 0
    if ids:
        yield _block(ids, texts)


def _joined(texts: pa.Array) -> str:
    """All strings of an array that holds no null, as one."""
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset)
    return data.to_pybytes()[cuts[0] : cuts[-1]].decode() if data else ""


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def _gram_block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The trigrams of some terms, a row a trigram: the numbers of the terms that have it, in their order here. A shorter term is one by itself."""
    terms, numbers = pa.concat_arrays([b["term"] for b in held]), np.concatenate([b["number"].to_numpy() for b in held])
    n = pc.utf8_length(terms).to_numpy().astype(np.int64)
    chars = np.frombuffer(_joined(terms).encode("utf-32-le") + bytes(8), np.uint32)
    code = chars.astype(np.uint64) + np.uint64(1)  # 0 is no character
    m = np.maximum(n - 2, 1)
    row = np.repeat(np.arange(len(n)), m)
    at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + (np.cumsum(n) - n)[row]
    size = np.minimum(n, 3)[row]
    gram = (code[at] << np.uint64(42)) | (np.where(size > 1, code[at + 1], 0) << np.uint64(21)) | np.where(size > 2, code[at + 2], 0)
    kinds = _distinct(gram)
    pair = _distinct((np.searchsorted(kinds, gram).astype(np.uint64) << np.uint64(32)) | row.astype(np.uint64))
    first = np.searchsorted(pair >> np.uint64(32), np.arange(len(kinds), dtype=np.uint64))
    values = numbers[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    three = np.stack([kinds >> np.uint64(42), (kinds >> np.uint64(21)) & np.uint64(0x1FFFFF), kinds & np.uint64(0x1FFFFF)], 1)
    text = (three[three > 0] - np.uint64(1)).astype(np.uint32).tobytes().decode("utf-32-le")
    ends = np.cumsum((three > 0).sum(1)).tolist()
    return pa.RecordBatch.from_arrays([pa.array([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.string()), pa.array(values[first]), _lists(values, first, pa.int64())], names=["gram", "low", "numbers"])


@_settled
def _grams(batches):
    """(number, term) -> for each trigram of some terms, their numbers."""
    held, terms = [], 0
    for b in batches:
        held.append(b)
        terms += b.num_rows
        if terms >= BLOCK_TERMS:
            yield _gram_block(held)
            held, terms = [], 0
    if terms:
        yield _gram_block(held)


class TextIndex:
    """An index of rows (id, content) with distinct ids; ``TextIndex(spark, path)`` opens one or begins an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.snap = spark, Snapshots(spark, path)
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= 4 * ROWS:  # texts and postings are large; lazy plans are made when they run, so the setting stays
            spark.conf.set(key, str(4 * ROWS))
        if not self.snap.versions():
            self.snap.commit({"version": 0, "segments": []})

    # segments

    def _segment(self, docs: DataFrame, gone: DataFrame | None, manifest: dict, keep: list[str], whole: bool = False) -> None:
        name = self.snap.new("segments", manifest["version"] + 1)
        base = f"{self.snap.path}/{name}"
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

        def write(df: DataFrame, kind: str) -> DataFrame:
            df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{base}/{kind}")
            return self._read(f"{name}/{kind}", kind)

        held = write(docs.select(F.col("id").cast("long").alias("id"), F.char_length("content").alias("n_chars"), F.char_length(F.lower("content")).alias("n_lower"), "content"), "docs")
        made = held.select("id", F.lower("content").alias("lower")).where("id is not null").mapInArrow(_postings, TABLES["postings"])
        postings = write(made.repartitionByRange(n, "term", "low").sortWithinPartitions("term", "low") if whole else made, "postings")
        counted = postings.select("term", F.col("texts").cast("long").alias("texts")).repartitionByRange(n, "term").groupBy("term").agg(F.sum("texts").alias("texts"))
        terms = write(counted.sortWithinPartitions("term").withColumn("number", F.monotonically_increasing_id()), "terms")
        write(terms.select("number", "term").mapInArrow(_grams, TABLES["grams"]).repartitionByRange(n, "gram", "low").sortWithinPartitions("gram", "low"), "grams")
        write(self.spark.range(0) if gone is None else gone.select(F.col("id").cast("long").alias("id")).distinct(), "gone")
        self.snap.commit({**manifest, "version": manifest["version"] + 1, "segments": [*keep, name]})

    def _read(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(TABLES[kind]).parquet(f"{self.snap.path}/{name}")

    def _table(self, kind: str) -> DataFrame:
        """A table over all segments, with the segment's number."""
        out = None
        for i, name in enumerate(self.snap.read()["segments"]):
            one = self._read(f"{name}/{kind}", kind).withColumn("segment", F.lit(i))
            out = one if out is None else out.unionAll(one)
        return self.spark.createDataFrame([], TABLES[kind] + ", segment int") if out is None else out

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without rows whose id a later segment has removed."""
        if len(self.snap.read()["segments"]) < 2:
            return rows
        last = self._table("gone").groupBy("id").agg(F.max("segment").alias("until"))
        return rows.join(last, "id", "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")

    def docs(self) -> DataFrame:
        return self._live(self._table("docs"))

    def add(self, rows: DataFrame, id_col: str = "id", text_col: str = "content") -> None:
        """New rows; those that have an id already are replaced.  Null texts have no terms and are never found."""
        m = self.snap.read()
        docs = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
        self._segment(docs, docs.select("id") if m["segments"] else None, m, m["segments"])

    def remove(self, ids: DataFrame) -> None:
        m = self.snap.read()
        self._segment(self.spark.range(0).withColumn("content", F.lit(None).cast("string")), ids, m, m["segments"])

    def merge(self, sort: bool = False) -> None:
        """One segment of all rows that count; the old ones go.  sort: postings are range-partitioned by their terms over all files, at the cost of a shuffle."""
        m = self.snap.read()
        self._segment(self.docs().select("id", "content"), None, m, [], sort)
        self.snap.sweep(["segments"], {s for x in self.snap.forget() for s in x["segments"]})

    # lookup

    def terms(self, word: str) -> DataFrame:
        """The terms that contain a word, by the trigrams of the word; for a shorter word by those that contain it."""
        if len(word) >= 3:
            grams = sorted({word[i : i + 3] for i in range(len(word) - 2)})
            found = self._table("grams").where(F.col("gram").isin(grams)).select("segment", "gram", F.explode("numbers").alias("number"))
            found = found.groupBy("segment", "number").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        else:
            found = self._table("grams").where(F.contains("gram", F.lit(word))).select("segment", F.explode("numbers").alias("number")).distinct()
        few = found.select("segment", "number").limit(INLINE + 1).collect()
        every = self._table("terms")
        if len(few) <= INLINE:
            every = every.where(F.col("number").isin([r["number"] for r in few])) if few else every.where(F.lit(False))
        else:
            every = every.join(found.select("segment", "number"), ["segment", "number"], "left_semi")
        return every.where(F.contains("term", F.lit(word))).select("term").distinct()

    def postings(self, terms: DataFrame) -> DataFrame:
        """Blocks of postings of terms: by values that the row groups' statistics meet if they are few, else by a join."""
        few = [r[0] for r in terms.limit(INLINE + 1).collect()]
        every = self._table("postings")
        if len(few) <= INLINE:
            return every.where(F.col("term").isin(few)) if few else every.where(F.lit(False))
        return every.join(terms, "term", "left_semi")

    def occurrences(self, word: str) -> DataFrame:
        """``id, count, first``: a lower-case word's occurrences in each text, counted without overlaps, and the first one's place."""
        inside = (F.char_length("term") - F.char_length(F.replace("term", F.lit(word), F.lit("")))) / F.lit(len(word))
        blocks = self.postings(self.terms(word)).select("segment", inside.cast("int").alias("inside"), (F.instr("term", word) - 1).alias("offset"), "low", "texts", "packed")
        p = self._live(blocks.mapInArrow(_counted, "segment int, id long, n long, at int"))
        return p.groupBy("id").agg(F.sum("n").alias("count"), F.min("at").alias("first"))

    def _adjacent(self, first: str, second: str) -> DataFrame:
        """``id`` of the texts in which a term that ends with ``first`` stands one character before a term that begins with ``second``."""

        def at(terms: DataFrame, shift: Column) -> DataFrame:
            blocks = self.postings(terms).select("segment", shift.cast("int").alias("shift"), "low", "texts", "packed")
            return self._live(blocks.mapInArrow(_placed, "segment int, id long, at int")).select("id", "at")

        ends = at(self.terms(first).where(F.endswith("term", F.lit(first))), F.char_length("term") + 1)
        begins = at(self.terms(second).where(F.startswith("term", F.lit(second))), F.lit(0))
        return ends.join(begins, ["id", "at"], "left_semi").select("id").distinct()

    def _words(self, words: list[str], every: bool) -> DataFrame:
        """``id`` and ``count_i, first_i`` for each word; rows that have all words, or any."""
        out = None
        for i, w in enumerate(words):
            one = self.occurrences(w).select("id", F.col("count").alias(f"count_{i}"), F.col("first").alias(f"first_{i}"))
            out = one if out is None else out.join(one, "id", "inner" if every else "full_outer")
        return out

    def _verified(self, phrase: str, at: str) -> DataFrame:
        return self.docs().join(self.candidates(phrase, at), "id", "left_semi").where(search.keyword_match(F.col("content"), phrase, at))

    def phrase(self, phrase: str) -> DataFrame:
        """``id`` of the texts that contain a lower-case phrase: only those that its words' postings leave are read."""
        return self.docs().join(self.candidates(phrase, "phrase"), "id", "left_semi").where(F.lower("content").contains(phrase)).select("id")

    def candidates(self, phrase: str, at: str = "phrase") -> DataFrame:
        """``id`` of the texts that can match: those that have the rarest of the words inside the phrase, which are whole terms.

        A phrase of two words needs them side by side.  Of one word, or where each word may be part of a term (contains),
        those that have all words, of which the JOINED longest are looked up.
        """
        words = phrase.split()
        if at != "contains" and len(words) > 2:
            inner = sorted(set(words[1:-1]))
            seen = {r["term"]: r["n"] for r in self._table("terms").where(F.col("term").isin(inner)).groupBy("term").agg(F.sum("texts").alias("n")).collect()}
            rarest = min(inner, key=lambda w: (seen.get(w, 0), w))
            blocks = self._table("postings").where(F.col("term") == rarest).select("segment", "low", "texts", "packed")
            return self._live(blocks.mapInArrow(_whole, "segment int, id long")).select("id").distinct()
        if at != "contains" and len(words) == 2 and phrase.strip() == phrase and len(phrase) == len(words[0]) + len(words[1]) + 1:
            return self._adjacent(*words)
        return self._words(sorted(set(words), key=lambda w: (-len(w), w))[:JOINED], True).select("id")

    # searches

    def keyword_search(self, keyword: str, k: int = 5, match_type: str = "contains", scoring: str = "position", rows: DataFrame | None = None, filters: Mapping | None = None) -> DataFrame:
        """``id, score`` as ``search.keyword_search`` has them.  rows: the store's (id, metadata) for ``filters``."""
        whole = keyword.lower()
        words = whole.split()
        if not words:
            return self.spark.createDataFrame([], "id long, score double")
        if match_type != "contains" and match_type not in ("exact", "starts_with", "ends_with"):
            raise ValueError(f"match_type {match_type!r} is none of contains, exact, starts_with, ends_with")
        unique = list(dict.fromkeys(words))
        if match_type != "contains" or len(unique) > JOINED:
            found = self._verified(whole, match_type)
            score = search.keyword_score(F.col("content"), whole)
        else:
            found = self._words(unique, True).join(self._live(self._table("docs").select("id", "n_chars", "segment")), "id")
            score = self._score(words, unique)
        if rows is not None:
            from cairn.operators import filters as flt

            found = found.join(flt.apply(rows, filters).select("id"), "id", "left_semi")
        return search.top(found.select("id", (F.lit(1.0) if scoring == "constant" else score).alias("score")), k)

    @staticmethod
    def _score(words: list[str], unique: list[str]) -> Column:
        """``search.keyword_score`` from counts and first places."""
        total = F.lit(0.0)
        for w in words:
            n, first = F.col(f"count_{unique.index(w)}"), F.col(f"first_{unique.index(w)}")
            total = total + (F.least(n * 0.2, F.lit(0.5)) + (1 - F.least(first / F.greatest(F.col("n_chars"), F.lit(1)), F.lit(0.8))) * 0.5)
        return F.least(total / F.lit(len(words)), F.lit(1.0))

    def text_scores(self, query: str) -> DataFrame:
        """``id, text_match`` of the texts that any word of the query occurs in, as ``search.text_score`` has it.

        A query of more than JOINED words reads the texts: any of its words may occur anywhere.
        """
        whole = query.lower()
        words = whole.split()
        unique = [w for w in dict.fromkeys(words) if len(w) >= 3]
        phrase = self.phrase(whole).withColumn("whole", F.lit(True)) if words else None
        if not unique:
            return phrase.select("id", F.lit(0.9).alias("text_match")) if words else self.spark.createDataFrame([], "id long, text_match double")
        if len(unique) > JOINED:
            every = self.docs().select("id", search.text_score(F.col("content"), query).alias("text_match"))
            return every.where("text_match > 0")
        found = self._words(unique, False).join(self._live(self._table("docs").select("id", "n_lower", "segment")), "id")

        def one(i: int) -> Column:
            own = F.least(F.col(f"count_{i}") * 0.3, F.lit(0.8)) + (1 - F.least(F.col(f"first_{i}") / F.greatest(F.col("n_lower"), F.lit(1)), F.lit(0.7))) * 0.2
            return F.when(F.col(f"count_{i}").isNotNull(), own).otherwise(F.lit(0.0))

        total = F.lit(0.0)
        for w in words:
            if len(w) >= 3:
                total = total + one(unique.index(w))
        out = found.select("id", (total / F.lit(len(words))).alias("part")).join(phrase, "id", "full_outer")
        return out.select("id", F.when(F.col("whole"), F.lit(0.9)).otherwise(F.col("part")).alias("text_match"))

    def hybrid_search(self, store: DataFrame, text: str, query, k: int = 5, filters: Mapping | None = None, vector_weight: float = 0.7, text_weight: float = 0.3) -> DataFrame:
        """``id, score, text_match, vector_match`` as ``search.hybrid_search`` has them; of ``store`` only id, vector and filtered columns are read.

        A row without a text match is in the result only if it is among the k best by vector alone, so those and the rows
        with a match are all that is ranked.  Negative weights are a ValueError.
        """
        if vector_weight < 0 or text_weight < 0:
            raise ValueError("weights must not be negative")
        from cairn.functions.vectors import cosine_to
        from cairn.operators import filters as flt

        vector = F.least(F.greatest(cosine_to(F.col("vector"), query), F.lit(0.0)), F.lit(1.0))
        rows = flt.apply(store, filters).select("id", vector.alias("vector_match"))
        best = rows.orderBy((F.col("vector_match") * F.lit(float(vector_weight))).desc(), "id").limit(k).withColumn("text_match", F.lit(0.0))
        matched = rows.join(self.text_scores(text), "id").select("id", "vector_match", "text_match")
        both = matched.unionByName(best).groupBy("id").agg(F.max("vector_match").alias("vector_match"), F.max("text_match").alias("text_match"))
        score = F.col("vector_match") * F.lit(float(vector_weight)) + F.col("text_match") * F.lit(float(text_weight))
        return search.top(both.select("id", score.alias("score"), "text_match", "vector_match"), k)
