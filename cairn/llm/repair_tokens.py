"""Token ids in Re-Pair grammar-compressed shards, with random access by document.

Documents are dealt by ranges of doc_id and sorted; each task cuts its documents into shards of about SHARD_TOKENS
ids.  In a shard, rounds replace frequent pairs of adjacent symbols by nonterminals until no pair occurs MIN_COUNT
times: a round replaces all pairs that do, left to right, in favour of the more frequent pair where two overlap.
Pairs never span documents, so a document is a range of symbols.

File format, little-endian: magic ``RPAIR1\\0\\0``; uint32 counts: terminals' bound, rules, documents, symbols, bits of
a symbol; rules as uint32 pairs (rule r makes symbol bound + r); expansion lengths of rules, uint32; for each
document doc_id int64, first symbol uint32, tokens uint32 (its highest bit: the id is null); crc32 of all that precedes, uint32; the symbols, packed
in that many bits.  One document is decoded from its own symbols; the expansion lengths give where its n-th id lies.

Token ids come from the tokenizers library (``Encoder``).
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cairn.llm._files import read_range, size, write_file
from cairn.llm._spark import Scratch
from cairn.llm._text import U, batches, pieces

SHARD_TOKENS = 1_500_000
MIN_COUNT = 16
#: Marks a document without an id, in its number of tokens.
NO_ID = 1 << 31
MAGIC = b"RPAIR1\0\0"
_HEAD = struct.Struct("<8s5I")
_CACHE = 800_000
#: Byte-level BPE's character for a line feed.
LINE_FEED = "\u010a"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts from a tokenizers file, as little-endian uint32 bytes.

    If the file is the word-level BPE that ``_by_words`` knows, nothing joins characters across white space, so each
    distinct word is encoded once for a worker (at most _CACHE are held; those of the last texts stay).  Latin-1 words skip
    the library's normaliser and splitter: their lower-cased form is split here and the pieces go to the library's
    BPE.  Other files, and texts with characters that str and the file's patterns see differently, go whole to the library.
    """

    #: The file's splitter (fixed value), for words of PLAIN alone.
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
    PLAIN = re.compile(r"[a-z0-9!-/:-@\[-`{-~ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tok = Tokenizer.from_file(path)
        self.apart = _by_words(json.loads(self.tok.to_str()))
        if self.apart:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = self.bare.pre_tokenizer = None
            self.bytes_to_chars = _byte_chars()
            # the byte of a line feed, which no word holds, stands between words that the library gets as one text
            mark = self.bare.encode(LINE_FEED, add_special_tokens=False)
            self.mark = mark.ids[0] if len(mark.ids) == 1 and mark.tokens[0].startswith(LINE_FEED) else None
            self.bare.pre_tokenizer = Split(LINE_FEED, "isolated")
        self.words: dict[str, bytes] = {}  # of Latin-1 texts, lower-cased
        self.others: dict[str, bytes] = {}

    @staticmethod
    def _library(tok, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), 20_000):
            found = tok.encode_batch_fast(texts[lo : lo + 20_000], add_special_tokens=False)
            flat, at = array("I", chain.from_iterable([e.ids for e in found])).tobytes(), 0
            for n in map(len, found):
                out.append(flat[at : at + 4 * n])
                at += 4 * n
        return out

    def _bare(self, pieces: list[str]) -> None:
        fresh = [p for p in pieces if p not in self.words]
        chars = [p if p.isascii() else p.encode().decode("latin-1").translate(self.bytes_to_chars) for p in fresh]
        self.words.update(zip(fresh, self._lined(chars) if self.mark is not None else self._library(self.bare, chars), strict=True))

    def _lined(self, pieces: list[str]) -> list[bytes]:
        """What ``_library`` gives for pieces that hold no line feed, a thousand of them a text."""
        lines = [LINE_FEED.join(pieces[lo : lo + 1000]) + LINE_FEED for lo in range(0, len(pieces), 1000)]
        out: list[bytes] = []
        for lo in range(0, len(lines), 20):
            flat = np.concatenate([np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast(lines[lo : lo + 20], add_special_tokens=False)])
            ends, data = (4 * np.flatnonzero(flat == self.mark)).tolist(), flat.tobytes()
            out += [data[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]
        return out

    def _new(self, new: list[str]) -> None:
        words = self.words
        alpha, tailed, other = [], [], []
        for w in new:
            (alpha if w.isalpha() else tailed if w[-1] in ".,;:!?" and w[:-1].isalpha() else other).append(w)
        self._bare(alpha)
        self._bare(list({*(w[:-1] for w in tailed), *(w[-1] for w in tailed)}))
        words.update([(w, words[w[:-1]] + words[w[-1]]) for w in tailed])
        plain = [w for w in other if self.PLAIN.fullmatch(w)]
        split = [self.PIECES.findall(w) for w in plain]
        self._bare(list(set().union(*split)))
        words.update([(w, b"".join(map(words.__getitem__, p))) for w, p in zip(plain, split, strict=True)])
        odd = [w for w in other if w not in words]
        words.update(zip(odd, self._library(self.tok, odd), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return self._library(self.tok, texts)
        out: list[bytes] = [b""] * len(texts)
        latin, wide, whole = [], [], []
        for i, t in enumerate(texts):
            # marked-up special tokens, and four separators that are white space to str.split only
            if "<|" in t or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t:
                whole.append(i)
            else:
                (latin if _is_latin(t) else wide).append(i)
        for own, cache, lower in ((latin, self.words, True), (wide, self.others, False)):
            split = pc.utf8_split_whitespace(pa.array([texts[i].lower() if lower else texts[i] for i in own], pa.large_string()))
            coded = split.flatten().dictionary_encode()
            words = _strings(coded.dictionary)
            cache[""] = b""  # white space at an end of a text leaves an empty word there
            ids = list(map(cache.get, words))
            if len(cache) > _CACHE:
                cache.clear()
                cache.update([(w, x) for w, x in zip(words, ids, strict=True) if x is not None])
            missing = [k for k, x in enumerate(ids) if x is None]
            new = [words[k] for k in missing]
            if lower:
                self._new(new)
            else:
                cache.update(zip(new, self._library(self.tok, new), strict=True))
            for k, w in zip(missing, new, strict=True):
                ids[k] = cache[w]
            for i, x in zip(own, _gathered(ids, coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()), strict=True):
                out[i] = x
        for i, x in zip(whole, self._library(self.tok, [texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


def _strings(words: pa.LargeStringArray) -> list[str]:
    """An array's words, which hold no line feed, as Python's; faster than to_pylist."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")


def _gathered(ids: list[bytes], words: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """For each text, whose words are words[cuts[k]:cuts[k + 1]], the ids of its words in order."""
    flat, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin, n = (np.cumsum(size) - size)[words], size[words]
    ends = np.concatenate(([0], np.cumsum(n)))
    data = flat[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])].tobytes()
    at = (4 * ends[cuts]).tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _by_words(spec: dict) -> bool:
    """Whether the file is the word-level BPE that ``Encoder`` knows: NFC, white space and case first, then its splitter and byte level."""
    steps = lambda x, key: [(s["type"], s.get("pattern", {}).get("Regex")) for s in (x or {}).get(key, [])]
    splitter = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return steps(spec["normalizer"], "normalizers") == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and steps(spec["pre_tokenizer"], "pretokenizers") == [("Split", splitter), ("ByteLevel", None)]


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE's characters: printable Latin-1 ones stand for themselves, the others for U+0100 onwards in order."""
    out, n = {}, 0
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            out[b] = 256 + n
            n += 1
    return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def compress(ids: np.ndarray, starts: np.ndarray, least: int = MIN_COUNT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(terminals' bound, rules [r, 2], symbols, first symbol of each document) for documents that start at ``starts``.

    Rounds go on until no pair of neighbours occurs ``least`` times.  A pair's count changes only where a neighbour was
    replaced, so after the first round only the pairs with a new symbol are counted, and those that were frequent and
    lost their places to others.
    """
    bound, n = int(ids.max()) + 1 if len(ids) else 1, len(ids)
    sym = np.append(ids.astype(np.uint32), np.uint32(0))
    # neighbours of living symbols; n is no symbol
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[starts[1:] - 1], before[starts] = n, n
    after[n - 1 if n else 0 :] = n
    alive = np.ones(n, bool)
    rules: list[np.ndarray] = []
    n_rules = 0
    act, fresh = np.flatnonzero(after[:n] < n).astype(np.int32), True
    while len(act) >= least:
        narrow = bound + n_rules <= 1 << 16
        one, two = (sym[:n], sym[1:]) if fresh else (sym[act], sym[after[act]])
        pair = (one << np.uint32(16)) | two if narrow else (one.astype(U) << U(32)) | two
        pair, fresh = pair[act] if fresh else pair, False
        order = np.sort(pair)
        edge = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        count = np.diff(np.append(edge, len(order)))
        good = np.flatnonzero(count >= least)
        if not len(good):
            break
        keys = order[edge[good[np.argsort(-count[good], kind="stable")]]]  # most frequent first
        # one slot a key in a table of about eight slots a key; of keys in one slot the most frequent stays, the others wait
        bits = max(10, int(8 * len(keys)).bit_length())
        slot = (lambda k: (k * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)) if narrow else (lambda k: (k * U(0x9E3779B97F4A7C15)) >> U(64 - bits))
        table, slots = np.full(1 << bits, -1, np.int32), slot(keys)
        table[slots[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        rank = table[slot(pair)]
        maybe = np.flatnonzero(rank >= 0)
        act, pair, rank = act[maybe], pair[maybe], rank[maybe]
        match = np.flatnonzero(keys[rank] == pair)
        won = match[_choose(act[match], rank[match], after)]
        # a rule that is left with few places isn't worth its own; the most frequent pair keeps at least half
        places = np.bincount(rank[won], minlength=len(keys))
        used = places >= least // 2
        won = won[used[rank[won]]]
        number = (np.cumsum(used) - 1).astype(np.uint32)
        own = keys[used]
        shift = 16 if narrow else 32
        rules.append(np.stack([own >> own.dtype.type(shift), own & own.dtype.type((1 << shift) - 1)], 1).astype(np.int64))
        at = act[won]
        gone = after[at]
        sym[at] = np.uint32(bound + n_rules) + number[rank[won]]
        alive[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        n_rules += len(own)
        # what is counted next: pairs with a new symbol, and those of this round's slots that nothing has touched
        changed = np.zeros(n + 1, bool)
        changed[at] = changed[gone] = True
        left = act[~changed[act]]
        left = left[~changed[after[left]]]
        changed[:] = False
        changed[at] = changed[before[at]] = changed[left] = True
        act = np.flatnonzero(changed[:n]).astype(np.int32)
        act = act[after[act] < n]
    number = np.cumsum(alive) - 1
    return bound, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), sym[:n][alive].astype(np.int64), number[starts] if n else np.zeros(0, np.int64)


def _choose(at: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Indexes of non-overlapping ones of the matches at their places: local minima of rank first, then what they leave, left to right."""
    out, own = [], np.arange(len(at), dtype=np.int32)
    for _ in range(3):
        if not len(own):
            break
        a, r = (at, rank) if len(own) == len(at) else (at[own], rank[own])
        left = np.concatenate(([False], after[a[:-1]] == a[1:]))
        right = np.concatenate((left[1:], [False]))
        before, next_ = np.concatenate((r[:1], r[:-1])), np.concatenate((r[1:], r[:1]))
        win = (~left | (r < before)) & (~right | (r <= next_))
        out.append(own[win])
        shadow = np.zeros(len(own), bool)
        shadow[1:] |= win[:-1] & left[1:]
        shadow[:-1] |= win[1:] & right[:-1]
        own = own[~win & ~shadow]
    if len(own):  # runs of one rank: every other match
        a = at[own]
        start = np.concatenate(([True], after[a[:-1]] != a[1:]))
        run = np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))
        out.append(own[(np.arange(len(own)) - run) % 2 == 0])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int32)


def expansions(bound: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, begins, ids): rule r expands to ids[begins[r]:begins[r] + lengths[r]].

    Rules are done in waves, each with those whose two symbols are terminals or done; ValueError for a cycle.
    """
    n = len(rules)
    lengths, begins, flat, total = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, np.uint32)], 0
    left = np.arange(n)
    while len(left):
        inner = np.maximum(rules[left] - bound, 0)
        ready = ((rules[left] < bound) | (lengths[inner] > 0)).all(1)
        if not ready.any():
            raise ValueError("rules refer to each other")
        own = left[ready]
        sizes = np.where(rules[own] < bound, 1, lengths[np.maximum(rules[own] - bound, 0)]).sum(1)
        made = expand(rules[own].ravel(), bound, lengths, begins, np.concatenate(flat))
        lengths[own], begins[own] = sizes, total + np.cumsum(sizes) - sizes
        flat.append(made)
        total += len(made)
        left = left[~ready]
    return lengths, begins, np.concatenate(flat)


def expand(sym: np.ndarray, bound: int, lengths: np.ndarray, begins: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids of a run of symbols."""
    rule = np.flatnonzero(sym >= bound)
    own = sym[rule] - bound
    size_of = np.ones(len(sym), np.int64)
    size_of[rule] = lengths[own]
    begin = np.cumsum(size_of) - size_of
    out = np.repeat(sym.astype("<u4"), size_of)
    n = size_of[rule]
    # positions in out and in flat of all ids that come from rules
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(begin[rule], n) + step] = flat[np.repeat(begins[own], n) + step]
    return out


def pack(sym: np.ndarray, bits: int) -> bytes:
    """Symbols in ``bits`` bits each, low bits first."""
    if bits == 16:
        return sym.astype("<u2").tobytes()
    out = []
    for lo in range(0, len(sym), 1 << 18):
        b = np.ascontiguousarray(sym[lo : lo + (1 << 18)].astype("<u4")).view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(b, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, first: int, n: int, bits: int) -> np.ndarray:
    """n symbols from the first-th on."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, 2 * first).astype(np.int64)
    lo, hi = first * bits // 8, -(-(first + n) * bits // 8)
    raw = np.unpackbits(np.frombuffer(data, np.uint8)[lo:hi], bitorder="little")[first * bits - lo * 8 :][: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = raw
    return np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0].astype(np.int64)


def encode_shard(doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray) -> bytes:
    bound, rules, sym, first = compress(ids, starts)
    bits = max(1, int(bound + len(rules) - 1).bit_length())
    bits = 16 if 13 <= bits <= 16 else bits  # whole bytes are read and written at once
    lengths = expansions(bound, rules)[0]
    docs = np.zeros(len(doc_ids), [("id", "<i8"), ("first", "<u4"), ("n", "<u4")])
    docs["id"], docs["first"], docs["n"] = [i or 0 for i in doc_ids], first, np.diff(np.concatenate((starts, [len(ids)])))
    docs["n"] |= np.array([NO_ID if i is None else 0 for i in doc_ids], np.uint32)
    head = _HEAD.pack(MAGIC, bound, len(rules), len(doc_ids), len(sym), bits) + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + docs.tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + pack(sym, bits)


class Shard:
    """A shard file's bytes, for whole or random reads."""

    def __init__(self, data: bytes):
        magic, self.bound, rules, docs, self.n, self.bits = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = _HEAD.size
        self.rules = np.frombuffer(data, "<u4", 2 * rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * rules
        stored = np.frombuffer(data, "<u4", rules, at)
        at += 4 * rules
        self.docs = np.frombuffer(data, [("id", "<i8"), ("first", "<u4"), ("n", "<u4")], docs, at).copy()
        self.no_id = self.docs["n"] >= NO_ID
        self.docs["n"] &= NO_ID - 1
        at += 16 * docs
        if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
            raise ValueError("the shard's tables are damaged")
        self.body = data[at + 4 :]
        self.lengths, self.begins, self.flat = expansions(self.bound, self.rules)
        if not np.array_equal(stored, self.lengths):
            raise ValueError("stored expansion lengths don't fit the rules")

    def ids(self) -> np.ndarray:
        return expand(unpack(self.body, 0, self.n, self.bits), self.bound, self.lengths, self.begins, self.flat)

    def document(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """ids begin..end-1 of the k-th document; only symbols that cover them are expanded."""
        first = int(self.docs["first"][k])
        last = int(self.docs["first"][k + 1]) if k + 1 < len(self.docs) else self.n
        sym = unpack(self.body, first, last - first, self.bits)
        ends = np.cumsum(np.where(sym >= self.bound, self.lengths[np.maximum(sym - self.bound, 0)] if len(self.lengths) else 1, 1))
        total = int(ends[-1])
        begin, end, _ = slice(begin, end).indices(total)
        if begin >= end:
            return np.zeros(0, "<u4")
        a, b = bisect_right(ends, begin), int(np.searchsorted(ends, end))
        skip = begin - (int(ends[a - 1]) if a else 0)
        return expand(sym[a : b + 1], self.bound, self.lengths, self.begins, self.flat)[skip : skip + end - begin]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Writes shards under ``path`` and returns their manifest: ``part, shard, file, bytes, n_docs, n_tokens, first_doc``.

    Null texts count as empty: only the end id.  Null ids come first.  Rows that repeat an id are
    documents of their own, in order of their text's hash.  An empty table writes no shard.
    """
    spark = docs.sparkSession
    file, scratch = tokenizer or default_tokenizer(), Scratch(spark, "repair")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = slim.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    end = struct.pack("<I", end_id)

    def run(parts):
        part_id, shard = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size_now = 0

        def flush():
            nonlocal shard, size_now
            data = np.frombuffer(b"".join(held), "<u4")
            starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in held])))[:-1].astype(np.int64)
            body = encode_shard(ids, data, starts)
            name = f"{path}/part-{part_id:06d}-{shard:05d}-{uuid.uuid4().hex}.rpair"
            write_file(name, body)
            row = pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in (part_id, shard, name, len(body), len(ids), len(data), ids[0])], names=["part", "shard", "file", "bytes", "n_docs", "n_tokens", "first_doc"])
            shard, size_now = shard + 1, 0
            ids.clear(), held.clear()
            return row

        for part in pieces(parts):
            for group in batches(zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True), 1, 1_000_000):
                for (i, _), x in zip(group, encoder(file).encode([t or "" for _, t in group]), strict=True):
                    ids.append(i), held.append(x + end)
                    size_now += len(x) // 4 + 1
                    if size_now >= SHARD_TOKENS:
                        yield flush()
        if held:
            yield flush()

    schema = "part long, shard long, file string, bytes long, n_docs long, n_tokens long, first_doc long"
    return scratch.table(dealt.mapInArrow(run, schema), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all shards before: sums inside parts, then over the parts' totals."""
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = parts.select("part", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "part").withColumn("start", F.col("inside") + F.col("before")).drop("inside", "before")


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document, decoded from the shards."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(parts):
        for part in pieces(parts):
            for file, start in zip(part["file"].to_pylist(), part["start"].to_pylist(), strict=True):
                s = Shard(read_range(file, 0, size(file)))
                flat = s.ids()
                ends = np.concatenate(([0], np.cumsum(s.docs["n"], dtype=np.int64)))
                data = memoryview(flat.tobytes())
                cols = [s.docs["id"].astype(np.int64), start + ends[:-1], np.diff(ends), np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64)]
                arrays = [pa.array(c, mask=s.no_id if j == 0 else None) for j, c in enumerate(cols)]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    files = with_starts(manifest).select("file", "start")
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, F.xxhash64("file")).mapInArrow(run, schema)


def tokens(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` (see ``write``) and reads all back; without a path the shards go when the driver's process ends."""
    path = path or Scratch(docs.sparkSession, "tokens").path("shards")
    return read(write(docs, path, **options))
