"""SentencePiece encoding and decoding with the tokenizers library as its backend.

The model file's protobuf is read here (``read_model``); normaliser, metaspace marker, scores and byte fallback
are rebuilt as a ``tokenizers.Tokenizer`` (``build``): a unigram model keeps its scores, a BPE model's scores become
the order of its merges.  Where the normaliser maps spaces to markers and nothing else, and no piece has the marker
or a line break after another character, merges can't cross those places: each distinct unit between them is normalised
and encoded once for a worker, in multithreaded batches (a text's first unit apart, as it gets the marker before it).
Other models' texts are normalised and encoded whole.  Decoding gives each piece, and each run of byte pieces, to the
rebuilt decoder once.

The ids are the rebuilt tokenizer's.  Parity: the ids of each new unit (or text) are compared with the sentencepiece
library's; those that differ are counted for each row that has them, not replaced.
"""

from __future__ import annotations

import functools
import os
import re
import string
import struct
import zlib
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cairn.llm._spark import small_batches
from cairn.llm._text import batches, pieces, settle

MARK = "▁"
#: Threads of a worker's batches, unless ``encode`` is told otherwise.
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CACHE = 200_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; a value is an int, or the bytes of a longer one."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, type
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def read_model(data: bytes) -> Model:
    out = Model()
    for n, v in _fields(data):
        if n == 1:
            f = dict(_fields(v))
            out.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif n == 2:
            f = dict(_fields(v))
            out.kind, out.byte_fallback = f.get(3, 1), bool(f.get(35, 0))
        elif n == 3:
            f = dict(_fields(v))
            out.charsmap, out.dummy_prefix, out.squeeze, out.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return out


def build(m: Model, prefix: bool = True):
    """The model as a tokenizers.Tokenizer; prefix=False: without the marker before a text, for what stands inside one."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    unk = next(i for i, (_, _, t) in enumerate(m.pieces) if t == UNKNOWN)
    if m.kind == 1:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unk, byte_fallback=m.byte_fallback))
    else:
        merges = []
        for i, (p, s, t) in enumerate(m.pieces):
            if t in (NORMAL, USER):
                merges += [(-s, i, vocab[p[:k]], vocab[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if _mergeable(m, vocab, p[:k]) and _mergeable(m, vocab, p[k:])]
        merges.sort()
        tok = Tokenizer(models.BPE(vocab, [x[4:] for x in merges], unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    users = [AddedToken(p, normalized=False) for p, _, t in m.pieces if t == USER]
    if users:
        tok.add_tokens(users)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    steps += [normalizers.Strip(), normalizers.Replace(re_squeeze(), " ")] if m.squeeze else []
    steps += [normalizers.Prepend(MARK)] if m.dummy_prefix and prefix else []
    steps += [normalizers.Replace(" ", MARK)] if m.escape else []
    tok.normalizer = normalizers.Sequence(steps)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return tok


def re_squeeze():
    from tokenizers import Regex

    return Regex(" {2,}")


def _mergeable(m: Model, vocab: dict, p: str) -> bool:
    return p in vocab and m.pieces[vocab[p]][2] in (NORMAL, USER)


def separable(m: Model) -> bool:
    """Whether units (see ``unit_pattern``) can be encoded apart."""
    texts = [p for p, _, t in m.pieces if t in (NORMAL, USER) and len(p) > 1]
    return m.kind == 2 and not m.charsmap and not m.squeeze and m.escape and not any(MARK in p.lstrip(MARK) or "\n" in p for p in texts)


UNIT = re.compile(f"\n|[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+")


def joints(m: Model) -> re.Pattern:
    """Matches between a letter and ASCII punctuation that no piece has beside a letter: no merge crosses that place."""
    texts = [p for p, _, t in m.pieces if t in (NORMAL, USER) and len(p) > 1]
    beside = {c for p in texts for x, y in zip(p, p[1:], strict=False) for c, d in ((x, y), (y, x)) if d.isalpha()}
    apart = "".join(re.escape(c) for c in string.punctuation if c not in beside and c != "_") or "\n"
    return re.compile(rf"(?<=[^\W\d_])(?=[{apart}])|(?<=[{apart}])(?=[^\W\d_])")


def _trim(cache: dict, used: set) -> None:
    """Over _CACHE entries only those of the texts at hand stay."""
    if len(cache) > _CACHE:
        held = {u: cache[u] for u in used if u in cache}
        cache.clear()
        cache.update(held)


class Codec:
    """Encodes and decodes lists of texts; ``differing`` has the units (or texts) whose ids aren't the library's.

    The number of threads holds for the process: the pool is made once, before the first batch.
    """

    def __init__(self, path: str, data: bytes | None = None, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        import sentencepiece

        self.threads = threads
        data = data if data is not None else open(path, "rb").read()
        self.model = read_model(data)
        self.units = UNIT if separable(self.model) else None
        self.joints = joints(self.model)
        self.full, self.inner = build(self.model), build(self.model, prefix=False)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        # a later normaliser message is merged into the first: this one adds no marker before a text
        self.inner_library = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a\x02\x18\x00")
        self.cache: dict[str, bytes] = {}
        self.small: dict[str, bytes] = {}
        self.differing: set[str] = set()

    def forget(self) -> None:
        """Drops the units that are held: the worker goes on to other stages."""
        self.cache.clear()
        self.small.clear()
        settle()

    def _fresh(self, texts: list[str], inner: bool = False) -> list[bytes]:
        """Ids of texts, or of units inside texts, compared with the library's."""
        tok, library = (self.inner, self.inner_library) if inner else (self.full, self.library)
        mine = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = library.encode(texts, num_threads=self.threads)
        if mine != theirs:
            self.differing.update(t for t, a, b in zip(texts, mine, theirs, strict=True) if a != b)
        flat, at, out = array("I", chain.from_iterable(mine)).tobytes(), 0, []
        for n in map(len, mine):
            out.append(flat[at : at + 4 * n])
            at += 4 * n
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """The ids of each text, as little-endian unsigned 32-bit integers; and how many of its units differ from the library's."""
        if not self.units:
            ids = [b""] * len(texts)
            full = [i for i, t in enumerate(texts) if t]
            for i, x in zip(full, self._fresh([texts[i] for i in full]), strict=True):
                ids[i] = x
            return ids, [int(t in self.differing) for t in texts]
        parts = list(map(self.units.findall, texts))
        heads = {p[0] for p in parts if p}
        firsts = dict(zip(heads, self._fresh(list(heads)), strict=True))
        parts = [p[1:] for p in parts]
        cache, small = self.cache, self.small
        every = set().union(*parts)
        _trim(cache, every)
        new = [u for u in every if u not in cache]
        split = list(map(self.joints.split, new))
        every = set().union(*split)
        _trim(small, every)
        fresh = [u for u in every if u not in small]
        for lo in range(0, len(fresh), 20_000):
            some = fresh[lo : lo + 20_000]
            small.update(zip(some, self._fresh(some, inner=True), strict=True))
        cache.update([(u, small[u] if len(p) == 1 else b"".join([small[x] for x in p])) for u, p in zip(new, split, strict=True)])
        heads = [h.group() if (h := self.units.match(t)) else "" for t in texts]
        bad = [0] * len(texts)
        if self.differing:
            bad = [int(h in self.differing) + sum(not self.differing.isdisjoint(self.joints.split(u)) for u in p) for h, p in zip(heads, parts, strict=True)]
        return [b"".join([firsts[h], *map(cache.__getitem__, p)]) if h else b"" for h, p in zip(heads, parts, strict=True)], bad

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts, by the rebuilt decoder.  Ids that the model hasn't are a ValueError."""
        plain, high = self._pieces
        drop = self.model.dummy_prefix
        out = []
        for x in ids:
            own = np.frombuffer(x, "<u4")
            if len(own) and own.max() >= len(plain):
                raise ValueError("an id that the model hasn't")
            if high[own].any():  # runs of byte pieces that make characters together
                edge = np.flatnonzero(np.diff(self._is_byte[own], prepend=-1))
                runs = [own[a:b].tolist() for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(own)], strict=True)]
                text = "".join([self._bytes(tuple(r)) if self._is_byte[r[0]] else "".join(map(plain.__getitem__, r)) for r in runs])
            else:
                text = "".join(map(plain.__getitem__, own.tolist()))
            out.append(text[1:] if drop and text[:1] == " " else text)
        return out

    def _decoded(self, pieces: list[str]) -> str:
        """What the rebuilt decoder makes of pieces that don't begin a text."""
        return self.full.decoder.decode(["x", *pieces])[1:]

    def _bytes(self, ids: tuple[int, ...]) -> str:
        if ids not in self._runs:
            if len(self._runs) > _CACHE:
                self._runs.clear()
            self._runs[ids] = self._decoded([self.model.pieces[i][0] for i in ids])
        return self._runs[ids]

    @functools.cached_property
    def _runs(self) -> dict[tuple[int, ...], str]:
        return {}

    @functools.cached_property
    def _is_byte(self) -> np.ndarray:
        return np.array([t == BYTE for _, _, t in self.model.pieces], np.int8)

    @functools.cached_property
    def _pieces(self) -> tuple[list[str], np.ndarray]:
        """The text of each piece, and whether it is a byte that makes no character alone; control pieces have none."""
        texts = ["" if t == CONTROL else self._decoded([p]) for p, _, t in self.model.pieces]
        return texts, np.array([t == BYTE and int(p[3:5], 16) > 127 for p, _, t in self.model.pieces])


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = THREADS) -> Codec:
    """One for a worker process."""
    if (path, threads) not in _codecs:
        _codecs[path, threads] = Codec(path, threads=threads)
    return _codecs[path, threads]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, threads: int = THREADS) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_crc32, decoded, round_trip, differing`` for every row.

    A null or empty text has no ids and decodes to an empty text.  round_trip: decoding gives the text (a null one
    counts as empty; a literal marker character comes back as a space, as in the library).  differing: units of the
    row's text whose ids differ from the sentencepiece library's; the rebuilt tokenizer's are given.
    ``threads``: of a worker's batches.  The model's path must exist on each worker.
    """
    path = model or default_model()
    small_batches(docs.sparkSession)

    def run(parts):
        own = codec(path, threads)
        for part in pieces(parts):
            for group in batches(zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True), 1, 700_000):
                texts = [t or "" for _, t in group]
                ids, bad = own.encode(texts)
                back = own.decode(ids)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in group], pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array(back, pa.string()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()), pa.array(bad, pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_crc32", "decoded", "round_trip", "differing"],
                )
        own.forget()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, decoded string, round_trip boolean, differing long")


def decode(rows: DataFrame, ids_col: str = "ids", model: str | None = None, out_col: str = "decoded") -> DataFrame:
    """All rows and columns with the text of an array of ids; null for null, empty for an empty array."""
    path, rows = model or default_model(), rows.drop(out_col)
    at, names = rows.columns.index(ids_col), [*rows.columns, out_col]

    def run(parts):
        for part in pieces(parts):
            ids = part.column(at).to_pylist()
            texts = iter(codec(path).decode([np.asarray(x, "<u4").tobytes() for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else next(texts) for x in ids], pa.string())], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))
