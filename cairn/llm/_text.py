"""Words and shingles of many texts at once, as numpy arrays.

A word is a maximal run of letters, marks and digits (Unicode categories L, M, N) of the lower-cased text.
Word hashes come from one prefix sum over all characters, so that no Python loop runs over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _inside(kinds: str) -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)), bool, 0x110000)


@functools.cache
def char_codes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=U) * U(_BASE))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, U)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base][:n]


def settle() -> None:
    """Gives memory that Arrow and malloc hold unused back to the system: workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(parts: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a task's batches, so that Python objects of few rows exist at once; then ``settle``."""
    try:
        for part in parts:
            for lo in range(0, part.num_rows, rows):
                yield part.slice(lo, rows)
    finally:
        settle()


def batches(rows: Iterator[tuple], text_at: int, chars: int = 600_000) -> Iterator[list[tuple]]:
    """Groups rows so that each group has about so many characters; a longer text is a group by itself."""
    held, size = [], 0
    for row in rows:
        n = len(row[text_at] or "")
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


class Words:
    """``hash`` and ``doc`` (index of its text) of every word; ``first[i]:first[i+1]`` are the words of text i.

    ``kinds``: the Unicode categories that make words.
    """

    def __init__(self, texts: list[str | None], kinds: str = "LMN"):
        low = [(t or "").lower() for t in texts]
        inside, code = _inside(kinds), char_codes()
        self.cp = cp = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.diff(np.concatenate(([False], inside[cp], [False])).view(np.int8))
        self.low = low
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(cp) + 1, U)
        np.cumsum(code[cp] * _power(_BASE, len(cp)), out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _power(_INV, len(cp) + 1)[self.start] + (self.end - self.start).astype(U))
        self.offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(low)), np.diff(self.first))

    def text(self, doc: int, lo: int, hi: int) -> list[str]:
        """The words lo..hi-1 (counted over all texts) of one text."""
        at = self.offset[doc]
        return [self.low[doc][s - at : e - at] for s, e in zip(self.start[lo:hi], self.end[lo:hi], strict=True)]


def join_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; its length is len(h) - k + 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _STEP + h[j : j + n]
    return mix(out)


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text.

    A text of 1 to k-1 words has one shingle, made of all its words; a text without words has none.
    """
    every = join_hash(w.hash, k)
    out = []
    for i in range(len(w.low)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif b > a:
            out.append(join_hash(w.hash[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out
