"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Features are k-word shingles (k = 5, or all words of a shorter item); a shingle's weight is the number of
characters of its words.  The similarity of a window and an item is the weighted Jaccard of their shingle
multisets, ``sum(len * min(counts)) / sum(len * max(counts))``.

A window that shares no shingle with an item has similarity 0, so only windows that cover a benchmark shingle
are fingerprinted (an exact filter).  Fingerprints have 64 bits in 8 blocks; for each block, items are kept sorted by
its value, and a window probes the values within two bits of its own: by the pigeonhole principle this finds every
fingerprint within 23 bits.  Two texts of similarity 0.8 differ in about 10 bits (standard deviation 3).  Of
those, only pairs whose hits weigh enough to reach the threshold (prefix sums over the hits of an item bound what it can
share with a window) are verified on their words, and not where another window is known to be more alike.  An index is
a few arrays; windows are searched in steps of at most PAIRS probed pairs, hits are dealt in steps of about HITS.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm._spark import small_batches
from cairn.llm._text import U, Words, batches, join_hash, pieces

#: The benchmark is read in blocks of so many characters; only a block is sent to the executors at once.
BLOCK_CHARS = 8 << 20
RADIUS, BLOCKS, NEAR = 23, 8, 2
#: Window and item pairs that a step of the search probes, windows that are fingerprinted at once, and items whose shingles a worker holds.
PAIRS, WINDOWS, HELD = 1 << 17, 4096, 2000
#: Pairs of a shingle in a text and an item that has it, held at once.
HITS = 1 << 20

#: For each value of a block, those within NEAR bits of it.
_NEAR = np.array([[v for v in range(256) if (u ^ v).bit_count() <= NEAR] for u in range(256)], np.int64)


def item_words(text: str | None) -> list[str]:
    w = Words([text])
    return w.text(0, 0, len(w.start))


def shingles(words: list[str], k: int) -> Counter:
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def weight(shingle: tuple) -> int:
    return sum(map(len, shingle))


def similarity(a: Counter, b: Counter) -> float:
    both = sum(weight(s) * min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(weight(s) * n for s, n in a.items()) + sum(weight(s) * n for s, n in b.items())
    return both / (total - both) if total > both else 1.0


def simhash(hashes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints, as [windows, 8] bytes, of all runs of ``size`` shingles."""
    signs = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    total = np.zeros((len(hashes) + 1, 64), np.int64)
    np.cumsum(signs * weights[:, None], axis=0, out=total[1:])
    return np.packbits(total[size:] - total[:-size] > 0, axis=1)


class Index:
    """Items of one (words, k): their words, fingerprints, and for each block the items sorted by its value."""

    def __init__(self, size: int, k: int, items: list[tuple[int, str]], prints: np.ndarray):
        self.size, self.k = size, k
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.prints = prints.view(U)[:, 0]
        self.weights = np.array([sum(len(x) * min(j + 1, k, size - j, size - k + 1) for j, x in enumerate(w.split(" "))) for _, w in items], np.int64)
        self.order, self.begin = [], []
        for b in range(BLOCKS):
            self.order.append(np.argsort(prints[:, b], kind="stable").astype(np.int32))
            self.begin.append(np.searchsorted(prints[self.order[b], b], np.arange(257)))
        self._sets: dict[int, Counter] = {}

    def __getstate__(self):
        return {**self.__dict__, "_sets": {}}

    def shingles(self, item: int) -> Counter:
        if item not in self._sets:
            if len(self._sets) >= HELD:
                self._sets.clear()
            self._sets[item] = shingles(self.words[item].split(" "), self.k)
        return self._sets[item]

    def near(self, block: int, value: int) -> np.ndarray:
        """Items whose block is within NEAR bits of the value."""
        return np.concatenate([self.order[block][self.begin[block][v] : self.begin[block][v + 1]] for v in _NEAR[value]])

    def search(self, windows: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) index pairs within the radius, of those that ``keep(windows, items)`` says; a pair that several blocks find comes once."""
        prints = windows.view(U)[:, 0]
        found = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            order = np.argsort(windows[:, b], kind="stable")
            values, first = np.unique(windows[order, b], return_index=True)
            for value, lo, hi in zip(values.tolist(), first, [*first[1:], len(order)], strict=True):
                items = self.near(b, value)
                near = self.prints[items]
                step = max(1, PAIRS // max(1, len(items)))
                for s in range(lo, hi, step):
                    own = order[s : min(s + step, hi)]
                    w, i = np.nonzero(np.bitwise_count(prints[own][:, None] ^ near[None, :]) <= RADIUS)
                    w, i = own[w], items[i].astype(np.int64)
                    if keep is not None:
                        good = keep(w, i)
                        w, i = w[good], i[good]
                    found.append(w * len(self.ids) + i)
        return np.divmod(np.unique(np.concatenate(found)), len(self.ids))


def _hashed(w: Words, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the shingles of words lo..hi-1."""
    lens = np.concatenate(([0], np.cumsum(w.end[lo:hi] - w.start[lo:hi])))
    return join_hash(w.hash[lo:hi], k), lens[k:] - lens[:-k]


def build(items: list[tuple[int, str | None]], k: int) -> tuple[list[Index], dict]:
    """Indexes by item size; and for each shingle length the sorted hashes, the index and number of the items that have each (as arrays cut at ``begin``), and a bit table."""
    by = defaultdict(list)
    for i, text in items:
        if words := item_words(text):
            by[len(words), min(k, len(words))].append((i, " ".join(words)))
    indexes, postings = [], defaultdict(list)
    for at, ((n, kk), own) in enumerate(sorted(by.items())):
        prints, seen = [], []
        for lo in range(0, len(own), 256):
            w = Words([t for _, t in own[lo : lo + 256]])
            for j in range(len(own[lo : lo + 256])):
                h, lens = _hashed(w, kk, int(w.first[j]), int(w.first[j + 1]))
                prints.append(simhash(h, lens, n - kk + 1)[0])
                seen.append(np.unique(h))
        indexes.append(Index(n, kk, own, np.array(prints, np.uint8)))
        postings[kk].append((at, np.repeat(np.arange(len(seen), dtype=np.int32), [len(h) for h in seen]), np.concatenate(seen)))
    lookup = {}
    for kk, own in postings.items():
        every = np.concatenate([h for _, _, h in own])
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.array([at for at, _, _ in own], np.int32), [len(h) for _, _, h in own])[order]
        item = np.concatenate([i for _, i, _ in own])[order]
        keys, begin = np.unique(every[order], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[keys >> U(44)] = True
        lookup[kk] = keys, np.append(begin, len(every)), owner, item, bits
    return indexes, lookup


def _find(shared, threshold: float):
    def run(parts):
        indexes, lookup = shared.value
        for part in pieces(parts):
            out = []
            for group in batches(zip(part["id"].to_pylist(), part["text_md5"].to_pylist(), part["text"].to_pylist(), strict=True), 2):
                out += find([t for _, _, t in group], indexes, lookup, threshold, [(i, m) for i, m, _ in group])
            cols = list(zip(*[(*key, *rest) for key, *rest in out], strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                names=["doc_id", "text_md5", "item_id", "start_word", "n_words", "similarity"],
            )

    return run


def find(texts: list, indexes: list[Index], lookup: dict, threshold: float, ids: list) -> list[tuple]:
    """(id, item, first word, words, similarity) of the best window of each text and item that reach the threshold."""
    w, out = Words(texts), {}
    share = threshold / (1 + threshold)
    for k, (keys, begin, owners, numbers, bits) in lookup.items():
        every = join_hash(w.hash, k)
        at = np.flatnonzero(bits[every >> U(44)])
        at = at[w.doc[at] == w.doc[at + k - 1]]
        key = np.searchsorted(keys, every[at])
        ok = key < len(keys)
        ok[ok] = keys[key[ok]] == every[at[ok]]
        at, key = at[ok], key[ok]
        n = begin[key + 1] - begin[key]
        lengths = np.concatenate(([0], np.cumsum(w.end - w.start)))
        most = max((x.size for x in indexes if x.k == k), default=k) - k
        # windows by ranges of their starts, so that about HITS pairs of a hit and an item are there at once
        cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), HITS)))
        for a, b in zip([0, *at[cuts[1:]].tolist()], [*at[cuts[1:]].tolist(), len(w.hash)], strict=True):
            lo_hit, hi_hit = np.searchsorted(at, [a, b + most])
            own_n = n[lo_hit:hi_hit]
            place = np.repeat(at[lo_hit:hi_hit], own_n)
            post = np.repeat(begin[key[lo_hit:hi_hit]] - np.cumsum(own_n) + own_n, own_n) + np.arange(len(place))
            order = np.lexsort(((numbers[post].astype(np.int64) << 40) + place, w.doc[place] * len(indexes) + owners[post]))
            place, owner, number = place[order], owners[post][order], numbers[post][order]
            edges = np.flatnonzero((np.diff(w.doc[place], prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(place)][: len(edges)], strict=True):
                d, own = int(w.doc[place[s]]), indexes[owner[s]]
                first, last = int(w.first[d]), int(w.first[d + 1])
                m = min(own.size, last - first)  # a text shorter than the item is one window, whole
                at_, item_at = place[s:e], number[s:e]
                hits = (item_at.astype(np.int64) << 40) + at_  # by item, then place
                weight = np.concatenate(([0], np.cumsum(lengths[at_ + k] - lengths[at_])))
                # a window shares at most its hits' weight, which must be the threshold's part of the item's
                most_shared = weight[np.searchsorted(hits, hits + m - k, "right")] - weight[:-1]
                leads = np.unique(at_[most_shared >= threshold * own.weights[item_at] - 1e-6])
                for begin_, end in _runs(leads.tolist(), m - k, max(first, a), min(last - m, b - 1)):
                    for lo in range(begin_, end + 1, WINDOWS):
                        hi = min(lo + WINDOWS - 1, end)
                        h, lens = _hashed(w, k, lo, hi + m)
                        window = np.concatenate(([0], np.cumsum(lens)))
                        window = window[m - k + 1 :] - window[: -(m - k + 1)]

                        def reach(v, i, lo=lo, back=m - k, hits=hits, weight=weight, window=window, own=own):
                            """The most weight that a window and an item can share, all their hits, and the weight of both."""
                            seek = (i << 40) + lo + v
                            return weight[np.searchsorted(hits, seek + back, "right")] - weight[np.searchsorted(hits, seek)], window[v] + own.weights[i]

                        def could(v, i, reach=reach):
                            shared, both = reach(v, i)
                            return (shared > 0) & (shared >= share * both - 1e-6)

                        found, item = own.search(simhash(h, lens, m - k + 1), could)
                        if not len(found):
                            continue
                        shared, both = reach(found, item)
                        bound = shared / np.maximum(both - shared, 1e-9)
                        held, shown = -1, Counter()
                        for v, i, most_like in zip(found.tolist(), item.tolist(), bound.tolist(), strict=True):
                            pair = (d, own.ids[i])
                            if pair in out and most_like < -out[pair][0] - 1e-9:
                                continue  # another window is more alike than this one can be
                            if v != held:
                                held, shown = v, shingles(w.text(d, lo + v, lo + v + m), k)
                            sim = similarity(shown, own.shingles(i))
                            if sim >= threshold:
                                best = (-sim, lo + v - first, m)
                                out[pair] = min(out.get(pair, best), best)
    return [(ids[d], i, start, m, -sim) for (d, i), (sim, start, m) in sorted(out.items())]


def _runs(hits: list[int], back: int, first: int, last: int):
    """Joined ranges lo..hi of window starts that cover a hit, inside first..last."""
    cur = None
    for p in hits:
        lo, hi = max(first, p - back), min(last, p)
        if lo > hi:
            continue
        if cur and lo <= cur[1] + 1:
            cur[1] = max(cur[1], hi)
        else:
            if cur:
                yield tuple(cur)
            cur = [lo, hi]
    if cur:
        yield tuple(cur)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8, by_text: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best item-sized window of each document and item, or the whole of a shorter document, that reach the threshold.

    Ties go to the window that starts first.  A text with fewer words than an item is one window, whole.  Null, empty
    and wordless texts or items match nothing; items with a null id and documents with a null id are left out, as
    nothing could name them.  Rows that repeat an id give its best match once; with ``by_text`` there is a column
    text_md5 too, and rows that share an id but not the text are told apart.  The benchmark's characters are
    counted first; over BLOCK_CHARS it is searched in blocks, each against all documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = total // BLOCK_CHARS + 1
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), (F.md5(text) if by_text else F.lit("")).alias("text_md5"), text.alias("text")).where("id is not null and text is not null")
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(build([(r.i, r.t) for r in own.collect()], k))
        found = base.mapInArrow(_find(shared, threshold), "doc_id long, text_md5 string, item_id long, start_word long, n_words long, similarity double")
        out = found if out is None else out.unionAll(found)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "n_words")).alias("best")
    key = ["doc_id", *["text_md5"] * by_text, "item_id"]
    return out.groupBy(*key).agg(best).select(*key, (-F.col("best.s")).alias("start_word"), "best.n_words", "best.similarity")
