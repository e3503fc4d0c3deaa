"""Language ID with a linear-chain conditional random field over words.

A word (a run of letters of the lower-cased text) has character n-grams of one to four, those at its ends marked
(its affixes), and lexicon features: which languages' lexicons have it.  Emission weights and transitions are
learned together by exact gradients from forward-backward.  Training sequences join pieces of documents of
different languages, so that transitions learn what code-switched text needs.  A document's language is the one
with the largest sum of word marginals; its score is that sum by the number of words.

Forward-backward runs over all texts of a batch at once: texts are cut into columns of STEP words, a column's
product of transition and emission matrices carries the state across it, and only columns are walked in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from cairn.llm._spark import small_batches
from cairn.llm._text import U, Words, batches, char_codes, mix, pieces

STEP = 64
BUCKETS = 1 << 17
#: The training sample: at most so many documents of a language, and of all; documents of more characters come last, one of them at most.
TRAIN_DOCS, TRAIN_ALL, TRAIN_CHARS = 120, 6000, 20_000
_CACHE = 150_000
#: Words whose features are made at once.
_SLICE = 10_000


def word_features(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words cp[start:end], and where each word's begin."""
    size = end - start + 2
    at = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(size)), size)
    pos = np.arange(at[-1]) - at[word]
    codes = char_codes()
    v = codes[cp[np.clip(start[word] + pos - 1, 0, len(cp) - 1)]]
    v[pos == 0], v[pos == size[word] - 1] = U(11), U(13)
    feats, owner, h = [], [], np.zeros(len(v), U)
    for n in range(1, 5):
        k = len(v) - n + 1
        if k <= 0:
            break
        h = h[:k] * U(0x100000001B3) + v[n - 1 :]
        ok = pos[:k] + n <= size[word[:k]]
        if n == 1:
            ok &= (pos[:k] > 0) & (pos[:k] < size[word[:k]] - 1)
        feats.append((mix(h[ok] + U(n)) % U(BUCKETS)).astype(np.int32))
        owner.append(word[:k][ok])
    feats, owner = np.concatenate(feats), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return feats[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


class Crf:
    """``langs`` in order; emission weights ``w`` [buckets, L], lexicon weights ``lex`` [L, L], transitions ``t`` [L, L] (logs)."""

    def __init__(self, langs: list[str], w, lex, t, lex_keys, lex_bits):
        self.langs, self.w, self.lex, self.t, self.lex_keys, self.lex_bits = langs, w, lex, t, lex_keys, lex_bits
        self._rows: dict[int, int] = {}
        self._table = np.zeros((0, len(langs)), np.float32)

    def __getstate__(self):
        return {**self.__dict__, "_rows": {}, "_table": np.zeros((0, len(self.langs)), np.float32)}

    def forget(self) -> None:
        """Drops the emissions that are held for words seen before."""
        self._rows, self._table = {}, self._table[:0].copy()

    def lexicon(self, hashes: np.ndarray) -> np.ndarray:
        """0/1 [words, L]."""
        if not len(self.lex_keys):
            return np.zeros((len(hashes), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.lex_keys, hashes), len(self.lex_keys) - 1)
        return self.lex_bits[at] * (self.lex_keys[at] == hashes)[:, None]

    def _score(self, words: Words, at: np.ndarray) -> np.ndarray:
        feats, first = word_features(words.cp, words.start[at], words.end[at])
        return np.add.reduceat(self.w[feats], first[:-1], axis=0) + self.lexicon(words.hash[at]) @ self.lex

    def emissions(self, words: Words) -> np.ndarray:
        """exp of the emission scores [words, L], each scaled so that its largest is 1."""
        keys, at, inv = np.unique(words.hash, return_index=True, return_inverse=True)
        keys = keys.tolist()
        new = [i for i, k in enumerate(keys) if k not in self._rows]
        if new:
            if len(self._rows) + len(new) > _CACHE:
                self._rows, self._table, new = {}, self._table[:0], list(range(len(keys)))
            s = np.concatenate([self._score(words, at[new[i : i + _SLICE]]) for i in range(0, len(new), _SLICE)])
            self._rows.update(zip([keys[i] for i in new], range(len(self._table), len(self._table) + len(new)), strict=True))
            self._table = np.concatenate([self._table, np.exp(np.maximum(s - s.max(1, keepdims=True), -30)).astype(np.float32)])
        rows = np.fromiter(map(self._rows.__getitem__, keys), np.int64, len(keys))
        return self._table[rows[inv]]

    def marginals(self, words: Words) -> np.ndarray:
        """P(language of a word | its text) [words, L]."""
        return forward_backward(self.emissions(words), words.first, np.exp(self.t - self.t.max()).astype(np.float32))


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-30)


def forward_backward(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Marginals of all texts: e [words, L] emission factors, text i has words first[i]:first[i+1], t [L, L] transition factors.

    Before a text's first word all languages are as likely.
    """
    n, size = e.shape[1], np.diff(first)
    cols = -(-size // STEP)
    col_text = np.repeat(np.arange(len(size)), cols)
    col_at = np.arange(cols.sum()) - np.repeat(np.cumsum(cols) - cols, cols)
    begin = first[:-1][col_text] + col_at * STEP
    width = np.minimum(STEP, size[col_text] - col_at * STEP)
    order = np.argsort(-width, kind="stable")
    begin, width, rank = begin[order], width[order], np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    live = [int(np.searchsorted(-width, -c, "left")) for c in range(STEP)]  # columns of more than c words
    grid = np.zeros((len(order), n), np.float32) + 1.0 / n
    after = np.ones((len(order), n), np.float32)
    many = np.flatnonzero(cols > 1)
    if len(many):
        m = np.tile(np.eye(n, dtype=np.float32), (len(order), 1, 1))
        for c in range(STEP):
            k = live[c]
            p = (m[:k].reshape(-1, n) @ t).reshape(k, n, n) * e[begin[:k] + c][:, None, :]
            m[:k] = p / np.maximum(p.sum((1, 2), keepdims=True), 1e-30)
        base = np.cumsum(cols) - cols
        many = many[np.argsort(-cols[many], kind="stable")]
        for j in range(1, int(cols[many].max())):
            own = many[cols[many] > j]
            prev, cur = rank[base[own] + j - 1], rank[base[own] + j]
            grid[cur] = _norm(np.einsum("ij,ijk->ik", grid[prev], m[prev]))
        for j in range(int(cols[many].max()) - 2, -1, -1):
            own = many[cols[many] > j + 1]
            cur, nxt = rank[base[own] + j], rank[base[own] + j + 1]
            after[cur] = _norm(np.einsum("ijk,ik->ij", m[nxt], after[nxt]))
    alpha = np.empty_like(e)
    a = grid
    for c in range(STEP):
        k = live[c]
        a[:k] = _norm((a[:k] @ t) * e[begin[:k] + c])
        alpha[begin[:k] + c] = a[:k]
    b = after
    for c in range(STEP - 1, -1, -1):
        k = live[c]
        at = begin[:k] + c
        alpha[at] *= b[:k]
        b[:k] = _norm((b[:k] * e[at]) @ t.T)
    return _norm(alpha)


def fit(rows: list[tuple[str, str]], rounds: int = 40, seed: int = 7) -> Crf | None:
    """rows: (text, language).  Adam on the exact CRF likelihood of spliced sequences."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    n, label = len(langs), {lang: i for i, lang in enumerate(langs)}
    words = Words([t for t, _ in rows], "L")
    if not len(words.hash):
        return None
    y = np.array([label[lang] for _, lang in rows])[words.doc]
    keys, at, inv = np.unique(words.hash, return_index=True, return_inverse=True)
    # lexicons: words seen three times or more in a language, and there more often than evenly
    counts = np.zeros((len(keys), n))
    np.add.at(counts, (inv, y), 1)
    rate = counts / np.maximum(counts.sum(0), 1)
    bits = (counts >= 3) & (rate > 1.5 * rate.mean(1, keepdims=True) if n > 1 else counts >= 3)
    have = bits.any(1)
    model = Crf(langs, np.zeros((BUCKETS, n), np.float32), np.zeros((n, n), np.float32), np.zeros((n, n), np.float32), keys[have], bits[have].astype(np.float32))
    if n == 1:
        return model
    feats, ptr = word_features(words.cp, words.start[at], words.end[at])
    owner = np.repeat(np.arange(len(keys)), np.diff(ptr))
    in_lex = model.lexicon(keys)
    rng = np.random.default_rng(seed)
    # sequences of STEP words, spliced from pieces of 8 to 40 words so that languages take turns
    starts = [(a, b) for a, b in zip(words.first[:-1], words.first[1:], strict=True) if b > a]
    pieces = []
    for a, b in starts:
        while a < b:
            m = int(rng.integers(8, 41))
            pieces.append(np.arange(a, min(a + m, b)))
            a += m
    order = np.arange(len(pieces))
    for i in rng.permutation(len(pieces) // 2) * 2:  # about a quarter of the joints switch
        if rng.random() < 0.25:
            j = int(rng.integers(len(pieces)))
            order[i], order[j] = order[j], order[i]
    flat = np.concatenate([pieces[i] for i in order])
    flat = flat[: max(1, len(flat) // STEP) * STEP]
    first = np.arange(0, len(flat) + 1, STEP) if len(flat) >= STEP else np.array([0, len(flat)])
    wid, yy = inv[flat], y[flat]
    gold = np.zeros((n, n))
    inner = np.ones(len(flat), bool)
    inner[first[:-1]] = False
    nxt = np.flatnonzero(inner)
    np.add.at(gold, (yy[nxt - 1], yy[nxt]), 1)
    target = np.zeros((len(keys), n))
    np.add.at(target, (wid, yy), 1)
    params = [model.w, model.lex, model.t]
    mom, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        s = np.add.reduceat(model.w[feats], ptr[:-1], axis=0) + in_lex @ model.lex
        s = np.exp(np.maximum(s - s.max(1, keepdims=True), -30)).astype(np.float32)
        e, t = s[wid], np.exp(model.t - model.t.max()).astype(np.float32)
        gamma, pair = _expected(e, first, t)
        soft = np.stack([np.bincount(wid, gamma[:, j], len(keys)) for j in range(n)], 1)
        g = ((target - soft) / len(flat)).astype(np.float32)
        gw = np.stack([np.bincount(feats, g[owner, j], BUCKETS) for j in range(n)], 1) - 1e-6 * model.w
        grads = [gw, in_lex.T @ g, (gold - pair) / len(flat) - 1e-6 * model.t]
        for i, (p, d) in enumerate(zip(params, grads, strict=True)):
            mom[i] = 0.9 * mom[i] + 0.1 * d
            var[i] = 0.99 * var[i] + 0.01 * d * d
            p += (0.1 * (mom[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _expected(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transition counts of sequences of one length."""
    n, length = e.shape[1], int(first[1] - first[0])
    e = e.reshape(-1, length, n)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = np.full((len(e), n), 1.0 / n, np.float32)
    for c in range(length):
        a = _norm((a @ t) * e[:, c])
        alpha[:, c] = a
    pair = np.zeros((n, n))
    for c in range(length - 1, 0, -1):
        right = e[:, c] * beta[:, c]
        z = np.einsum("ni,ij,nj->n", alpha[:, c - 1], t, right)
        pair += np.einsum("ni,nj->ij", alpha[:, c - 1] / np.maximum(z, 1e-30)[:, None], right) * t
        beta[:, c - 1] = _norm(right @ t.T)
    return _norm(alpha * beta).reshape(-1, n), pair


def predict(model: Crf | None, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
    """(language, score, words, runs of words labelled alike) of each text."""
    words = Words(texts, "L")
    if model is None or not len(words.hash):
        return [("und", 0.0, int(b - a), 0) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    g = model.marginals(words)
    total = np.concatenate((np.zeros((1, g.shape[1])), np.cumsum(g, axis=0, dtype=np.float64)))
    sums, size = total[words.first[1:]] - total[words.first[:-1]], np.diff(words.first)
    best = sums.argmax(1)
    label = g.argmax(1)
    turn = np.concatenate(([0], np.cumsum(np.concatenate(([0], (label[1:] != label[:-1]) & (words.doc[1:] == words.doc[:-1]))))))
    runs = turn[words.first[1:]] - turn[words.first[:-1]] + 1
    return [(model.langs[b], min(1.0, max(0.0, float(s[b] / k))), int(k), int(r)) if k else ("und", 0.0, 0, 0) for b, s, k, r in zip(best, sums, size, runs, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Crf | None:
    """Fits on whole texts of at most ``max_docs`` documents of each language, and TRAIN_ALL of all (but one of each language).

    Those of at most ``max_chars`` characters with the smallest hash of their id are taken; a longer one only where a
    language has no other, the one of smallest hash.  Only documents with crc32(id as text) mod 4 other than 2, a
    text and a language take part.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    own = own.where("text is not null and lang is not null and lang <> 'und' and crc32(cast(id as string)) % 4 <> 2").withColumn("long", F.length("text") > max_chars)
    # ids, and a hash that tells rows of one id apart, are ranked; each task passes on at most max_docs of a language
    keys = own.select("id", "lang", "long", F.xxhash64("text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("id"), "id", "h"))
    first = keys.withColumn("rank", rank).where(F.col("rank") <= max_docs).where("not long or rank = 1").collect()
    if not first:
        return None
    most = max(1, TRAIN_ALL // len({r.lang for r in first}))
    chosen = {(r.id, r.lang, r.h) for r in first if r["rank"] <= most}
    rows = own.where(F.col("id").isin(sorted({i for i, _, _ in chosen}))).select("id", "text", "lang", F.xxhash64("text").alias("h"))
    picked = docs.sparkSession.createDataFrame(sorted(chosen), "id long, lang string, h long")
    rows = rows.join(F.broadcast(picked), ["id", "lang", "h"], "left_semi").dropDuplicates(["id", "lang", "h"]).orderBy("id", "lang", "h").collect()
    return fit([(r.text, r.lang) for r in rows])


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred, score, n_words, n_runs`` (replaced where they exist).

    Null texts and texts without a letter give ``und`` and 0; so does every text if there is no model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "n_words", "n_runs")
    at = docs.columns.index(text_col)
    names = [*docs.columns, "lang_pred", "score", "n_words", "n_runs"]

    def run(parts):
        for part in pieces(parts):
            out = []
            for group in batches([(t,) for t in part.column(at).cast(pa.string()).to_pylist()], 0, 500_000):
                out += predict(shared.value, [t for (t,) in group])
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))], names=names)
        if shared.value is not None:
            shared.value.forget()  # the worker goes on to other stages

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_runs", T.LongType())])
    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains and predicts: ``doc_id, held_out, lang_pred, score, n_words, n_runs`` for every row; held_out is false where the id is null."""
    model = train(docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = identify(slim, model, "doc_id", "text")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_runs")
