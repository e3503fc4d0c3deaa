"""Secret scan: base rules, and a character convolutional network over every candidate in its context.

Base findings (three fixed rules) always stay.  Candidates are the tokens of base findings, and runs of eight or more of
``[A-Za-z0-9+/_.=-]`` that have a digit and a letter or change case inside.  The network sees CONTEXT characters before,
BODY characters of the candidate and CONTEXT after; a longer candidate is seen through windows every STEP characters, and
its score is the largest.  Convolutions of width 5, maxima inside and outside of the candidate, the mean inside, a hidden layer.

It is trained on all distinct labelled findings.  Positive: the tokens of base findings, and generated ones of common
shapes.  Negative: candidates of harmless kinds (``harmless``: parts of mail addresses and links, chains of words), and
generated ones.  Candidates of no known kind have no label and take no part.  Each positive also appears in the context of
a negative, so that its shape counts without its name.  The findings are dealt out to shards of about SHARD, each with
the generated ones beside them; in each round every shard goes on from the same weights, and their sums, in fixed point
so that no order matters, give the mean that the next round begins with.  All windows of one
token fall in one of four parts, by its hash: training, calibration (Platt scaling), threshold, test.  The threshold is
the one that finds RECALL of the threshold part's positives; the test part gives ``report``, with the error of calibration.
``unseen_shapes`` measures it on shapes that it wasn't trained on, each left out in turn.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm._spark import Scratch, small_batches
from cairn.llm._text import pieces

#: The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "cnn")

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
CONTEXT, BODY, STEP = 24, 48, 24
WIDTH = 2 * CONTEXT + BODY
#: About so many labelled findings are a shard, with so many generated ones of each kind.
SHARD, GENERATED = 1500, 120
RECALL, ROUNDS = 0.98, 12
#: Parts of one in the fixed point of summed weights; parts of one in the bins of logits.
FIXED, BINS = 1 << 40, 64
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base rules' findings, by start, then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


_DIGIT, _LETTER, _MIXED = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of candidates that overlap no base finding; both are in order."""
    out, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        run = m.group()
        if (_DIGIT.search(run) and _LETTER.search(run)) or _MIXED.search(run):
            while k < len(base) and base[k][0] < m.end():
                reach, k = max(reach, base[k][1]), k + 1
            if reach <= m.start():
                out.append((m.start(), m.end()))
    return out


def token_of(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """The part of a base finding that is its candidate: an assignment's value, else all."""
    if span[2] == 0 and (m := ASSIGN.match(text, span[0])):
        return m.span(2)
    return span[0], span[1]


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOWEL = re.compile(r"[aeiouy]", re.I)


_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_USER = re.compile(r"://[^\s/:@]{0,40}:$")


def account(text: str, start: int, end: int) -> bool:
    """Whether a candidate stands where a connection's address has its password: ``://name:candidate@``."""
    return text[end : end + 1] == "@" and text[start - 1 : start] == ":" and _USER.search(text[max(0, start - 44) : start]) is not None


def harmless(text: str, start: int, end: int) -> bool:
    """Whether a candidate is of a kind that is no secret: a bank account number by its check digits, beside an @ or in a link (but for the password of a connection's address), or a chain of words and short numbers."""
    run = text[start:end]
    if account(text, start, end):
        return False
    if _IBAN.fullmatch(run) and int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1:
        return True
    if text[end : end + 1] == "@" or text[max(0, start - 1) : start] == "@" or run.startswith("//") or "www." in run:
        return True
    parts = _PART.findall(run)
    words = [p for p in parts if not p.isdigit()]
    return bool(words) and sum(len(p) for p in parts if p.isdigit()) <= 6 and all(len(w) >= 3 and _VOWEL.search(w) for w in words)


def windows(text: str, start: int, end: int) -> list[str]:
    """The views of a candidate: CONTEXT + BODY + CONTEXT characters, padded with U+0000; several for a long one."""
    at = list(range(start, max(start + 1, end - BODY), STEP)) + ([end - BODY] if end - start > BODY else [])
    return [text[max(0, a - CONTEXT) : a].rjust(CONTEXT, "\0") + text[a : min(a + BODY, end)].ljust(BODY, "\0") + text[min(a + BODY, end) :][:CONTEXT].ljust(CONTEXT, "\0") for a in at]


def codes(views: list[str]) -> np.ndarray:
    """uint8 [n, WIDTH]: 0 padding, 1..95 printable ASCII, 96 other."""
    cp = np.frombuffer("".join(views).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    return np.where(cp == 0, 0, np.where((cp >= 32) & (cp < 127), cp - 31, 96)).astype(np.uint8)


SHAPES = ("hex", "upper hex", "letters and digits", "lower letters and digits", "base32", "base64", "url-safe", "prefixed", "three parts", "uuid", "groups", "password")


def iban(rng: random.Random) -> str:
    """A bank account number whose check digits hold."""
    rest = "".join(rng.choice(string.digits) for _ in range(rng.randint(14, 20)))
    country = "".join(rng.choice(string.ascii_uppercase) for _ in range(2))
    return f"{country}{98 - int(''.join(str(int(c, 36)) for c in rest + country) + '00') % 97:02d}{rest}"


def generated(seed: int = 17, n: int = GENERATED, without: str = "") -> tuple[list[str], list[str]]:
    """(secrets, harmless ones) of common shapes, n of each; the secrets of the shape ``without`` are left out."""
    rng = random.Random(seed)
    of = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    both, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = "an ba ce di en fo gu hi in jo ka le mo na or pa qui re su th un ver we xi you ing tion able ment ous".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    digits = lambda k: of(string.digits, k, k)
    secret = [
        lambda: of("0123456789abcdef", 24, 64), lambda: of("0123456789ABCDEF", 24, 40), lambda: of(both, 16, 48), lambda: of(string.ascii_lowercase + string.digits, 16, 40), lambda: of(string.ascii_uppercase + "234567", 16, 40),
        lambda: of(b64, 24, 64) + "=" * rng.randrange(3), lambda: of(both + "_-", 20, 44), lambda: rng.choice(["sk_live_", "pk-", "ghp_", "xoxb-", "key-", "AKIA"]) + of(both, 16, 36),
        lambda: ".".join(of(b64[:62] + "_-", 16, 40) for _ in range(3)), lambda: "-".join(of("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: "-".join([of(rng.choice([string.ascii_uppercase, string.ascii_lowercase]) + string.digits, k, k) for k in [rng.randint(4, 8)] for _ in range(rng.randint(3, 6))]),
        lambda: of(string.ascii_lowercase, 2, 6) + of(string.digits, 1, 3) + of(both, 5, 9) + of(string.digits, 1, 3),
    ]
    join = lambda sep, k, f=word: sep.join(f() for _ in range(k))
    plain = [
        lambda: join("", 3, lambda: word().title()), lambda: word() + join("", 2, lambda: word().title()), lambda: f"{join('_', 3)}_{rng.randrange(100)}", lambda: f"{word()}{rng.randrange(10)}.example.{rng.choice(['com', 'net', 'org'])}",
        lambda: f"{join('.', 2)}.{rng.randrange(100):02d}", lambda: f"//www.{word()}.com/{join('-', 3)}/{rng.randrange(3000)}", lambda: f"/usr/{join('/', 3)}{rng.randrange(10)}.txt", lambda: f"20{rng.randrange(100):02d}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}",
        lambda: f"{join('-', 3)}-v{rng.randrange(10)}.{rng.randrange(20)}.{rng.randrange(9)}", lambda: f"{join('/', 2)}/{word().title()}{word().title()}.java", lambda: f"{word().upper()}-{rng.randrange(10**4)}-{rng.randrange(10**4)}-{rng.randrange(10**4)}",
        lambda: iban(rng), lambda: f"+{digits(2)}-{digits(3)}-{digits(rng.randint(3, 5))}{rng.choice(['', 'x' + digits(2)])}", lambda: f"{of(string.ascii_uppercase, 2, 4)}-20{digits(2)}-{digits(rng.randint(4, 8))}", lambda: f"{rng.choice(['order', 'ref', 'no', 'inv', 'ISBN'])}{rng.choice(['.', '-', '_', ''])}{digits(rng.randint(6, 13))}",
        lambda: f"//{word()}.org/{word()}/{of('0123456789abcdef', 7, 12)}", lambda: f"{word()}{digits(rng.randint(1, 4))}", lambda: f"{word().title()}{digits(rng.randint(1, 4))}", lambda: f"{digits(rng.randint(2, 5))}{rng.choice(['kg', 'mm', 'px', 'GB', 'kWh'])}-{word()}",
    ]
    return [f() for name, f in zip(SHAPES, secret, strict=True) for _ in range(n) if name != without], [f() for f in plain for _ in range(n)]


def mails(seed: int = 19, n: int = 2 * GENERATED) -> list[tuple[str, str]]:
    """(part, window) of both parts of generated mail addresses inside text."""
    rng, out = random.Random(seed), []
    plain = generated(seed, 40)[1]
    words = [w for p in plain for w in re.findall("[a-z]{3,}", p)]
    for _ in range(n):
        left, right = rng.choice(words) + " ", " " + rng.choice(words) + " " + rng.choice(words)
        local = rng.choice(words) + rng.choice([".", "_", ""]) + rng.choice([rng.choice(words), f"{rng.randrange(100):02d}"])
        host = f"{rng.choice(['mail', 'mx', 'smtp', rng.choice(words)])}{rng.choice(['', str(rng.randrange(10))])}.{rng.choice(['example', rng.choice(words)])}.{rng.choice(['com', 'org', 'net'])}"
        text, at = f"{left}{local}@{host}{right}", len(left)
        out += [(local, windows(text, at, at + len(local))[0]), (host, windows(text, at + len(local) + 1, at + len(local) + 1 + len(host))[0])]
    return out


class Cnn:
    """Embedding 97 x E, convolution of width K to C channels, two maxima and a mean, H hidden units, one logit."""

    E, K, C, H = 8, 5, 24, 16

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.normal(size=s) * (2 / np.prod(s[:-1])) ** 0.5).astype(np.float32)
        self.p = [rng.normal(size=(97, self.E)).astype(np.float32) * 0.5, f(self.K * self.E, self.C), np.zeros(self.C, np.float32), f(3 * self.C, self.H), np.zeros(self.H, np.float32), f(self.H, 1), np.zeros(1, np.float32)]
        self.scale, self.shift, self.threshold, self.report = 1.0, 0.0, 1.0, {}
        steps = np.arange(WIDTH - self.K + 1)
        self.inner = (steps >= CONTEXT) & (steps < WIDTH - CONTEXT - self.K + 1)

    def forward(self, x: np.ndarray, keep: bool = False):
        emb, conv, cb, w1, b1, w2, b2 = self.p
        n, steps = len(x), WIDTH - self.K + 1
        e = emb[x]
        col = np.lib.stride_tricks.sliding_window_view(e, self.K, axis=1).transpose(0, 1, 3, 2).reshape(n, steps, self.K * self.E)
        z = np.maximum(col @ conv + cb, 0)
        sides = [np.flatnonzero(self.inner), np.flatnonzero(~self.inner)]
        pos = [side[z[:, side].argmax(1)] for side in sides]
        top = np.concatenate([*(np.take_along_axis(z, p[:, None, :], 1)[:, 0] for p in pos), z[:, sides[0]].mean(1)], 1)
        h = np.maximum(top @ w1 + b1, 0)
        logit = (h @ w2 + b2)[:, 0]
        return (logit, (x, col, z, top, pos, h)) if keep else logit

    def gradients(self, held, d: np.ndarray) -> list[np.ndarray]:
        emb, conv, _, w1, _, w2, _ = self.p
        x, col, z, top, pos, h = held
        gh = d[:, None] @ w2.T * (h > 0)
        gtop = gh @ w1.T
        gz = np.zeros_like(z)
        gz[:, self.inner] += gtop[:, None, 2 * self.C :] / self.inner.sum()
        rows, chans = np.arange(len(x))[:, None], np.arange(self.C)[None, :]
        for side, p in enumerate(pos):
            gz[rows, p, chans] += gtop[:, side * self.C : (side + 1) * self.C]
        gz *= z > 0
        gcol = (gz @ conv.T).reshape(len(x), -1, self.K, self.E)
        gemb = np.zeros_like(emb)
        for k in range(self.K):
            flat = x[:, k : k + gcol.shape[1]].ravel()
            for e in range(self.E):
                gemb[:, e] += np.bincount(flat, gcol[:, :, k, e].ravel(), 97)
        return [gemb, np.tensordot(col, gz, ([0, 1], [0, 1])), gz.sum((0, 1)), top.T @ gh, gh.sum(0), h.T @ d[:, None], d.sum(keepdims=True)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(x[i : i + 512]) for i in range(0, len(x), 512))])

    def chance(self, z: np.ndarray) -> np.ndarray:
        """The calibrated probability of logits."""
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.chance(self.logits(x))


def part_of(token: str) -> int:
    """0..9 by the token's hash: 0-5 train, 6 calibrates, 7 sets the threshold, 8 and 9 test."""
    return hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=2).digest()[0] % 10


def examples(positive: list[tuple[str, str]], negative: list[tuple[str, str]], seed: int = 3, without: str = "") -> list[tuple[str, str, int, bool]]:
    """(token, window, label, whether its name may be near) from (token, window) pairs: each positive also in a negative's context, generated ones in the contexts of both."""
    rng = random.Random(seed)
    secrets, plain = generated(without=without)
    around = lambda w: (w[:CONTEXT], w[WIDTH - CONTEXT :])
    bare = [around(w) for _, w in negative + mails()[:40]] + [("\0" * CONTEXT, "\0" * CONTEXT), ("with the words before it ".ljust(CONTEXT)[:CONTEXT], " and some more after it  "[:CONTEXT])] * 8
    named = [around(w) for _, w in positive] + [(' config value: api_key = "'[-CONTEXT:], '"\n'.ljust(CONTEXT, "\0"))] * 8
    put = lambda body, c: c[0] + body[:BODY].ljust(BODY, "\0") + c[1]
    out = [(t, w, 1, True) for t, w in positive] + [(t, put(w[CONTEXT : CONTEXT + BODY].rstrip("\0"), rng.choice(bare)), 1, False) for t, w in positive]
    out += [(t, w, 0, False) for t, w in negative]
    address = lambda: (f"{rng.choice(['postgres', 'mysql', 'amqp', 'https', 'redis'])}://{rng.choice(['admin', 'root', 'app', 'svc'])}:".rjust(CONTEXT)[-CONTEXT:], f"@{rng.choice(['db', 'host', 'mq'])}.example.com/x ".ljust(CONTEXT)[:CONTEXT])
    out += [(t, put(t, rng.choice(bare)), 1, False) for t in secrets] + [(t, put(t, rng.choice(named)), 1, True) for t in secrets[::3]] + [(t, put(t, address()), 1, False) for t in secrets[1::4]]
    out += [(t, put(t, address()), 1, False) for t in plain if without != "password" and re.fullmatch(r"[A-Za-z]+[0-9]+", t) for _ in range(2)]
    out += [(t, put(t, address()), 1, False) for t in secrets if without != "password" and len(t) <= 21 for _ in range(2)]
    return out + [(t, w, 0, False) for t, w in mails()] + [(t, put(t, rng.choice(bare)), 0, False) for t in plain]


class Shard:
    """Some examples as arrays: codes, labels, whether without a name, parts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bare: np.ndarray, part: np.ndarray):
        self.x, self.y, self.bare, self.part = x, y, bare, part

    @classmethod
    def of(cls, rows: list[tuple[str, str, int, bool]]) -> Shard:
        return cls(codes([w for _, w, _, _ in rows]), np.array([k for _, _, k, _ in rows], np.uint8), np.array([not n for *_, n in rows], np.uint8), np.array([part_of(t) for t, *_ in rows], np.uint8))


def state_of(model: Cnn) -> np.ndarray:
    """Weights, means and root mean squares of the gradients, in fixed point."""
    p = np.concatenate([w.ravel() for w in model.p])
    return np.rint(np.concatenate([p, np.zeros(2 * len(p))]) * FIXED).astype(np.int64)


def with_weights(model: Cnn, state: np.ndarray) -> list[list[np.ndarray]]:
    """Puts a state's weights into the model; returns weights, means and mean squares of the gradients."""
    p, m, root = np.split((state / FIXED).astype(np.float32), 3)
    cuts = np.cumsum([w.size for w in model.p])[:-1]
    shaped = [[a.reshape(w.shape) for a, w in zip(np.split(flat, cuts), model.p, strict=True)] for flat in (p, m, root * root)]
    model.p = shaped[0]
    return shaped


def advance(state: np.ndarray, shard: Shard, r: int, seed: int) -> np.ndarray:
    """A shard's state after one round over its training examples."""
    model = Cnn()
    _, m, v = with_weights(model, state)
    train = np.random.default_rng((seed, r)).permutation(np.flatnonzero(shard.part < 6))
    step, rate = r * -(-len(train) // 64), 0.004 * (1 - r / ROUNDS)
    for lo in range(0, len(train), 64):
        own = train[lo : lo + 64]
        logit, held = model.forward(shard.x[own], keep=True)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - shard.y[own]) / len(own)).astype(np.float32)
        step += 1
        for i, g in enumerate(model.gradients(held, d)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            model.p[i] = model.p[i] - (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    flat = [np.concatenate([a.ravel() for a in arrays]).astype(np.float64) for arrays in (model.p, m, v)]
    return np.rint(np.concatenate([flat[0], flat[1], np.sqrt(flat[2])]) * FIXED).astype(np.int64)


def bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z.astype(np.float64) * BINS), -30 * BINS, 30 * BINS).astype(np.int64)


def calibrate(model: Cnn, counts: dict[tuple[int, int], int]) -> None:
    """Platt scaling by gradient steps, from the number of calibration examples of each (bin, label)."""
    z, y, n = (np.array(c, np.float64) for c in zip(*((b, k, n) for (b, k), n in sorted(counts.items())), strict=True))
    z, total, real = (z + 0.5) / BINS, n.sum(), (n * y).sum()
    t = np.where(y > 0, (real + 1) / (real + 2), 1 / (total - real + 2))
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = max(1e-3, a - 0.05 * float((n * (p - t) * z).sum() / total)), b - 0.05 * float((n * (p - t)).sum() / total)
    model.scale, model.shift = a, b


def place(counts: dict[int, int]) -> tuple[int, int]:
    """The bin of the threshold and its place inside, from the number of the threshold part's positives of each bin."""
    k = int((1 - RECALL) * sum(counts.values()))
    for b in sorted(counts):
        if k < counts[b]:
            return b, k
        k -= counts[b]
    raise ValueError("no positives")


def tally(model: Cnn, z: np.ndarray, y: np.ndarray, bare: np.ndarray) -> dict[tuple[int, int, int, int], tuple[int, float]]:
    """Of test examples: number and sum of probabilities by (tenth, label, without a name, hit)."""
    p, out = model.chance(z), {}
    for key, v in zip(zip(np.minimum((p * 10).astype(int), 9).tolist(), y.tolist(), bare.tolist(), (p >= model.threshold).astype(int).tolist(), strict=True), p.tolist(), strict=True):
        n, total = out.get(key, (0, 0.0))
        out[key] = n + 1, total + v
    return out


def reported(cells: dict[tuple[int, int, int, int], tuple[int, float]]) -> dict[str, float]:
    count = lambda keep: sum(n for key, (n, _) in cells.items() if keep(*key))
    share = lambda of, keep: count(lambda *k: of(*k) and keep(*k)) / max(1, count(keep))
    off = sum(abs(sum(p for (c, *_), (_, p) in cells.items() if c == i) - count(lambda c, y, *_: c == i and y)) for i in range(10))
    return {
        "tested": count(lambda *_: True), "recall": share(lambda c, y, b, h: h, lambda c, y, b, h: y), "recall_without_name": share(lambda c, y, b, h: h, lambda c, y, b, h: y and b),
        "precision_without_name": share(lambda c, y, b, h: y, lambda c, y, b, h: h and b), "calibration_error": off / max(1, count(lambda *_: True)),
    }


def fit(positive: list[tuple[str, str]], negative: list[tuple[str, str]], seed: int = 3, without: str = "") -> Cnn:
    """One shard of (token, window) pairs of labelled findings, which may be empty: generated ones are added, but for a shape to be left out."""
    shard, model = Shard.of(examples(positive, negative, seed, without)), Cnn()
    state = state_of(model)
    for r in range(ROUNDS):
        state = advance(state, shard, r, seed)
    with_weights(model, state)
    z, y, part = model.logits(shard.x), shard.y, shard.part
    own = lambda at: np.unique(bins(z[at]), return_counts=True)
    calibrate(model, {(b, k): n for k in (0, 1) for b, n in zip(*(a.tolist() for a in own((part == 6) & (y == k))), strict=True)})
    found = np.sort(z[(part == 7) & (y > 0)])
    model.threshold = float(model.chance(found[int((1 - RECALL) * len(found))][None])[0])
    test = part >= 8
    model.report = reported(tally(model, z[test], y[test], shard.bare[test]))
    return model


def unseen_shapes(positive: list[tuple[str, str]] = (), negative: list[tuple[str, str]] = (), n: int = 200) -> dict[str, tuple[float, float]]:
    """For each shape (recall, precision) of a network that has never seen it: on n of its secrets against as many harmless tokens, all new, in plain text."""
    out = {}
    view = lambda t: windows(f"with the words before {t} and some more after it", 22, 22 + min(len(t), BODY))[0]
    fresh, plain = generated(seed=99, n=n)
    plain = random.Random(7).sample(plain, n)
    for k, shape in enumerate(SHAPES):
        model = fit(list(positive), list(negative), without=shape)
        own, other = (model.probability(codes([view(t) for t in tokens])) >= model.threshold for tokens in (fresh[k * n : (k + 1) * n], plain))
        out[shape] = (float(own.mean()), float(own.sum() / max(1, own.sum() + other.sum())))
    return out


def _labelled(parts):
    """Labelled tokens: (label, md5 of the token, its first window)."""
    for part in pieces(parts):
        kinds, tokens, views = [], [], []
        for text in part["text"].to_pylist():
            base = base_spans(text)
            own = candidates(text, base)
            for label, spans in ((1, [token_of(text, b) for b in base] + [c for c in own if account(text, *c)]), (0, [c for c in own if harmless(text, *c)])):
                for s, e in spans:
                    kinds.append(label), tokens.append(hashlib.md5(text[s:e].encode("utf-8", "surrogatepass")).hexdigest()), views.append(windows(text, s, min(e, s + BODY))[0])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(tokens, pa.string()), pa.array(views, pa.string())], names=["label", "token", "w"])


def labelled(texts: DataFrame) -> DataFrame:
    """All distinct (label, token, w) rows of a table with a column ``text``."""
    return texts.where("text is not null and text <> ''").mapInArrow(_labelled, "label int, token string, w string").distinct()


SHARDS, LOGITS = "x binary, y binary, bare binary, part binary, seed int", "z float, y int, bare int, part int"


def _made(key, table):
    """A shard's findings -> one row with the arrays of its examples."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("label", "token", "w")), strict=True))
    own, seed = [[(t, w) for k, t, w in rows if k == label] for label in (1, 0)], 3 + key[0].as_py()
    s = Shard.of(examples(*own, seed))
    return pa.table({**{c: pa.array([getattr(s, c).tobytes()], pa.binary()) for c in ("x", "y", "bare", "part")}, "seed": pa.array([seed], pa.int32())})


def _shards(parts):
    for part in parts:
        for i in range(part.num_rows):
            x, y, bare, own = (np.frombuffer(part[c][i].as_py(), np.uint8) for c in ("x", "y", "bare", "part"))
            yield Shard(x.reshape(-1, WIDTH), y, bare, own), part["seed"][i].as_py()


def train(texts: DataFrame) -> Cnn:
    """``fit`` over all labelled findings, a task a shard; only sums of weights and counts come to the driver."""
    scratch, model = Scratch(texts.sparkSession, "secret"), Cnn()
    rows = scratch.table(labelled(texts), "labelled")
    n = max(1, round(rows.count() / SHARD))
    blank = texts.sparkSession.range(n).select(F.lit(-1).alias("label"), F.lit("").alias("token"), F.lit("").alias("w"), F.col("id").cast("int").alias("shard"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("label", "token", "w"), F.lit(n)).cast("int")).unionByName(blank)  # each shard is there, without findings too
    shards = scratch.table(dealt.repartition(n, "shard").groupBy("shard").applyInArrow(_made, SHARDS), "shards")
    state = state_of(model)
    for r in range(ROUNDS):

        def step(parts, state=state, r=r):
            for shard, seed in _shards(parts):
                out = advance(state, shard, r, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["at", "value"])

        total = shards.mapInArrow(step, "at int, value long").groupBy("at").agg(F.sum("value")).collect()
        state = np.array([v for _, v in sorted(map(tuple, total))], np.int64) // n
    with_weights(model, state)

    def logits(parts):
        for shard, _ in _shards(parts):
            own = np.flatnonzero(shard.part >= 6)
            yield pa.RecordBatch.from_arrays([pa.array(model.logits(shard.x[own])), *(pa.array(a[own].astype(np.int32)) for a in (shard.y, shard.bare, shard.part))], names=["z", "y", "bare", "part"])

    held = scratch.table(shards.mapInArrow(logits, LOGITS), "logits")
    cell = F.greatest(F.least(F.floor(F.col("z").cast("double") * BINS), F.lit(30 * BINS)), F.lit(-30 * BINS))
    counts = {(r.part, r.y, r.b): r.n for r in held.where("part in (6, 7)").groupBy("part", "y", cell.alias("b")).agg(F.count("*").alias("n")).collect()}
    calibrate(model, {(b, y): c for (part, y, b), c in counts.items() if part == 6})
    at, k = place({b: c for (part, y, b), c in counts.items() if part == 7 and y})
    found = held.where((F.col("part") == 7) & (F.col("y") == 1) & (cell == at)).orderBy("z").limit(k + 1).agg(F.max("z")).first()[0]
    model.threshold = float(model.chance(np.array([found], np.float32))[0])

    def tested(parts):
        for part in parts:
            cells = tally(model, *(part[c].to_numpy() for c in ("z", "y", "bare")))
            keys = list(zip(*cells, strict=True)) if cells else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in keys), pa.array([c for c, _ in cells.values()], pa.int64()), pa.array([p for _, p in cells.values()], pa.float64())], names=["tenth", "y", "bare", "hit", "n", "p"])

    cells = held.where("part >= 8").mapInArrow(tested, "tenth int, y int, bare int, hit int, n long, p double").groupBy("tenth", "y", "bare", "hit").agg(F.sum("n"), F.sum("p")).collect()
    model.report = reported({tuple(r[:4]): tuple(r[4:]) for r in cells})
    scratch.drop(rows, shards, held)
    return model


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def score(model: Cnn, found: list[list[tuple[str, int, int]]]) -> list[np.ndarray]:
    """For each row's (text, start, end) candidates their scores."""
    views, owner, n = [], [], sum(map(len, found))
    best = np.zeros(n)

    def flush():
        if views:
            np.maximum.at(best, owner, model.probability(codes(views)))
            views.clear(), owner.clear()

    for k, (text, s, e) in enumerate(c for own in found for c in own):
        for view in windows(text, s, e):
            views.append(view), owner.append(k)
            if len(views) >= 4096:
                flush()
    flush()
    return np.split(best, np.cumsum([len(x) for x in found])[:-1]) if found else []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn, n_unsure`` for every row.

    n_cnn: candidates beside base findings that score at least the threshold; n_unsure: base findings that don't.
    Null and empty texts have no findings; ids pass as they are, null ones too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(train(slim.select("text")))

    def run(parts):
        own = shared.value
        for part in pieces(parts):
            texts = [t or "" for t in part["text"].to_pylist()]
            base = [base_spans(t) for t in texts]
            found = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
            scores = score(own, [[(t, *token_of(t, x)) for x in b] + [(t, *c) for c in cs] for t, b, cs in zip(texts, base, found, strict=True)])
            extra = [[(s, e, 3) for (s, e), x in zip(cs, p[len(b) :], strict=True) if x >= own.threshold] for b, cs, p in zip(base, found, scores, strict=True)]
            n = [[sum(k == want for _, _, k in s) for s in base] for want in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    part["id"], *(pa.array(x, pa.int64()) for x in n), pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()),
                    pa.array([joined(sorted(s + e, key=lambda x: (x[0], x[2]))) for s, e in zip(base, extra, strict=True)], pa.string()), pa.array([len(e) for e in extra], pa.int64()),
                    pa.array([int((p[: len(b)] < own.threshold).sum()) for b, p in zip(base, scores, strict=True)], pa.int64()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "n_unsure"],
            )

    return slim.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, n_unsure long")
