"""Secret scans: fixed patterns, plus a character convolutional network over every candidate in its context.

Candidates are the base findings and every run of 16 or more key characters that mixes letters and digits, and
PEM private-key headers. The network reads characters before, within and after a window; a candidate's probability is
the largest of the overlapping windows that cover its every position. It is trained in numpy on labelled findings made
by rule (`labelled_findings`, and `embedded_findings` within longer runs), with a held-out part for Platt calibration
and for the thresholds, one for candidates of one window and one for longer ones: the highest with recall of at least
`RECALL` there. Base findings always stay; a candidate that no base finding holds whole is added as kind `model` when
its probability reaches its threshold. Work is linear in a text's findings.

Defined cases: null text counts as empty; offsets are code points, ends exclusive; patterns see bytes, so only
ASCII letters match in either case; texts of any length are scanned whole; repeated rows each get a row; an empty
table gives an empty result; other columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # the maximal runs of [0-9a-f]+ with 24 or more
KEYWORD = re.compile(rb"(?:passw|secret|token|api_?key)", re.IGNORECASE)
GENERIC = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
MARK = "[SECRET]"

SIDE, ENDS = 20, 20
WIDTH = 2 * SIDE + 2 * ENDS + 1
EMBED, TAPS, FILTERS = 8, 5, 24
RECALL = 0.97
SEED = 7

#: Byte -> class: digits, lower, upper and punctuation stay apart, the rest shares one; 0 pads, 1 divides.
CLASS = np.full(256, 2, np.int64)
for _i, _c in enumerate(range(32, 127)):
    CLASS[_c] = 3 + _i
N_CLASS = 98


def encode(text: bytes, start: int, end: int) -> np.ndarray:
    """Context before | head and tail of the candidate | context after."""
    out = np.zeros(WIDTH, np.int64)
    before, after = text[max(0, start - SIDE) : start], text[end : end + SIDE]
    head, tail = text[start : min(end, start + ENDS)], text[max(start + ENDS, end - ENDS) : end]
    for at, part, right in ((0, before, True), (SIDE, head, False), (SIDE + ENDS, tail, False), (SIDE + 2 * ENDS + 1, after, False)):
        if part:
            at += SIDE - len(part) if right else 0
            out[at : at + len(part)] = CLASS[np.frombuffer(part, np.uint8)]
    out[SIDE + 2 * ENDS] = 1
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Windows that cover a candidate; any stretch of up to ENDS bytes lies whole in one."""
    last = end - 2 * ENDS
    return [(start, end)] if last <= start else [(a, a + 2 * ENDS) for a in (*range(start, last, ENDS), last)]


class Net:
    """Embedding, one convolution, max pooling over three zones (before, within, after), a logistic unit."""

    ZONES = ((0, SIDE), (SIDE, SIDE + 2 * ENDS), (SIDE + 2 * ENDS, WIDTH - TAPS + 1))

    def __init__(self, rng: np.random.Generator):
        self.p = [
            rng.normal(0, 0.3, (N_CLASS, EMBED)), rng.normal(0, (TAPS * EMBED) ** -0.5, (TAPS * EMBED, FILTERS)), np.zeros(FILTERS),
            rng.normal(0, 0.2, (3 * FILTERS, 1)), np.zeros(1),
        ]
        self.scale, self.shift, self.thresholds = 1.0, 0.0, (0.5, 0.5)

    def forward(self, x: np.ndarray):
        emb, w, b, out, bias = self.p
        e = emb[x]  # n, WIDTH, EMBED
        cols = np.lib.stride_tricks.sliding_window_view(e, TAPS, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - TAPS + 1, TAPS * EMBED)
        h = np.maximum(cols @ w + b, 0)
        at = np.stack([z0 + h[:, z0:z1].argmax(1) for z0, z1 in self.ZONES], 1)  # n, 3, FILTERS
        pooled = np.take_along_axis(h, at, 1).reshape(len(x), -1)
        return cols, at, pooled, (pooled @ out)[:, 0] + bias[0]

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        emb, w, b, out, bias = self.p
        cols, at, pooled, z = self.forward(x)
        dz = (1 / (1 + np.exp(-z)) - y)[:, None] / len(y)
        dpool = (dz @ out.T) * (pooled > 0)
        d_emb, d_w = np.zeros_like(emb), np.zeros_like(w)
        dp = dpool.reshape(len(x), 3, FILTERS)
        rows = np.arange(len(x))
        for z_i in range(3):
            for f in range(FILTERS):
                g, place = dp[:, z_i, f], at[:, z_i, f]
                d_w[:, f] += g @ cols[rows, place]
                back = (g[:, None] * w[:, f]).reshape(len(x), TAPS, EMBED)
                for t in range(TAPS):
                    np.add.at(d_emb, x[rows, place + t], back[:, t])
        return [d_emb, d_w, dpool.reshape(len(x), 3, FILTERS).sum((0, 1)), pooled.T @ dz, dz.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 6, batch: int = 128, rate: float = 0.01) -> None:
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                k = order[i : i + batch]
                t += 1
                for j, g in enumerate(self.step(x[k], y[k])):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.99 * v[j] + 0.01 * g * g
                    self.p[j] = self.p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, secret: np.ndarray, long: np.ndarray) -> None:
        """Platt scaling on labelled windows (-1: neither), then for short and for `long` findings the highest threshold whose recall on these held-out ones is RECALL; `of`: each window's finding."""
        every, x, y = x, x[y >= 0], y[y >= 0]
        z = self.forward(x)[3]
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a -= 0.5 * float(((p - y) * z).mean()) / max(1.0, float((z * z).mean()) / 4)
            b -= 0.5 * float((p - y).mean())
        self.scale, self.shift = a, b
        top = np.zeros(len(secret))
        np.maximum.at(top, of, self.probability(every))
        kinds = (np.sort(top[secret & (long == k)]) for k in (False, True))
        self.thresholds = tuple(float(pos[int((1 - RECALL) * len(pos))]) for pos in kinds)

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), 1024):
            out[i : i + 1024] = 1 / (1 + np.exp(-np.clip(self.scale * self.forward(x[i : i + 1024])[3] + self.shift, -60, 60)))
        return out


def labelled_findings(n: int, seed: int) -> list[tuple[bytes, int, int, int]]:
    """(text, start, end, label) by rule: keys in the shapes that services issue, and what only looks like them."""
    r = random.Random(seed)
    alnum, low = string.ascii_letters + string.digits, string.ascii_lowercase
    pick = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda: pick(low, 2, 9)
    words = lambda k: " ".join(word() for _ in range(k))
    secret = [
        lambda: "ghp_" + pick(alnum, 36, 36), lambda: "xoxb-" + pick(string.digits, 11, 12) + "-" + pick(alnum, 24, 24), lambda: "sk_live_" + pick(alnum, 24, 32),
        lambda: "AIza" + pick(alnum + "-_", 35, 35), lambda: "eyJ" + pick(alnum + "-_", 20, 60) + "." + pick(alnum + "-_", 20, 80) + "." + pick(alnum + "-_", 30, 43),
        lambda: pick(alnum + "+/", 40, 88) + r.choice(("", "=", "==")), lambda: pick(alnum, 20, 64), lambda: "glpat-" + pick(alnum, 20, 20), lambda: "npm_" + pick(alnum, 36, 36),
    ]
    plain = [
        lambda: "-".join(word() for _ in range(r.randint(2, 5))) + "-" + pick(string.digits, 1, 4), lambda: f"{word()}.{word()}{r.randint(0, 99)}.example.{r.choice(('com', 'org', 'net'))}",
        lambda: "/".join(word() for _ in range(r.randint(2, 5))) + f"/{word()}{r.randint(1, 999)}.{r.choice(('py', 'html', 'txt', 'png'))}", lambda: f"{word()}_{word()}_{word()}{r.randint(0, 2030)}",
        lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", lambda: word().capitalize() + word().capitalize() + word().capitalize() + str(r.randint(1, 99)) + pick(low, 4, 8),
        lambda: f"{word()}-{word()}-v{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)}", lambda: word() + word() + word() + str(r.randint(0, 9999)), lambda: word() + "=" + pick(string.digits, 8, 12) + "=" + word(),
        lambda: f"www.{word()}{word()}.com/{word()}/{r.randint(1, 99999)}", lambda: "..." + word() + "..." + word() + str(r.randint(0, 9)) + "...",
    ]
    lead_s = ["key = ", "Authorization: Bearer ", "export KEY=", "credentials: ", "auth ", 'client "', "", "access key id ", words(1) + " "]
    lead_p = ["see ", "file ", "http://", "at ", "from ", "", "version ", words(1) + "@", "id ", words(1) + " "]
    out = []
    for i in range(n):
        y = i % 2
        body = r.choice(secret if y else plain)()
        if len(body) < 16:
            body += pick(low, 16 - len(body), 20) if not y else pick(alnum, 16, 20)
        pre = words(r.randint(0, 4)) + " " + r.choice((lead_s + [""]) if y else (lead_p + [""]))
        text = (pre + body + r.choice((" ", '" ', ". ", ", ", "\n")) + words(r.randint(0, 4))).encode()
        out.append((text, len(pre.encode()), len(pre.encode()) + len(body), y))
    return out


def embedded_findings(n: int, seed: int) -> list[tuple[bytes, int, int, int, int]]:
    """(text, start, end, key's start, key's end) by rule: keys within longer runs of plain pieces, and such runs without a key (both zero)."""
    r = random.Random(seed)
    found = labelled_findings(2 * n, seed + 1)
    keys, plains = ([t[s:e].decode() for t, s, e, y in found if y == k] for k in (1, 0))
    out = []
    for i in range(n):
        glue = r.choice("/=._-/=")
        before, after = ([r.choice(plains) for _ in range(r.randint(0, 3))] for _ in range(2))
        head, tail = "".join(x + glue for x in before), "".join(glue + x for x in after)
        key = r.choice(keys if i % 2 else plains)
        lead = r.choice(("see ", "http://", "url: ", "x ", "")).encode()
        text = lead + (head + key + tail).encode()
        at = len(lead) + len(head)
        out.append((text + b" and more", len(lead), len(text), *((at, at + len(key)) if i % 2 else (0, 0))))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 4000, seed: int = SEED) -> Net:
    """The network, its calibration and threshold; the same on every machine."""
    plain = [(t, s, e, s * y, e * y) for t, s, e, y in labelled_findings(n, seed)]
    found = [f for pair in zip(plain, embedded_findings(n, seed + 100), strict=True) for f in pair]
    x, y, of = [], [], []
    for i, (t, s, e, ks, ke) in enumerate(found):
        for a, b in windows(s, e):
            shared = min(b, ke) - max(a, ks)
            x.append(encode(t, a, b))
            y.append(0 if shared <= 0 else 1 if shared >= min(ENDS, ke - ks) else -1)  # little of a key: neither
            of.append(i)
        if e - s > 2 * ENDS and (s, e) == (ks, ke):
            x.append(encode(t, s, e)), y.append(1), of.append(i)
    x, y, of = np.stack(x), np.array(y, float), np.array(of)
    secret = np.array([f[4] > 0 for f in found])
    rng = np.random.default_rng(seed)
    net, cut = Net(rng), len(found) * 3 // 4
    learn, held = (of < cut) & (y >= 0), of >= cut
    net.fit(x[learn], y[learn], rng)
    net.p = [p.astype(np.float32) for p in net.p]  # before calibration, which then holds for the weights in use
    net.calibrate(x[held], y[held], of[held] - cut, secret[cut:], np.array([len(windows(s, e)) > 1 for _, s, e, _, _ in found[cut:]]))
    return net


def base_findings(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start, then kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans beyond the base findings that the network judges."""
    out = []
    for m in GENERIC.finditer(text):
        s = m[0]
        if s.startswith(b"-----BEGIN ") or (_DIGIT.search(s) and _LETTER.search(s)):
            out.append(m.span())
    return out


def points(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offsets to code points, in one pass over the text."""
    if text.isascii():
        return {o: o for o in offsets}
    out, at, n = {}, 0, 0
    for o in sorted(set(offsets)):
        n += len(text[at:o].decode("utf-8", "replace"))
        at = o
        out[o] = n
    return out


def find(texts: list[bytes], net: Net) -> list[tuple[list, list]]:
    """For each text: base findings, and spans that the network adds; as (start, kind, end) in code points."""
    base, ask, where = [base_findings(t) for t in texts], [], []
    for i, t in enumerate(texts):
        k, reach = 0, -1  # base findings that begin no later than the candidate, and where the furthest ends
        for s, e in candidates(t):
            while k < len(base[i]) and base[i][k][0] <= s:
                reach = max(reach, base[i][k][2])
                k += 1
            if e > reach:
                for a, z in windows(s, e):
                    ask.append((t, a, z))
                    where.append((i, s, e))
    limit = np.array([net.thresholds[len(windows(s, e)) > 1] for _, s, e in where])
    added: list[list] = [[] for _ in texts]
    hit = set()
    for at in range(0, len(ask), 1024):  # bounds what one step holds
        p = net.probability(np.stack([encode(*w) for w in ask[at : at + 1024]]))
        hit.update(where[at + k] for k in np.flatnonzero(p >= limit[at : at + 1024]).tolist())
    for i, s, e in sorted(hit):
        added[i].append((s, 3, e))
    out = []
    for t, b, a in zip(texts, base, added, strict=True):
        if b or a:
            at = points(t, [x for s, _, e in b + a for x in (s, e)])
            b, a = [(at[s], k, at[e]) for s, k, e in b], [(at[s], k, at[e]) for s, k, e in a]
        out.append((b, a))
    return out


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan_udf(net: Net):
    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base:string,spans:string>")
    def secret_spans(text: pa.Array) -> pa.Array:
        found = find([x.as_py() or b"" for x in text], net)
        n = [pa.array([sum(k == i for _, k, _ in b) for b, _ in found], pa.int64()) for i in range(3)]
        strs = [pa.array([listed(b) for b, _ in found], pa.string()), pa.array([listed(b + a) for b, a in found], pa.string())]
        return pa.StructArray.from_arrays([*n, *strs], ["n_assign", "n_access", "n_hex", "base", "spans"])

    return secret_spans.asNondeterministic()


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base (listing), spans (listing)."""
    common.ship(docs.sparkSession)
    s = _scan_udf(trained())(common.text_of(text_col).cast("binary"))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), s.alias("s")).select("doc_id", "s.*")


def masked(text: str, spans: list, mark: str = MARK) -> str:
    """The text with each stretch of overlapping or touching spans replaced by one mark."""
    out, at, last = [], 0, -1
    for s, _, e in sorted(spans):
        if s > last:
            out += [text[at:s], mark]
        last = at = max(last, e)
    return "".join([*out, text[at:]])


def _redact_udf(net: Net):
    @F.arrow_udf("string")
    def redacted(text: pa.Array) -> pa.Array:
        raw = [None if not x.is_valid else x.as_py() for x in text]
        found = find([r or b"" for r in raw], net)
        return pa.array([None if r is None else masked(r.decode("utf-8", "replace"), b + a) if b or a else r.decode("utf-8", "replace") for r, (b, a) in zip(raw, found, strict=True)], pa.string())

    return redacted


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with its columns; each secret in the text is replaced by MARK, and its length column follows."""
    common.ship(docs.sparkSession)
    out = docs.withColumn(text_col, _redact_udf(trained())(F.col(f"`{text_col}`").cast("binary")))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(f"`{text_col}`").isNotNull(), F.length(f"`{text_col}`").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`")))
    return out
