"""Language-model scoring: word statistics over the whole corpus and a causal self-attention model.

Word counts cover every training document. The most frequent words, at most HEAD_WORDS of them, are broadcast; every
other word is counted where its rows meet, whose keys are rarer than each of those, so no key is hot. Words longer than
WORD_BYTES are known by a 128-bit digest, so the broadcast is bounded in bytes too.

The model reads the subword ids of the text's words (ASCII letters lower-cased, a space before each) and an end id, so
its probability is of the same words as the base score's. A step encodes each distinct word once. One causal attention layer with a
learnt bias by distance and a residual path feeds a two-level softmax: CLASSES classes of MEMBERS ids each hold the
HEAD_IDS most frequent ids, and one more class the rest, which is cut into GROUPS groups, within which ids share by
their counts. Every softmax is over `soft`, a power of two with a linear mantissa: positive and rising, so what it
gives is a distribution, at a fraction of the cost of exp.

Weights start from about START_WINDOWS windows of training documents (those whose hash is least), fitted on the
driver; then each partition learns from every window of its training documents, and the weights are the mean of the
partitions' weights, each by how often the partition used it. Each batch moves the output layers, each DEEP-th the
embeddings and the attention as well. Only sums of weights are gathered, of a fixed number.
Texts are scored in windows of CONTEXT ids that overlap, so that each id is scored exactly once with at least
CONTEXT - STRIDE ids before it (fewer only at a text's start); windows are batched and masked.

Defined cases: null text counts as empty and has the end token only; a null id counts as an empty text in the split;
without training documents N and V are zero and the weights are those of the start; repeated rows each get a row and
each count; texts of any length are scored whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import Ids

HELD_OUT = (7, 2)
HEAD_WORDS, WORD_BYTES = 1 << 18, 64
#: Bytes of text that one step reads, unless a single text is longer; a step holds some 25 times as much.
STEP = 1 << 22
TOKENIZER, N_IDS, END = "byte_bpe_50k.json", 50_257, 50_256
#: How the file writes a space; what is blank to the pattern beyond the white space that parts words.
SPACED, BLANK = "\u0120", re.compile(r"[^\S\x20\x09-\x0d]")
CLASSES, MEMBERS, BUCKETS, DIM, GROUPS = 31, 32, 512, 24, 64
HEAD_IDS = CLASSES * MEMBERS
CONTEXT, STRIDE = 32, 16
#: Of the first weights, and of the pass over all windows; a batch is BATCH windows.
START_WINDOWS, EPOCHS, BATCH, RATE = 24_000, 3, 256, 0.02
PASS_RATE, PASS_SLOWS, DEEP, HELD_IDS = 0.008, 200, 6, 1 << 18
#: Places that one step of scoring holds.
CHUNK = 8192
#: Of `soft`: what one unit of a logit adds to a float's bits, the bits of 1.0, and the range kept: products of a few
#: values stay normal numbers, as denormal ones cost a hundred times as much on many machines. NEVER gives zero.
UNIT = np.float32(1 << 23)
ONE, LEAST, MOST, NEVER = np.float32(127) * UNIT, np.float32(67) * UNIT, np.float32(187) * UNIT, np.float32(-(1 << 50))
TINY = np.float32(2**-100)
OUTER = frozenset(("out", "out2", "out3"))


def source(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT[0])) == HELD_OUT[1]
    return d.withColumn("held_out", held)


def word_keys(words: list[str]) -> list[str]:
    """What stands for words in tables: themselves, or for long ones a digest after a space, which no word holds."""
    import xxhash

    raw = [(i, w.encode("utf-8", "surrogatepass")) for i, w in enumerate(words) if 4 * len(w) > WORD_BYTES]
    long = [(i, w) for i, w in raw if len(w) > WORD_BYTES]
    if not long:
        return words
    out = list(words)
    for i, w in long:
        out[i] = " " + xxhash.xxh3_128_hexdigest(w)
    return out


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about STEP bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        yield at, stop
        at = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-cased words of texts (string): each word's code, the distinct words, and where each text's words begin (and the last's end)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0)  # a blank at a text's end leaves an empty piece
    flat = flat.filter(real)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = flat.dictionary_encode()
    try:
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    except UnicodeDecodeError:
        words = [w.decode("utf-8", "replace") for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    return coded.indices.to_numpy(zero_copy_only=False), words, kept[ends]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, stop in steps(b.column(0)):
            codes, words, _ = words_of(b.column(0).slice(at, stop - at))
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(word_keys(words), pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "c"])


@lru_cache(maxsize=1)
def _ids(path: str) -> tuple[Ids, np.ndarray]:
    """Ids of a text, and which ids begin with a space."""
    common.env_threads()
    ids_of = Ids(path)
    opens = np.zeros(N_IDS, bool)
    opens[[i for token, i in ids_of.library.get_vocab(with_added_tokens=False).items() if token.startswith(SPACED)]] = True
    return ids_of, opens


def word_ids(text: list[str], ids_of: Ids, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each with a space before it, and where each word's begin (and the last's end).

    One call encodes all: a word holds no space, so its ids begin at the one that opens with a space. Words with other
    blanks, which the pattern might join to their neighbours', are encoded alone.
    """
    alone = [i for i, w in enumerate(text) if not w.isascii() and BLANK.search(w)] if BLANK.search("".join(text)) else []
    odd = set(alone)
    plain = [i for i in range(len(text)) if i not in odd] if odd else range(len(text))
    ids = ids_of(" " + " ".join(map(text.__getitem__, plain) if odd else text)) if len(plain) else np.zeros(0, np.uint32)
    begins = np.flatnonzero(opens[ids])
    if len(begins) != len(plain):
        raise ValueError(f"{len(begins)} beginnings of {len(plain)} words")
    if not odd:
        return ids, np.append(begins, len(ids))
    parts: list = [None] * len(text)
    for i, part in zip(plain, np.split(ids, begins[1:]), strict=True) if len(plain) else ():
        parts[i] = part
    for i in alone:
        parts[i] = ids_of(" " + text[i])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def subwords(codes: np.ndarray, ends: np.ndarray, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Packed ids (unsigned 16-bit) of each text, with the end id, from `words_of` and where in ids those of each word begin, and how many they are."""
    n = len(begins)  # the code of the end
    ids, begins, sizes = np.append(ids, np.uint16(END)), np.append(begins, len(ids)), np.append(sizes, 1)
    codes = np.insert(codes.astype(np.int64), ends[1:], n)
    size = sizes[codes]
    stop = np.cumsum(size)
    out = ids[np.arange(stop[-1]) + np.repeat(begins[codes] - (stop - size), size)].tobytes() if len(codes) else b""
    cut = (2 * np.concatenate([[0], stop[ends[1:] + np.arange(len(ends) - 1)]])).tolist()
    return [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]


class Head:
    """The most frequent words: the logarithm of each one's count, and its ids once a worker has met it."""

    def __init__(self, logs: dict[str, float]):
        self.at = dict(zip(logs, range(len(logs)), strict=True))
        self.logs = np.array([*logs.values(), np.nan])  # the last is of all other words
        self.ids, self.begins, self.sizes = np.zeros(0, np.uint16), np.full(len(logs), -1), np.zeros(len(logs), np.int64)

    def places(self, keys: list[str]) -> np.ndarray:
        get = self.at.get
        return np.array([get(k, -1) for k in keys], np.int64)

    def encode(self, words: list[str], at: np.ndarray, ids_of: Ids, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word begin and how many they are, given the words' places; each frequent word is encoded once."""
        known = at >= 0
        new = np.flatnonzero(known)
        new = new[self.begins[at[new]] < 0]
        if len(new):
            ids, begins = word_ids([words[i] for i in new.tolist()], ids_of, opens)
            self.begins[at[new]], self.sizes[at[new]] = begins[:-1] + len(self.ids), np.diff(begins)
            self.ids = np.concatenate([self.ids, ids.astype(np.uint16)])
        all_ids, first, size = self.ids, np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[known], size[known] = self.begins[at[known]], self.sizes[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, begins = word_ids([words[i] for i in new.tolist()], ids_of, opens)
            first[new], size[new] = begins[:-1] + len(all_ids), np.diff(begins)
            all_ids = np.concatenate([all_ids, ids.astype(np.uint16)])
        return all_ids, first, size


def soft(t: np.ndarray, least: np.float32 = LEAST) -> np.ndarray:
    """2 ** z, linear between whole z, given t = z * UNIT + ONE."""
    out = np.empty(t.shape, np.int32)
    np.clip(t, least, MOST, out=out, casting="unsafe")
    return out.view(np.float32)


def slope(f: np.ndarray) -> np.ndarray:
    """The derivative of `soft` by z where it is f; overwrites f."""
    bits = f.view(np.int32)
    bits &= np.int32(0x7F800000)
    return f


def picked(f: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """f's value in each row at the given place, and where that is in f laid flat."""
    i = np.arange(0, f.size, f.shape[1]) + at
    return f.reshape(-1)[i], i


class Model:
    """One layer of causal self-attention over subword ids; float32 numpy. The last place of each embedding is 1, so the last row of a layer is its bias."""

    def __init__(self, counts: np.ndarray, rng: np.random.Generator):
        order = np.argsort(-counts, kind="stable")[:HEAD_IDS]
        rank = np.arange(len(order), dtype=np.int32)
        self.cls = np.full(N_IDS + 1, CLASSES, np.int16)  # ids beyond the head share the last class; id -1 has none
        self.member = np.zeros(N_IDS, np.int16)
        self.cls[order], self.member[order] = rank % CLASSES, rank // CLASSES
        self.in_class = (HEAD_IDS + np.arange(N_IDS, dtype=np.int64) * 40503 % BUCKETS).astype(np.int16)
        self.in_class[order] = rank
        self.cls[-1] = CLASSES + 1
        rest = np.flatnonzero(self.cls[:-1] == CLASSES)
        rest = rest[np.argsort(-counts[rest], kind="stable")]
        self.member[rest] = np.arange(len(rest)) % GROUPS
        p = (counts + 1.0) / (counts + 1.0).sum()
        group = np.bincount(self.member[rest], weights=p[rest], minlength=GROUPS)
        self.inner = np.zeros(N_IDS)  # log2 of an id's share in its group
        self.inner[rest] = np.log2(p[rest] / group[self.member[rest]])
        n = lambda *s, k=0.08: rng.normal(0, k, s).astype(np.float32)
        d = DIM
        self.p = {"emb": n(HEAD_IDS + BUCKETS, d, k=0.3), "mix": n(d, d, k=0.3 * d**-0.5), "rel": -0.2 * np.arange(CONTEXT, dtype=np.float32), "val": n(d, d, k=d**-0.5), "out": n(d, CLASSES + 1), "out2": n(CLASSES, d, MEMBERS), "out3": n(d, GROUPS)}
        self.p["emb"][:, -1], self.p["val"][:, -1] = 1, 0
        self.p["out"][-1] = np.log2(np.bincount(self.cls[:-1], weights=p, minlength=CLASSES + 1))
        self.p["out2"][:, -1] = np.log2(p[order].reshape(MEMBERS, CLASSES).T)
        self.p["out3"][-1] = np.log2(group)
        i = np.arange(CONTEXT)
        self.back = np.maximum(i[:, None] - i, 0)  # how far back a place is, and the places that come later
        self.later = i[:, None] < i
        self.ready: dict | None = None

    def layers(self) -> dict[str, np.ndarray]:
        """Weights in the units of `soft`, kept until they change."""
        p, w = self.p, self.ready or {}
        for k in OUTER - w.keys():
            w[k] = p[k] * UNIT
            w[k][..., -1, :] += ONE
        if "query" not in w:
            # What each input class is as a query, by its value and on the residual path; the place of ones in `value` sums the attention.
            w["query"], w["value"], w["self"] = p["emb"] @ (p["mix"] * UNIT), p["emb"] @ p["val"], p["emb"].copy()
            w["value"][:, -1], w["self"][:, -1] = 1, 0
            w["rel"] = np.where(self.later, NEVER, p["rel"][self.back] * UNIT + ONE)
        self.ready = w
        return w

    def states(self, x: np.ndarray, since: int = 0):
        """x: windows of input classes, the id before each scored one. States (rows) from place `since` on, and what led there."""
        p, w, n = self.p, self.layers(), len(x)
        at = x.reshape(-1).astype(np.intp)
        late = at.reshape(n, CONTEXT)[:, since:].reshape(-1)
        e = p["emb"].take(at, 0, mode="clip").reshape(n, CONTEXT, DIM)
        keys = np.ascontiguousarray(e.transpose(0, 2, 1))
        f = np.matmul(w["query"].take(late, 0, mode="clip").reshape(n, CONTEXT - since, DIM), keys)
        f += w["rel"][since:]
        f = soft(f, np.float32(0))  # zero for places that come later
        h = np.matmul(f, w["value"].take(at, 0, mode="clip").reshape(n, CONTEXT, DIM)).reshape(-1, DIM)
        part = 1 / np.maximum(h[:, -1:], TINY)
        h *= part
        h += w["self"].take(late, 0, mode="clip")
        return h, (e, f, part, keys)

    def block_states(self, x: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """x: blocks of STRIDE input classes. States (rows) of those after the first, as in a window with the block before; where one opens a text, of itself only."""
        w, n, at = self.layers(), len(opens), x.reshape(-1).astype(np.intp)
        late = at[STRIDE:]
        step, item = STRIDE * DIM * 4, 4
        keys = np.ascontiguousarray(self.p["emb"].take(at, 0, mode="clip").T)
        keys = as_strided(keys, (n, DIM, CONTEXT), (STRIDE * item, keys.strides[0], item))
        f = np.matmul(w["query"].take(late, 0, mode="clip").reshape(n, STRIDE, DIM), keys)
        f += w["rel"][STRIDE:]
        f = soft(f, np.float32(0))
        f[opens, :, :STRIDE] = 0
        h = np.matmul(f, as_strided(w["value"].take(at, 0, mode="clip"), (n, CONTEXT, DIM), (step, DIM * item, item))).reshape(-1, DIM)
        h *= 1 / np.maximum(h[:, -1:], TINY)
        h += w["self"].take(late, 0, mode="clip")
        return h

    def heads(self, h: np.ndarray, ids: np.ndarray):
        """Rows by their id's class (without those of id -1), where each class begins, states in this order, and the values of classes, of the members of the head's classes and of the groups of the last."""
        w, cls = self.layers(), self.cls[ids]
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(CLASSES + 2))
        order, head = order[: ends[-1]], int(ends[CLASSES])
        s = h.take(order, 0, mode="clip")
        two = np.empty((head, MEMBERS), np.float32)
        for c in np.flatnonzero(np.diff(ends[:-1])).tolist():
            np.matmul(s[ends[c] : ends[c + 1]], w["out2"][c], out=two[ends[c] : ends[c + 1]])
        return order, ends, s, soft(s @ w["out"]), soft(two), soft(s[head:] @ w["out3"])

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of ids given states h, and the rows that they belong to (none where the id is -1)."""
        order, ends, _, one, two, three = self.heads(h, ids)
        ids = ids[order]
        share = lambda f, at: picked(f, at)[0] / (f @ np.ones(f.shape[1], np.float32))
        member, head = self.member[ids], int(ends[CLASSES])
        out = np.log2(share(one, self.cls[ids]))
        out[:head] += np.log2(share(two, member[:head]))
        out[head:] += np.log2(share(three, member[head:])) + self.inner[ids[head:]]
        return out, order

    def grads(self, x: np.ndarray, y: np.ndarray, deep: bool = True) -> dict[str, np.ndarray]:
        """Of the mean -log2 probability of ids y (-1: none); of the output layers only unless `deep`."""
        p, flat = self.p, y.reshape(-1)
        h, (e, f, part, keys) = self.states(x)
        order, ends, s, one, two, three = self.heads(h, flat)
        ids, head = flat[order], int(ends[CLASSES])
        member, share = self.member[ids], np.float32(1 / (max(1, len(ids)) * math.log(2)))

        def d_soft(f: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """What rows of the derivative by logits are before each is multiplied by its factor, and the factors."""
            total = f @ np.ones(f.shape[1], np.float32)
            mine, i = picked(f, at)
            z = slope(f)
            z.reshape(-1)[i] *= 1 - total / mine
            return z, (share / total)[:, None]

        (z1, m1), (z2, m2), (z3, m3) = d_soft(one, self.cls[ids]), d_soft(two, member[:head]), d_soft(three, member[head:])
        out2, s2, some = np.zeros_like(p["out2"]), s[:head] * m2, np.flatnonzero(np.diff(ends[:-1])).tolist()
        for k in some:
            np.matmul(s2[ends[k] : ends[k + 1]].T, z2[ends[k] : ends[k + 1]], out=out2[k])
        out = {"out": (s * m1).T @ z1, "out2": out2, "out3": (s[head:] * m3).T @ z3}
        if not deep:
            return out
        d = np.empty_like(s)
        for k in some:
            np.matmul(z2[ends[k] : ends[k + 1]], p["out2"][k].T, out=d[ends[k] : ends[k + 1]])
        np.matmul(z3, p["out3"].T, out=d[head:])
        d[:head] *= m2
        d[head:] *= m3
        one = z1 @ p["out"].T
        one *= m1
        d += one
        dh = np.zeros_like(h)
        dh[order] = d
        c = np.matmul(f, e).reshape(-1, DIM)
        c *= part
        out["val"] = c.T @ dh
        out["val"][:, -1] = 0
        dc = dh @ p["val"].T
        dc *= part
        de = np.matmul(f.transpose(0, 2, 1), dc.reshape(e.shape)).reshape(-1, DIM)
        dc[:, -1] -= np.einsum("ij,ij->i", dc, c)  # as each embedding ends in 1
        df = np.matmul(dc.reshape(e.shape), keys)
        df *= slope(f)
        dq, q = np.matmul(df, e).reshape(-1, DIM), (e.reshape(-1, DIM) @ p["mix"]).reshape(e.shape)
        dh += de
        dh += dq @ p["mix"].T
        dh += np.matmul(df.transpose(0, 2, 1), q).reshape(-1, DIM)
        out["mix"] = e.reshape(-1, DIM).T @ dq
        out["rel"] = np.bincount(self.back.reshape(-1), weights=df.sum(0).reshape(-1), minlength=CONTEXT).astype(np.float32)
        flat_x = x.reshape(-1)
        by = np.argsort(flat_x, kind="stable")
        first = np.flatnonzero(np.diff(flat_x[by], prepend=-1))
        out["emb"] = np.zeros_like(p["emb"])
        out["emb"][flat_x[by[first]]] = np.add.reduceat(dh.take(by, 0, mode="clip"), first, 0)
        out["emb"][:, -1] = 0
        return out

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Several epochs over windows: x input classes, y ids (-1 beyond a text's end), both n x CONTEXT."""
        adam = Adam(self)
        batch = max(1, min(BATCH, len(x) // 8))
        total, t = EPOCHS * (len(x) // batch), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x) - batch + 1, batch):
                t += 1
                adam.step(x[order[i : i + batch]], y[order[i : i + batch]], RATE * (1 - 0.95 * t / total))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each id sequence; blocks of STRIDE ids of all texts are batched together, each with the one before it."""
        x, y = windows(self, texts, STRIDE)
        owner = np.repeat(np.arange(len(texts)), -(-np.array([len(t) for t in texts], np.int64) // STRIDE))
        opens = np.diff(owner, prepend=-1) > 0
        x, total = np.concatenate([np.zeros((1, STRIDE), x.dtype), x]), np.zeros(len(texts))
        for i in range(0, len(y), CHUNK // STRIDE):
            part = slice(i, i + CHUNK // STRIDE)
            lp, order = self.log_probs(self.block_states(x[i : part.stop + 1], opens[part]), y[part].reshape(-1))
            total += np.bincount(owner[part][order // STRIDE], weights=lp, minlength=len(texts))
        return total * math.log10(2)


class Adam:
    def __init__(self, model: Model):
        self.model, self.t = model, Counter()
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.u = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, deep: bool = True) -> None:
        for k, g in self.model.grads(x, y, deep).items():
            self.t[k] += 1
            m, u = self.m[k], self.u[k]
            m += np.float32(0.1) * (g - m)
            u += np.float32(0.02) * (g * g - u)
            self.model.p[k] -= np.float32(rate / (1 - 0.9 ** self.t[k])) * m / (np.sqrt(u / np.float32(1 - 0.98 ** self.t[k])) + np.float32(1e-6))
        self.model.ready = None if deep else {k: v for k, v in self.model.ready.items() if k not in OUTER}


def windows(model: Model, texts: list[np.ndarray], size: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Input classes and ids of all windows of the id sequences; each id is in one, -1 fills a text's last."""
    lens = np.array([len(t) for t in texts], np.int64)
    held = -(-lens // size) * size
    x, y = np.zeros(int(held.sum()), np.int16), np.full(int(held.sum()), -1, np.int32)
    if len(x):
        ids = np.concatenate(texts).astype(np.int32)
        starts = np.cumsum(lens) - lens
        at = np.arange(len(ids)) + np.repeat(np.cumsum(held) - held - starts, lens)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts[lens > 0]] = END
        x[at], y[at] = model.in_class[before], ids
    return x.reshape(-1, size), y.reshape(-1, size)


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N_IDS, np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 64):
            total += np.bincount(np.frombuffer(b"".join(b.column(0).slice(at, 64).to_pylist()), "<u2"), minlength=N_IDS)
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "c"])


def _some(share: float):
    """Windows (key, ids from the one before the window on) whose hash is among the given share of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                uid, texts = b.column(0).slice(at, 256).to_numpy().astype(np.uint64), b.column(1).slice(at, 256).to_pylist()
                n = -(-np.array([len(t) // 2 for t in texts]) // CONTEXT)
                row, nth = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = (nth.astype(np.uint64) + (uid << np.uint64(24))[row]) * np.uint64(0x9E3779B97F4A7C15)
                key = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24)
                found = np.flatnonzero(key < share * (1 << 40))
                out = []
                for r, w in zip(row[found].tolist(), nth[found].tolist(), strict=True):
                    ids = np.frombuffer(texts[r], "<u2")
                    before = ids[w * CONTEXT - 1 : w * CONTEXT] if w else np.array([END], "<u2")
                    out.append(np.concatenate([before, ids[w * CONTEXT : (w + 1) * CONTEXT]]).tobytes())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(key[found].astype(np.int64)), pa.array(out, pa.binary())], ["key", "ids"])

    return run


def fit(first: list[np.ndarray], id_counts: np.ndarray, seed: int = 5) -> Model:
    """The model's first weights, from windows with the id before each."""
    common.reuse_memory()
    rng = np.random.default_rng(seed)
    model = Model(id_counts, rng)
    if first:
        x, y = np.zeros((len(first), CONTEXT), np.int16), np.full((len(first), CONTEXT), -1, np.int32)
        for i, w in enumerate(first):
            x[i, : len(w) - 1], y[i, : len(w) - 1] = model.in_class[w[:-1]], w[1:]
        model.train(x, y, rng)
    return model


def _train(first):
    """Weights after a pass over all windows of a partition, times how often each was used: place, w, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.reuse_memory()
        model = copy.copy(first.value)
        model.p = {k: v.copy() for k, v in model.p.items()}
        adam, rng = Adam(model), np.random.default_rng(5)
        used, target = np.zeros(len(model.p["emb"]), np.int64), np.zeros(CLASSES + 1, np.int64)

        def learn(texts: list[np.ndarray]) -> None:
            x, y = windows(model, texts)
            used[:] += np.bincount(x.reshape(-1), minlength=len(used))
            target[:] += np.bincount(model.cls[y[y >= 0]], minlength=len(target))
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                k = order[i : i + BATCH]
                adam.step(x[k], y[k], PASS_RATE * len(k) / BATCH / (1 + adam.t["out"] / PASS_SLOWS) ** 0.5, adam.t["out"] % DEEP == 0)

        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                ids = np.frombuffer(t.as_py(), "<u2")
                for at in range(0, len(ids), HELD_IDS):  # a longer text is learnt in parts
                    held.append(ids[at : at + HELD_IDS])
                    size += len(held[-1])
                    if size >= HELD_IDS:
                        learn(held)
                        held, size = [], 0
        learn(held)
        if target.any():
            n = {k: np.full(v.shape, target.sum(), np.float64) for k, v in model.p.items()}
            n["emb"][:], n["out2"][:], n["out3"][:] = used[:, None] + 1e-3, target[:-1, None, None] + 1e-3, target[-1] + 1e-3
            w, n = (np.concatenate([v[k].reshape(-1) for k in model.p]).astype(np.float64) for v in (model.p, n))
            for at in range(0, len(w), 1 << 16):
                part = slice(at, min(at + (1 << 16), len(w)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.start, part.stop, dtype=np.int32)), pa.array(w[part] * n[part]), pa.array(n[part])], ["place", "w", "n"])

    return run


def train_all(train: DataFrame, first: Model) -> Model:
    """The mean, by use, of the weights that each partition of `train` (ids) reaches from `first`."""
    sc = train.sparkSession.sparkContext
    sums = train.select("ids").mapInArrow(_train(sc.broadcast(first)), "place int, w double, n double")
    rows = sums.groupBy("place").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()
    if not rows.num_rows:
        return first
    w = np.empty(rows.num_rows, np.float32)
    w[rows.column("place").to_numpy()] = rows.column("w").to_numpy()
    at = 0
    for k, v in first.p.items():
        first.p[k], at = w[at : at + v.size].reshape(v.shape), at + v.size
    first.ready = None
    return first


_ROW = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, part double, ids binary, word string, tf long"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]


def _read(head, c_end: int, total: float, tokenizer: str | None):
    """A row for each document, with its ids and the base score of its frequent words, and one for each of its other words, with whether it is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (ids_of, opens), frequent = _ids(tokenizer or common.tokenizer_file(TOKENIZER)), head.value
        uid = TaskContext.get().partitionId() << 33
        log_total, end = math.log10(total), math.log10((c_end + 1) / total)
        for big in batches:
            for at, stop in steps(big.column(1)):
                b = big.slice(at, stop - at)
                codes, words, ends = words_of(b.column(1))
                keys = word_keys(words)
                places = frequent.places(keys)
                ids = subwords(codes, ends, *frequent.encode(words, places, ids_of, opens))
                logs = frequent.logs[places]
                of = np.repeat(np.arange(b.num_rows), np.diff(ends))
                mine = logs[codes]
                other = np.isnan(mine)
                n = np.diff(ends)
                known = n - np.bincount(of[other], minlength=b.num_rows)
                part = np.bincount(of, weights=np.where(other, 0, mine), minlength=b.num_rows) - known * log_total + end
                pair, tf = np.unique(of[other] * len(words) + codes[other], return_counts=True)
                k, m = b.num_rows, len(pair)
                none = lambda m, t: pa.nulls(m, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + k)), b.column(0), b.column(2), pa.array(n + 1), pa.array(known + (c_end > 0)), pa.array(part), pa.array(ids, pa.binary()), none(k, pa.string()), none(k, pa.int64())], _NAMES)
                if m:
                    doc, word = np.divmod(pair, len(words))
                    yield pa.RecordBatch.from_arrays([pa.array(uid + doc), none(m, pa.int64()), b.column(2).take(pa.array(doc)), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.binary()), pa.array(keys, pa.string()).take(pa.array(word)), pa.array(tf)], _NAMES)
                uid += k

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.reuse_memory()
        net = model.value
        for b in batches:
            held, size, scores = [], 0, []
            for t in b.column(6):
                held.append(np.frombuffer(t.as_py(), "<u2"))
                size += len(held[-1])
                if size >= HELD_IDS:
                    scores.append(net.score(held))
                    held, size = [], 0
            if held:
                scores.append(net.score(held))
            if scores:
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(np.concatenate(scores))], [*_NAMES[:6], "score"])

    return run


def totals(counts: DataFrame) -> tuple[int, int, dict[str, float]]:
    """How many words there are, the sum of their counts, and log10(c + 1) of the most frequent, at most HEAD_WORDS: those above the least count that leaves so few."""
    step = F.floor(F.log2("c") * 8).cast("int")
    rows = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).orderBy(F.desc("step")).collect()
    least, held = 0, 0
    for r in rows:
        held += r.words
        if held > HEAD_WORDS:
            least = r.step + 1
            break
    return sum(r.words for r in rows), sum(r.c for r in rows), {r.word: math.log10(r.c + 1) for r in counts.where(step >= least).toLocalIterator()}


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    common.env_threads()
    spark = docs.sparkSession
    common.ship(spark)
    src = source(docs, text_col, id_col)
    counts = common.written(src.where("not held_out").select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n_docs = src.where("not held_out").count()
    distinct, total, logs = totals(counts)
    distinct, total = distinct + (n_docs > 0), total + n_docs
    divisor = float(total + 1 * (distinct + 1))
    sc = spark.sparkContext
    rows = common.written(src.mapInArrow(_read(sc.broadcast(Head(logs)), n_docs, divisor, tokenizer), _ROW), "read")
    train = rows.where("ids is not null and not held_out")
    id_counts = np.zeros(N_IDS)
    for r in train.select("ids").mapInArrow(_id_counts, "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        id_counts[r.id] = r.c
    n_windows = id_counts.sum() / CONTEXT + n_docs
    some = train.select("uid", "ids").mapInArrow(_some(START_WINDOWS / max(1.0, n_windows)), "key long, ids binary").orderBy("key", "ids").limit(START_WINDOWS).collect()
    model = train_all(train, fit([np.frombuffer(r.ids, "<u2").astype(np.int32) for r in some], id_counts))
    scored = rows.where("ids is not null").mapInArrow(_score(sc.broadcast(model)), ", ".join([*_ROW.split(", ")[:6], "score double"]))
    c = F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("tf"))).over(Window.partitionBy("word"))
    rare, c = rows.where("word is not null").select("uid", "tf", c.alias("c")), F.col("c")
    rare = rare.groupBy("uid").agg(F.sum(F.col("tf") * F.log10((c + 1) / F.lit(divisor))).alias("rest"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("found"))
    return scored.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
