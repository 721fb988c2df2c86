"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

The leaf of a live position holds the rank of the pair that starts there, inner nodes the minimum below. The root
names the least rank, descending left on ties finds its leftmost place, and a merge updates three leaves: the
pair's own, the dead right neighbour's and the left neighbour's. A piece of n bytes costs O(n log n).

Defined cases: null text counts as empty and has no ids (the hashes are of no bytes); texts of any length are
encoded whole; texts that name special tokens are ordinary text; repeated rows each get a row; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Packer

RANKS = "byte_bpe_50k.tiktoken"
NONE = 1 << 60


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.ranks, self.matches = ranks, regex.compile(pattern).findall
        self.longest = max(map(len, ranks))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pack = Packer(self.unit)

    def unit(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern separately."""
        if text.isascii() and text[text[:1] == " " :].isalpha():  # one match: a space at most, then letters
            return self.piece(text.encode())
        out: list[int] = []
        for m in self.matches(text):
            out += self.piece(m.encode("utf-8", "surrogatepass"))
        return out

    def piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, longest = len(piece), ranks.get, self.longest
        width = 1 << max(0, n - 1).bit_length()
        after, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = get(piece[i : i + 2], NONE)
        for v in range(width - 1, 0, -1):
            left, right = tree[2 * v], tree[2 * v + 1]
            tree[v] = left if left <= right else right
        while tree[1] != NONE:
            least, v = tree[1], 1
            while v < width:
                v = 2 * v if tree[2 * v] == least else 2 * v + 1
            i = v - width
            dead = after[i]
            end = after[dead]
            after[i] = end
            before[end] = i
            todo = [(dead, NONE)]
            # The pairs that now start at i and at its left neighbour.
            for at in (i, before[i]):
                if at >= 0:
                    mid = after[at]
                    stop = after[mid] if mid < n else NONE
                    todo.append((at, get(piece[at:stop], NONE) if stop - at <= longest else NONE))
            for at, rank in todo:
                v = width + at
                tree[v] = rank
                v >>= 1
                while v:
                    left, right = tree[2 * v], tree[2 * v + 1]
                    low = left if left <= right else right
                    if tree[v] == low:
                        break
                    tree[v] = low
                    v >>= 1
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        return self.pack(text)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def _bpe(path: str) -> Bpe:
    return Bpe(read_ranks(path))


def _round_trip(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path or common.tokenizer_file(RANKS))
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(1).to_pylist():
                packed = bpe.encode(t)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranks_file: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle."""
    common.ship(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return d.mapInArrow(_round_trip(ranks_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranks_file: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""
    common.ship(docs.sparkSession)

    def run(batches):
        bpe = _bpe(ranks_file or common.tokenizer_file(RANKS))
        for b in batches:
            ids = [np.frombuffer(bpe.encode(t), "<u4").astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>")
