"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most `SIZE`; only longer ones are cut, and only their first piece is short, so
full pieces fill a sequence each and one short piece a document is left to pack. Short pieces are dealt at random
into blocks of about `BLOCK`; every block is evolved on `ISLANDS` islands. A crossover injects whole well-filled
bins of one parent into the other, drops the bins that hold the same pieces, and best-fits what that displaces.
Between epochs each island's elite migrates to the next. The better island's answer stands; pieces in bins that
are still loose in several blocks are pooled and packed once more.

Block and salt are written before use, so recomputed tasks see the same blocks. Defined cases: null text counts as
empty and gives one piece holding only the end id; repeated rows and null ids are packed like any other row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Ids

SIZE, END = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
BLOCK, ISLANDS, EPOCHS = 4096, 2, 2
GENERATIONS, POPULATION = 6, 4
#: Bins at least so full are worth injecting; bins below LOOSE are pooled over blocks at the end.
WELL, LOOSE = 0.99, 0.97
_PIECES = "doc_id long, uid long, salt int, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    common.env_threads()
    return Ids(path)


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then full ones."""
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def _tokenise(tokenizer: str | None, size: int):
    end = np.array([END], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = _ids(tokenizer or common.tokenizer_file(TOKENIZER))
        part = TaskContext.get().partitionId()
        rng, uid = np.random.default_rng(part), part << 33
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(np.concatenate([ids_of(t), end]).astype("<u4").tobytes())
                for piece, (s, n) in enumerate(cuts(len(ids) // 4, size)):
                    rows.append((i, uid, 0, piece, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
                    uid += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(rng.integers(0, 1 << 30, len(rows)).astype(np.int32)), pa.array(cols[3], pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.int64()) for c in cols[4:])], [f.split()[0] for f in _PIECES.split(", ")])

    return run


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Token pieces of every document, written."""
    common.ship(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return common.written(d.mapInArrow(_tokenise(tokenizer, size), _PIECES), "pieces")


def best_fit(lengths: list[int], order, bins: np.ndarray, free: dict[int, list[int]], next_bin: int, size: int) -> int:
    """Put items of `order` into the fullest bin that takes each; free: room -> bins. Returns the next bin number."""
    mask = 0
    for room, members in free.items():
        if members and room:
            mask |= 1 << room
    for i in order:
        s = lengths[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = size, next_bin
            next_bin += 1
        bins[i] = b
        left = room - s
        if left:
            free.setdefault(left, []).append(b)
            mask |= 1 << left
    return next_bin


def fitness(lengths: np.ndarray, bins: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins first, then bins as unevenly filled as can be."""
    load = np.bincount(bins, weights=lengths)
    load = load[load > 0]
    return -len(load), float(((load / size) ** 2).sum())


def crossover(lengths: np.ndarray, sizes: list[int], a: np.ndarray, b: np.ndarray, rng: np.random.Generator, size: int) -> np.ndarray:
    load = np.bincount(b, weights=lengths)
    good = np.flatnonzero(load >= WELL * size)
    if not len(good):
        good = np.flatnonzero(load >= np.quantile(load[load > 0], 0.8))
    take = np.zeros(len(load), bool)
    take[rng.permutation(good)[: max(1, len(good) // 2)]] = True
    injected = take[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    displaced = np.flatnonzero(hit[a] & ~injected)
    child = a.astype(np.int64)
    base = int(a.max()) + 1
    child[injected] = base + b[injected]
    child[displaced] = -1
    kept = child >= 0
    child[kept] = np.unique(child[kept], return_inverse=True)[1]
    load = np.bincount(child[kept], weights=lengths[kept]).astype(np.int64)
    free: dict[int, list[int]] = {}
    for bin_no, room in enumerate((size - load).tolist()):
        if room:
            free.setdefault(room, []).append(bin_no)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    best_fit(sizes, order.tolist(), child, free, len(load), size)
    return child


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], rng: np.random.Generator, size: int = SIZE, generations: int = GENERATIONS) -> np.ndarray:
    """The best assignment (bin number of each item) found from best-fit starts and the given ones."""
    sizes = lengths.tolist()
    people = [s for s in seeds if s is not None]
    down = np.argsort(-lengths, kind="stable")
    while len(people) < POPULATION:
        order = down if not people else down[np.argsort(np.arange(len(down)) + rng.uniform(0, len(down) / 10, len(down)))]
        bins = np.zeros(len(sizes), np.int64)
        best_fit(sizes, order.tolist(), bins, {}, 0, size)
        people.append(bins)
    scored = sorted(((fitness(lengths, p, size), i, p) for i, p in enumerate(people)), key=lambda x: x[0], reverse=True)
    least = -(-int(lengths.sum()) // size)
    for g in range(generations):
        if -scored[0][0][0] <= least:
            break
        other = scored[int(rng.integers(1, len(scored)))]
        one, two = (scored[0], other) if g % 2 else (other, scored[0])
        child = crossover(lengths, sizes, one[2], two[2], rng, size)
        scored[-1] = (fitness(lengths, child, size), g, child)
        scored.sort(key=lambda x: x[0], reverse=True)
    return np.unique(scored[0][2], return_inverse=True)[1]


def _island(size: int, epoch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        pdf = pdf.sort_values(["uid", "role"])
        own = pdf[pdf["role"] == 0]
        lengths = own["length"].to_numpy()
        seeds = [pdf[pdf["role"] == r]["bin"].to_numpy() for r in (0, 1)] if epoch else []
        best = evolve(lengths, [s for s in seeds if len(s) == len(lengths)], np.random.default_rng([block, island, epoch]), size)
        n, fit = fitness(lengths, best, size)
        return pd.DataFrame({"block": block, "island": island, "uid": own["uid"].to_numpy(), "length": lengths, "bin": best, "bins": -n, "fit": fit})

    return run


def _finish(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["bins", "fit", "island"], ascending=[True, False, True]).iloc[0]["island"]
        pdf = pdf[pdf["island"] == best].sort_values(["bin", "uid"])
        load = pdf.groupby("bin")["length"].transform("sum")
        return pd.DataFrame({
            "uid": pdf["uid"], "length": pdf["length"], "sequence_id": pdf.groupby("bin")["uid"].transform("min"),
            "offset": pdf.groupby("bin")["length"].cumsum() - pdf["length"], "loose": load < LOOSE * size,
        })

    return run


def pack_items(items: DataFrame, n: int, size: int = SIZE, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """uid, length, sequence_id, offset, loose for items (uid, salt, length), each shorter than `size`."""
    blocks = max(1, -(-n // BLOCK))
    schema = "block int, island int, uid long, length long, bin long, bins long, fit double"
    state = items.select((F.col("salt") % blocks).alias("block"), F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "uid", "length", F.lit(0).alias("role"), F.lit(0).cast("long").alias("bin"))
    for epoch in range(epochs):
        best = state.groupBy("block", "island").applyInPandas(_island(size, epoch), schema)
        if epoch < epochs - 1:
            moved = best.select("block", F.explode(F.array(F.struct("island", F.lit(0).alias("role")), F.struct(((F.col("island") + 1) % islands).alias("island"), F.lit(1).alias("role")))).alias("to"), "uid", "length", "bin")
            state = moved.select("block", "to.island", "uid", "length", "to.role", "bin")
    return best.groupBy("block").applyInPandas(_finish(size), "uid long, length long, sequence_id long, offset long, loose boolean")


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = pieces(docs, text_col, id_col, tokenizer, size)
    full = parts.where(F.col("length") == size).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    short = parts.where(F.col("length") < size)
    n = short.count()
    placed = pack_items(short.select("uid", "salt", "length"), n, size)
    if n > BLOCK:
        placed = common.written(placed, "packed")
        again = placed.where("loose")
        pool = again.count()
        salted = again.select("uid", F.pmod(F.xxhash64("uid"), F.lit(1 << 30)).cast("int").alias("salt"), "length")
        placed = placed.where("not loose").unionByName(pack_items(salted, pool, size))
    short = short.join(placed.select("uid", "sequence_id", "offset"), "uid")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(cols).unionByName(short.select(cols))
