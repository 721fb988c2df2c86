"""Substring deduplication with a log-structured fingerprint index.

A window is `WINDOW` (50) consecutive words. Its fingerprint is the least of its 35 rolling hashes of 16 words, so
equal windows have equal fingerprints and neighbours mostly share one: about one fingerprint in 18 words enters the
index, yet no window lacks one. The index is a folder of immutable runs, bucketed and sorted by fingerprint
(fingerprint, smallest and largest document, number of documents), and of manifests, each naming the runs of one
state; the newest counts, so a writer that dies leaves the state before it. A batch of documents becomes a run; merge
joins with the older runs tell which of its fingerprints history has, and `FANOUT` runs of a level are compacted into
one of the next. An index outlives its session: `FingerprintIndex(spark, path)` goes on where another one ended.

Only windows whose fingerprint two documents share are then verified: the 128-bit digest of the window's very words
decides, by its smallest document. Whole copies are settled by the digest of all their words and never expanded. The
few fingerprints and digests that hold more than 1 / HOT of the rows of a shuffle partition are broadcast (at most HOT
a partition, as there are no more), so that no join brings one key's rows to one task.

Defined cases: words are the runs between ASCII white space, unchanged; null text has no words; a null id counts as
the largest and equal to no smaller one; rows that share an id and a text are treated alike, and neither
removes from the other; texts of any length are read whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SUB = 50, 16
BATCHES, FANOUT, HOT = 3, 2, 16
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
LAST = (1 << 63) - 1


def window_fingerprints(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The fingerprint of each window start (signed); none for fewer than `window` words."""
    import xxhash

    n = len(words)
    if n < window:
        return np.zeros(0, np.int64)
    a = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    for mult, step in zip(_MULT, (1, 2, 4, 8), strict=True):
        a = a[:-step] * mult + a[step:]
        a ^= a >> np.uint64(29)
    span, w = window - SUB + 1, 1
    m = a
    while 2 * w <= span:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    if w < span:
        m = np.minimum(m[: len(m) - (span - w)], m[span - w :])
    return m.view(np.int64)


def _digest(joined: bytes) -> tuple[int, int]:
    import xxhash

    d = np.frombuffer(xxhash.xxh3_128_digest(joined), "<i8")
    return int(d[0]), int(d[1])


_DOC = "id long, none boolean, n_words long, d1 long, d2 long, sha string, fps array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, d1, d2, sha, fps = [], [], [], [], []
        for x in b.column(2):
            words = (x.as_py() or b"").split()
            joined = b" ".join(words)
            one, two = _digest(joined)
            n.append(len(words))
            d1.append(one)
            d2.append(two)
            sha.append(hashlib.sha256(joined).hexdigest())
            fps.append(np.unique(window_fingerprints(words)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (n, d1, d2)), pa.array(sha, pa.string()), pa.array(fps, pa.list_(pa.int64()))], [f.split()[0] for f in _DOC.split(", ")])


class FingerprintIndex:
    """Immutable sorted runs of (fp, lo, hi, n); `add` tells which fingerprints of a batch other documents have.

    `path` names the index's folder, a new one in the shared folder unless given; an index found there is opened.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or common.new_path(spark, "index")
        self.buckets, self.state, self.runs = buckets or common.slots(spark), 0, []
        found = [int(n.split("-")[1].split(".")[0]) for n in common.names(spark, self.path) if n.startswith("manifest-")]
        if found:
            self.state = max(found)
            held = json.loads(common.read_text(spark, f"{self.path}/manifest-{self.state}.json"))
            self.buckets, self.runs = held["buckets"], held["runs"]
            for run in self.runs:
                spark.sql(f"create table if not exists {run['name']} (fp long, lo long, hi long, n long) using parquet clustered by (fp) sorted by (fp) into {self.buckets} buckets location '{self.path}/{run['name']}'")

    def _write(self, rows: DataFrame, level: int) -> dict:
        name = f"tidewater_run_{uuid.uuid4().hex}"
        rows.select("fp", "lo", "hi", "n").repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").saveAsTable(name)
        return {"name": name, "level": level}

    def _commit(self, runs: list[dict]) -> None:
        """Name the runs of the new state, then delete those that it lacks."""
        gone = [r for r in self.runs if r not in runs]
        self.state, self.runs = self.state + 1, runs
        common.write_text(self.spark, f"{self.path}/manifest-{self.state}.json", json.dumps({"buckets": self.buckets, "runs": runs}))
        for r in gone:
            self.spark.sql(f"drop table if exists {r['name']}")
            common.remove(self.spark, f"{self.path}/{r['name']}")
        common.remove(self.spark, f"{self.path}/manifest-{self.state - 1}.json")

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """`batch`: fp, id. Returns tables (fp, n) of shared fp: within the batch, and with each older run; n counts documents."""
        run = self._write(batch.groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")), 0)
        new = self.spark.table(run["name"])
        shared = [common.written(new.where("lo < hi").select("fp", "n"), "shared")]  # runs go when compacted
        for r in self.runs:
            old = self.spark.table(r["name"]).select("fp", F.col("n").alias("m")).hint("merge")
            shared.append(common.written(new.select("fp", "n").join(old, "fp").select("fp", (F.col("n") + F.col("m")).alias("n")), "shared"))
        self._commit([*self.runs, run])
        self.compact()
        return shared

    def compact(self) -> None:
        """Merge the runs of each level that holds FANOUT of them."""
        level = 0
        while any(r["level"] >= level for r in self.runs):
            mine = [r for r in self.runs if r["level"] == level]
            if len(mine) >= FANOUT:
                rows = self.spark.table(mine[0]["name"])
                for r in mine[1:]:
                    rows = rows.unionByName(self.spark.table(r["name"]))
                merged = self._write(rows.groupBy("fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")), level + 1)
                self._commit([*(r for r in self.runs if r not in mine), merged])
            level += 1

    def drop(self) -> None:
        """Delete the index."""
        for r in self.runs:
            self.spark.sql(f"drop table if exists {r['name']}")
        common.remove(self.spark, self.path)
        self.runs, self.state = [], 0


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with `table` (keys, n, ...), where n tells about how many of the `total` rows have a key.

    Keys with more than a HOT-th of a shuffle partition's rows are joined by broadcast; `total` bounds their number.
    """
    limit = max(1, total // (HOT * common.slots(rows.sparkSession)))
    hot = table.where(F.col("n") > limit).drop("n").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), keys, "left")
    rest = marked.where("_hot is null").select(*rows.columns).join(table.where(F.col("n") <= limit).drop("n"), keys)
    return marked.where("_hot").drop("_hot").unionByName(rest)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a shared fingerprint: digest, document, place."""
    import xxhash

    def out(cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w1", "w2", "id", "d1", "d2", "at"])

    for b in batches:
        for i, text, fps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = (text or b"").split()
            at = np.flatnonzero(np.isin(window_fingerprints(words), fps.values.to_numpy()))
            if not len(at):
                continue
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[at].tolist()
            stops = (ends[at + WINDOW - 1] - 1).tolist()
            raw = b"".join([xxhash.xxh3_128_digest(joined[s:e]) for s, e in zip(starts, stops, strict=True)])
            w = np.frombuffer(raw, "<i8").reshape(-1, 2)
            d1, d2 = _digest(joined)
            n = len(at)
            yield out([w[:, 0].copy(), w[:, 1].copy(), np.full(n, i, np.int64), np.full(n, d1, np.int64), np.full(n, d2, np.int64), at.astype(np.int32)])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, d1, d2 and what is left of a document without the words that its windows `at` cover."""
    for b in batches:
        rows = []
        for i, text, d1, d2, at in zip(*(b.column(k) for k in range(5)), strict=True):
            words = (text.as_py() or b"").split()
            if _digest(b" ".join(words)) != (d1.as_py(), d2.as_py()):
                continue  # another text under the same id
            gone = np.zeros(len(words) + 1, np.int64)
            starts = at.values.to_numpy()
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + WINDOW, -1)
            left = np.cumsum(gone)[:-1] == 0
            kept = b" ".join([words[k] for k in np.flatnonzero(left).tolist()])
            rows.append((i.as_py(), d1.as_py(), d2.as_py(), int((~left).sum()), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], ["id", "d1", "d2", "n_removed", "kept_text", "kept_sha256"])


def shared_fingerprints(read: DataFrame, batches: int = BATCHES) -> DataFrame:
    """fp that several documents have, and n at least their number, by adding `read` (id, fps) to an index in batches of ascending id."""
    spark = read.sparkSession
    cuts = read.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0] or []
    index, shared = FingerprintIndex(spark), []
    fps = read.select("id", F.explode("fps").alias("fp"))
    bounds = [None, *sorted(set(cuts)), None]
    try:
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            part = fps
            part = part.where(F.col("id") > lo) if lo is not None else part
            part = part.where(F.col("id") <= hi) if hi is not None else part
            shared += index.add(part)
        out = shared[0]
        for s in shared[1:]:
            out = out.unionByName(s)
        return common.written(out.groupBy("fp").agg(F.sum("n").alias("n")), "shared")
    finally:
        index.drop()


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text where words went, if asked for)."""
    common.ship(docs.sparkSession)
    n = F.col(f"`{id_col}`").cast("long")
    src = docs.select(F.coalesce(n, F.lit(LAST)).alias("id"), n.isNull().alias("none"), common.text_of(text_col).cast("binary").alias("text"))
    raw = common.written(src.mapInArrow(_read, _DOC), "read")
    whole = ["d1", "d2", "n_words"]
    firsts = raw.where(f"n_words >= {WINDOW}").groupBy(*whole).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    limit = max(1, raw.count() // (HOT * common.slots(docs.sparkSession)))  # as in join_spread, but every row stays
    marked = raw.join(F.broadcast(firsts.where(F.col("n") > limit).drop("n")), whole, "left")
    rest = marked.where("first is null").drop("first").join(firsts.where((F.col("n") > 1) & (F.col("n") <= limit)).drop("n"), whole, "left")
    read = marked.where("first is not null").unionByName(rest).withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    read = common.written(read.select("id", "none", "n_words", "d1", "d2", "sha", "copy", F.when(~F.col("copy"), F.col("fps")).otherwise(F.array().cast("array<long>")).alias("fps")), "read")
    common.release(docs.sparkSession)
    shared = shared_fingerprints(read.where("not copy").select("id", "fps"), batches)
    common.release(docs.sparkSession)
    total = read.where("not copy").agg(F.coalesce(F.sum(F.size("fps")), F.lit(0))).first()[0]
    hits = join_spread(read.where("not copy").select("id", F.explode("fps").alias("fp")), shared, ["fp"], total).groupBy("id").agg(F.collect_list("fp").alias("fps"))
    windows = common.written(src.join(hits, "id").select("id", "text", "fps").mapInArrow(_expand, "w1 long, w2 long, id long, d1 long, d2 long, at int"), "windows")
    common.release(docs.sparkSession)
    low = common.written(windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("w1", "w2", "low", "n"), "low")
    gone = join_spread(windows, low, ["w1", "w2"], windows.count()).where("low < id").groupBy("id", "d1", "d2").agg(F.collect_set("at").alias("at"))
    gone = common.written(gone, "gone")
    for done in (raw, shared, windows, low):
        common.drop_written(done)
    common.release(docs.sparkSession)
    left = src.join(gone, "id").select("id", "text", "d1", "d2", "at").mapInArrow(_keep, "id long, d1 long, d2 long, n_removed long, kept_text string, kept_sha256 string")
    left = left.dropDuplicates(["id", "d1", "d2"]).select("id", "d1", "d2", F.col("n_removed").alias("r"), F.col("kept_sha256").alias("k"), *(["kept_text"] if with_text else []))
    nothing = hashlib.sha256(b"").hexdigest()
    out = read.drop("fps").join(left, ["id", "d1", "d2"], "left")
    cols = [
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"),
    ]
    return out.select(*cols, *(["kept_text"] if with_text else []))
