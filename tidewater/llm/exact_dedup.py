"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts (a prefix of their bytes, a hash, then the id), each partition
is sorted externally by that and the whole text, and neighbours are compared in full. Ids are part of the sort key, so a group that holds a third of
all rows spreads over many partitions; the first row of a run has its smallest id. A run that touches a
partition's edge may go on next door: each partition reports its first and last text (two rows, bounded by the
number of partitions), neighbouring edges are compared in full by a join, and their counts are chained.

Defined cases: null text counts as empty; texts are equal after each run of ASCII white space becomes one space
(leading and trailing runs too); a null id counts as larger than any other, and keep_id is null only in a group
with no other; of rows with the same id and text exactly one is kept; an empty table gives an empty result;
extra columns, whatever their names, are ignored by `content_groups` and passed on by `exact_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_OUT = "id long, keep_id long, size long, first boolean, sha string, pid int, edge int, head string, tail string, head_size long, head_id long, tail_size long, tail_id long, single boolean"
#: Characters of the text that splitters hold.
PREFIX = 24
#: edge: which runs of its partition a row belongs to.
INNER, HEAD, TAIL, BOTH, REPORT = 0, 1, 2, 3, 4


def normalised(c: str):
    return F.regexp_replace(common.text_of(c), common.SPACE + "+", " ")


class _Runs:
    """Runs of equal neighbours in one sorted partition, given batch by batch. Only ids of the open run are held."""

    def __init__(self, pid: int):
        self.pid, self.text, self.n_runs = pid, None, 0
        self.ids: list[pa.Array] = []
        self.sha = self.head = self.head_text = None

    def _rows(self, ids: pa.Array, sha: pa.Array, keep: pa.Array, size: np.ndarray, first: np.ndarray, edge: int) -> pa.RecordBatch:
        n = len(ids)
        none = [pa.nulls(n, pa.string())] * 2 + [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.bool_())]
        fixed = [pa.array(np.full(n, self.pid, np.int32)), pa.array(np.full(n, edge, np.int32))]
        return self._batch([ids, keep, pa.array(size), pa.array(first), sha, *fixed, *none])

    @staticmethod
    def _batch(arrays: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _OUT.split(", ")])

    def _close(self, last: bool) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids)
        edge = (HEAD if self.n_runs == 1 else INNER) | (TAIL if last else INNER)
        if self.n_runs == 1:
            self.head = (len(ids), ids[0])
        first = np.zeros(len(ids), bool)
        first[0] = True
        keep = pa.array([ids[0].as_py()] * len(ids), pa.int64())
        yield self._rows(ids, pa.array([self.sha] * len(ids), pa.string()), keep, np.full(len(ids), len(ids), np.int64), first, edge)
        if last:
            report = [None, None, None, None, None, self.pid, REPORT, self.head_text, self.text, *self.head, len(ids), ids[0], self.n_runs == 1]
            yield self._batch([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x], t) for x, t in zip(report, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_()), strict=True)])

    def add(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, text, sha = b.column(0), b.column(1), b.column(2)
        n = len(ids)
        if n == 0:
            return
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = self.text is None or text[0].as_py() != self.text
        starts = np.flatnonzero(new)
        open_until = starts[0] if len(starts) else n
        if open_until:
            self.ids.append(ids.slice(0, open_until))
        if len(starts):
            if self.ids:
                yield from self._close(False)
            # Runs that begin and end within this batch.
            begins, ends = starts[:-1], starts[1:]
            from_run = 0
            if self.n_runs == 0 and len(begins):  # the first is the partition's head
                self.n_runs, self.head_text = 1, text[int(begins[0])].as_py()
                self.ids, self.sha = [ids.slice(int(begins[0]), int(ends[0] - begins[0]))], sha[int(begins[0])].as_py()
                yield from self._close(False)
                from_run = 1
            if len(begins) > from_run:
                b0, e0 = begins[from_run:], ends[from_run:]
                lo, hi = int(b0[0]), int(e0[-1])
                sizes = e0 - b0
                first = np.zeros(hi - lo, bool)
                first[b0 - lo] = True
                keep = pc.take(ids, pa.array(np.repeat(b0, sizes)))
                yield self._rows(ids.slice(lo, hi - lo), sha.slice(lo, hi - lo), keep, np.repeat(sizes, sizes).astype(np.int64), first, INNER)
                self.n_runs += len(b0)
            last = int(starts[-1])
            self.n_runs += 1
            self.ids, self.sha = [ids.slice(last)], sha[last].as_py()
            self.text = text[last].as_py()
            if self.n_runs == 1:
                self.head_text = self.text

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            yield from self._close(True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    runs = _Runs(TaskContext.get().partitionId())
    for b in batches:
        yield from runs.add(b)
    yield from runs.end()


def _chain(edges: DataFrame) -> list[tuple]:
    """(pid, edge, keep_id, size, starts) for edge runs that reach over partitions. Two figures a partition reach the driver."""
    spark = edges.sparkSession
    facts = {r.pid: r for r in edges.select("pid", "head_size", "head_id", "tail_size", "tail_id", "single", F.xxhash64("head").alias("hh"), F.xxhash64("tail").alias("th")).collect()}
    pids = sorted(facts)
    prior = [(b, a) for a, b in zip(pids, pids[1:], strict=False) if facts[a].th == facts[b].hh]
    if not prior:
        return []
    # The hashes only choose which edges to compare; the texts themselves decide.
    near = F.broadcast(spark.createDataFrame(prior, "pid int, prior int"))
    a = edges.join(near.withColumnRenamed("pid", "at").withColumnRenamed("prior", "pid"), "pid").select("at", "tail")
    b = edges.join(near.select("pid"), "pid").select(F.col("pid").alias("at"), "head")
    goes_on = {r.at for r in a.join(b, "at").where(F.col("head") == F.col("tail")).select("at").collect()}

    out, chain = [], []

    def flush() -> None:
        if len(chain) > 1:
            keep, size = chain[0][2], sum(x[3] for x in chain)
            out.extend((p, edge, keep, size, i == 0) for i, (p, edge, _, _) in enumerate(chain))
        chain.clear()

    for p in pids:
        f = facts[p]
        if p not in goes_on:
            flush()
        if f.single:
            chain.append((p, BOTH, f.head_id, f.head_size))
        else:
            if p in goes_on:
                chain.append((p, HEAD, f.head_id, f.head_size))
                flush()
            chain.append((p, TAIL, f.tail_id, f.tail_size))
    flush()
    return out


def content_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    common.ship(spark)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), normalised(text_col).alias("text"))
    # Splitters hold a prefix and a hash of the text, so that sampling sends no whole texts to the driver. The sort below
    # keeps that order and breaks its ties by the text itself.
    d = d.withColumns({"prefix": F.substring("text", 1, PREFIX), "hash": F.xxhash64("text")})
    last = F.col("id").asc_nulls_last()
    d = d.repartitionByRange(partitions or common.slots(spark), "prefix", "hash", last).sortWithinPartitions("prefix", "hash", "text", last)
    runs = common.written(d.select("id", "text", F.sha2("text", 256).alias("sha")).mapInArrow(_runs, _OUT), "runs")
    over = _chain(runs.where(F.col("edge") == REPORT))
    rows = runs.where(F.col("edge") != REPORT).select("id", "keep_id", "size", "first", "sha", "pid", "edge")
    if over:
        fix = F.broadcast(spark.createDataFrame(over, "pid int, edge int, k long, s long, starts boolean"))
        rows = rows.join(fix, ["pid", "edge"], "left").select(
            "id", F.when(F.col("s").isNotNull(), F.col("k")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("s", "size").alias("size"),
            (F.col("first") & F.coalesce("starts", F.lit(True))).alias("first"), "sha",
        )
    return rows.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), F.col("first").alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with its columns, without the rows whose normalised text a smaller id has."""
    cols = docs.columns
    groups = content_groups(docs, text_col, id_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.sha2(normalised(text_col), 256).alias("_sha"))
    keep = groups.where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    on = keyed["_id"].eqNullSafe(keep["k_id"]) & (keyed["_sha"] == keep["k_sha"])
    out = keyed.join(keep, on, "left_semi")
    again = groups.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kept").cast("int")).alias("k")).where("n > 1 and k = 1")
    if not again.isEmpty():  # rows repeated with their id: one of them stays
        from pyspark.sql import Window

        hit = again.select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
        on = out["_id"].eqNullSafe(hit["k_id"]) & (out["_sha"] == hit["k_sha"])
        one = out.join(hit, on, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("_sha"))).where("_n = 1").drop("_n")
        out = out.join(hit, on, "left_anti").unionByName(one)
    return out.select("row.*")
