"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints within `DISTANCE` (3) bits link. A fingerprint is cut into two 32-bit segments; of
three differing bits at most one falls into one of the two segments, so a linked pair agrees on a segment
but for at most one bit. The index holds, for each distinct fingerprint and segment, the exact value and its
32 one-wildcard variants. A wildcard entry also says what its bit was, and entries join only across the two
values: a pair whose segment differs in exactly one bit meets once, and a pair whose segment is equal meets
once under the exact key. Candidates are verified by popcount in the join itself.

Copies never enter the index: it is built over distinct fingerprints. Components come from alternating
large-star and small-star steps over links, all as joins and partial aggregates.

Fingerprints that share a key are compared in pairs, in one task a key and with the square of their number, though none
has more than 5,488 links there. Where a segment value has more than `DENSE` / 2 fingerprints, the entries of its keys
are cut once more by wildcards in the other segment instead (three places under an exact key, two under a wildcard one).
All that then agree, at most eight, link with each other, so each meets the least of them: up to 4,960 rows an entry, on
all tasks, and no component changes. That costs far more than pairs in small groups, so the bound is high.

Joins of tables that grow with the input are sort-merge joins by hint: Spark doesn't count what explode adds, so it would
take the exploded index for a small table and gather it on the driver.

Defined cases: null or blank text has fingerprint zero, linked like any other; fewer than three words hash as
one shingle; rows with a null id belong to their component and never name it (an all-null component has a null
id); repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common

SHINGLE = 3
DISTANCE = 3
#: Shingles of one text handled at once.
CHUNK = 1 << 16
#: Up to so many entries of a key are compared in pairs: a few minutes of one task.
DENSE = 1 << 18


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text; unsigned."""
    import xxhash

    words = (text or b"").lower().split()  # for bytes, lower() maps A-Z only
    if not words:
        return 0
    grams = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, grams, CHUNK):
        n = min(CHUNK, grams - at)
        part = words[at : at + n + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > grams, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, fp (the unsigned fingerprint's bits as a signed long)."""
    common.ship(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), common.text_of(text_col).cast("binary").alias("text"))
    return d.mapInArrow(_fingerprints, "id long, fp long")


#: The key of a segment's value with the bit at place `at` masked; place 32 masks none.
KEY = "shiftleft(bigint(seg * 64 + at), 32) | if(at < 32, value & ~shiftleft(1L, at), value)"


def index_entries(fps: DataFrame, places: range = range(33)) -> DataFrame:
    """66 entries for a fingerprint `fp`: key long (segment, wildcard place, masked value), bit (null for exact)."""
    i = F.array([F.lit(33 * seg + at) for seg in (0, 1) for at in places])
    e = fps.select("fp", F.explode(i).alias("i")).select("fp", F.expr("int(i div 33)").alias("seg"), F.expr("i % 33").alias("at"))
    e = e.withColumn("value", F.expr("shiftrightunsigned(fp, 32 * seg) & 4294967295L"))
    return e.select("fp", F.expr(KEY).alias("key"), F.expr("if(at < 32, tinyint(shiftrightunsigned(value, at) & 1L), null)").alias("bit"))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All links between distinct fingerprints (column fp): a, b with a < b as signed longs; each once or twice."""
    return _pairs(index_entries(fps), distance)


def _pairs(e: DataFrame, distance: int) -> DataFrame:
    left = e.where("bit is null or bit = 0").select(F.col("fp").alias("a"), "key", F.col("bit").alias("ba"))
    right = e.where("bit is null or bit = 1").select(F.col("fp").alias("b"), "key")
    # Under a wildcard key the sides differ in the bit, so each pair meets once; under an exact key order decides.
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("ba").isNotNull() | (F.col("a") < F.col("b")))
    pairs = left.join(right.hint("merge"), "key").where(near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def crowded_keys(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """The keys, exact and wildcard, of segment values with over `dense` / 2 fingerprints; any other key has at most `dense`."""
    n = index_entries(fps, range(32, 33)).groupBy("key").count().where(F.col("count") > dense // 2)
    v = n.select(F.expr("int(shiftright(key, 38))").alias("seg"), F.expr("key & 4294967295L").alias("value"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("at"))
    return v.select(F.expr(KEY).alias("key")).distinct()


def _stars(e: DataFrame, distance: int) -> DataFrame:
    """Links that join what the entries' pairs join, by wildcards in the other segment; the masks are a table of fixed size."""
    masks = [(wild, sum(1 << i for i in c)) for wild in (False, True) if distance >= wild for c in combinations(range(32), distance - wild)]
    m = e.sparkSession.createDataFrame(masks, "wild boolean, mask long")
    other = F.expr("shiftrightunsigned(fp, 32 * (1 - int(shiftright(key, 38)))) & 4294967295L").alias("other")
    alike = e.select("fp", "key", F.col("bit").isNotNull().alias("wild"), other).join(F.broadcast(m), "wild")
    groups = alike.groupBy("key", "mask", F.expr("other & ~mask").alias("rest")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")


def spanning_links(fps: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """Links (a, b) whose components are those of all links, without comparing all pairs of a crowded key."""
    crowded = common.written(crowded_keys(fps, dense), "crowded")
    if crowded.isEmpty():
        return links(fps, distance)
    e = index_entries(fps)
    return _pairs(e.join(crowded.hint("merge"), "key", "left_anti"), distance).unionByName(_stars(e.join(crowded.hint("merge"), "key", "left_semi"), distance))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of `edges` (a, b): root is the smallest node reachable.

    Large-star then small-star until nothing changes; each round is written to the shared folder.
    """
    cur = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2.hint("merge"), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        nxt = common.written(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "links")
        now = nxt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        common.drop_written(cur)
        cur = nxt
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    fp = common.written(fingerprints(docs, text_col, id_col), "fingerprints")
    nodes = common.written(fp.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    comp = components(spanning_links(nodes.select("fp"), distance))
    named = nodes.join(comp.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = named.join(names.hint("merge"), "root").select("fp", "component_id")
    return fp.join(labels.hint("merge"), "fp", "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@F.arrow_udf(LongType())
def _fingerprint_of(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in text], np.uint64).view(np.int64))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """`docs` with its columns, one row for each component: the smallest id's (of rows that share or lack it, one).

    Rows are written once with a key of their own, as an id may be null or name several unlike rows.
    """
    common.ship(docs.sparkSession)
    mark, key = common.free_name(docs, "_tw_fp"), common.free_name(docs, "_tw_row")
    fp = _fingerprint_of(common.text_of(text_col).cast("binary"))
    rows = common.written(docs.withColumn(mark, fp).withColumn(key, F.monotonically_increasing_id()), "rows")
    n = F.col(f"`{id_col}`").cast("long")
    nodes = common.written(rows.groupBy(F.col(mark).alias("fp")).agg(F.min(F.struct(n.isNull().alias("none"), n.alias("id"), F.col(key).alias("row"))).alias("first")), "nodes")
    comp = components(spanning_links(nodes.select("fp"), distance))
    roots = nodes.join(comp.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return rows.join(roots.select(F.col("first.row").alias(key)).hint("merge"), key, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
