"""Quality rules with risk-controlled thresholds.

Counts per document are exact and cover the whole text. Cutoffs on five ratios are fitted to labelled documents: a
quarter of them (by a hash of the id) propose a path of cutoff vectors from lenient to strict, the others test it. A
vector is certified for a stratum when the exact (Clopper-Pearson) upper bound on its false-rejection rate is at most
`alpha`; strata share the error probability `DELTA` by Bonferroni, and within a stratum the path is walked in fixed
sequence and left at the first failure, which needs no further correction. Of the certified vectors the one that
rejects most labelled junk is used, the most lenient of equals. Strata with too few good test documents to certify
even a cutoff without a false rejection are tested together, as one stratum; this is settled by their numbers alone,
and the bound then holds for their mixture. A stratum without labels, or whose test fails, rejects nothing beyond the
base rule.

The rules are fitted by `fit_all` to every labelled id: a document is counted once and its counts written; largest
values, quantiles (of all values, by their exact ranks) and the tests' numbers are aggregates, so the driver holds a
few figures a stratum, whatever the number of labels. `fit` does the same in memory on about `MAX_LABELS` ids of each
stratum, for tables at hand; no query calls it.

Defined cases: null text has no words and fails the base rule; a null stratum is its own stratum; an id counts once,
as good if any of its labels is, with the least stratum and ratios of its rows; without labels only the base rule
decides; an empty table gives an empty result; clashing column names are safe, as counts live in a column with a name
that the table lacks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
ALPHA, DELTA = 0.01, 0.05
MAX_LABELS = 20_000
#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
#: Shares of good documents that successive cutoffs may reject on the proposing half; before them, margins over the largest good value.
MARGINS, SHARES = (2.0, 1.5, 1.25, 1.1, 1.0), (0.0005, 0.001, 0.002, 0.004)
RATIOS = ("symbols", "dup_lines", "repeats", "capitals", "bangs")
_FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint, n_bangs bigint"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = ids[:-1] * len(seen) + ids[1:]
    pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    tri = pair[:-1] * len(seen) + ids[2:]  # below n * n, so exact
    _, inv, count = np.unique(tri, return_inverse=True, return_counts=True)
    hit = count[inv] > 1
    cover = np.zeros(n, bool)
    for i in range(3):
        cover[i : i + n - 2] |= hit
    return int(cover.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The fields of `_FIELDS` for one UTF-8 text."""
    words = text.split()
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(by[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)] if b"\n" in text else [b""] if words else []
    white = int(by[list(WHITE)].sum())
    return (len(words), points - white, int(by[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines), int(by[65:91].sum()), int(by[33]))


def _counts_udf():
    @F.arrow_udf(f"struct<{_FIELDS.replace(' bigint', ':bigint')}>")
    def quality_counts(text: pa.Array) -> pa.Array:
        got = np.array([counts(x.as_py() or b"") for x in text], np.int64).reshape(-1, 8)
        return pa.StructArray.from_arrays([pa.array(c) for c in got.T], [f.split()[0] for f in _FIELDS.split(", ")])

    return quality_counts.asNondeterministic()  # evaluated once, also where a filter reads it


def with_counts(docs: DataFrame, text_col: str = "text", name: str = "_quality") -> DataFrame:
    common.ship(docs.sparkSession)
    return docs.withColumn(name, _counts_udf()(common.text_of(text_col).cast("binary")))


def ratios(q: Column) -> list[Column]:
    words = F.greatest(q["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(q["n_lines"], F.lit(1)).cast("double")
    chars = F.greatest(q["word_chars"], F.lit(1)).cast("double")
    return [q["n_symbols"] / words, q["n_dup_lines"] / lines, q["n_repeat_words"] / words, q["n_capitals"] / chars, q["n_bangs"] / words]


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n still has probability delta."""
    if k >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return math.fsum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(log_choose))

    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if tail(min(max(p, 1e-15), 1 - 1e-15)) > delta else (lo, p)
    return hi


def path(good: np.ndarray) -> list[np.ndarray]:
    """Cutoff vectors from lenient to strict, from the proposing quarter's good documents (rows of ratios)."""
    return path_of(good.max(0), [np.quantile(good, 1 - s, axis=0) for s in SHARES])


def path_of(top: np.ndarray, quantiles: list[np.ndarray]) -> list[np.ndarray]:
    return [top * m + 0.01 * m for m in MARGINS] + [np.minimum(top, q) for q in quantiles]


def walk(cuts: list[np.ndarray], false: list[int], caught: list[int], n: int, delta: float, alpha: float) -> tuple[np.ndarray | None, float]:
    """The chosen of a path's cutoff vectors (None: nothing certified) and its bound; false: what each rejects of n good test documents; caught: what of junk."""
    best, most, bound_of = None, -1, 1.0
    for cut, k, hits in zip(cuts, false, caught, strict=True):
        bound = upper_bound(k, n, delta)
        if bound > alpha:
            break
        if hits > most:
            best, most, bound_of = cut, hits, bound
    return best, bound_of


def certify(x: np.ndarray, good: np.ndarray, propose: np.ndarray, delta: float, alpha: float = ALPHA) -> tuple[np.ndarray | None, float]:
    """The chosen cutoff vector (None: nothing certified) and its bound on false rejection."""
    test = x[good & ~propose]
    if not (good & propose).any() or not len(test):
        return None, 1.0
    cuts, junk = path(x[good & propose]), x[~good]
    over = lambda some: [int((some > cut).any(1).sum()) for cut in cuts]
    return walk(cuts, over(test), over(junk), len(test), delta, alpha)


def proposes(i: int) -> bool:
    """Whether a labelled id belongs to the proposing quarter."""
    return (i * 2654435761 >> 16) % 4 == 0


#: The same in SQL: only the lowest 18 bits of the id tell.
PROPOSES = "shiftright((_lid & 262143L) * 2654435761L, 16) & 3L = 0"


def pooled(sizes: dict, alpha: float) -> dict:
    """stratum -> the group that it is tested in: itself (as a pair), or None for those that can certify nothing alone."""
    own = set(sizes)
    while True:
        groups = len(own) + (len(own) < len(sizes))
        small = {s for s in own if upper_bound(0, sizes[s], DELTA / groups) > alpha} if groups else set()
        if not small:
            return {s: (s,) if s in own else None for s in sizes}
        own -= small


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str | None = "lang", alpha: float = ALPHA) -> dict:
    """stratum -> (cutoffs, bound on false rejection), from about MAX_LABELS labelled ids of each stratum."""
    common.ship(docs.sparkSession)
    lab = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_lid")).agg(F.max(F.col("quality").cast("int") == 1).alias("_good"))
    stratum = F.col(f"`{stratum_col}`").cast("string") if stratum_col in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("_lid"), stratum.alias("_stratum"), F.col(f"`{text_col}`").alias("_text"))
    known = common.written(d.groupBy("_lid").agg(F.min("_stratum").alias("_stratum")).join(lab, "_lid"), "labelled")
    share = F.lit(1.0)
    for r in known.groupBy("_stratum").count().where(F.col("count") > MAX_LABELS).collect():
        share = F.when(F.col("_stratum").eqNullSafe(F.lit(r._stratum)), MAX_LABELS / r["count"]).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("_lid"), F.lit(1 << 40)) < share * float(1 << 40)).withColumnRenamed("_stratum", "_of")
    d = d.join(F.broadcast(picked), "_lid").where(F.col("_stratum").eqNullSafe(F.col("_of")))
    q = F.col("_c")
    one = with_counts(d, "_text", "_c").select("_lid", "_good", "_stratum", F.struct(base_failed(q).alias("failed"), F.array(*ratios(q)).alias("x")).alias("_m"))
    got = one.groupBy("_lid", "_stratum", "_good").agg(F.min("_m").alias("_m")).orderBy("_lid").collect()
    rows = [(r._stratum, r._m.x, r._good, proposes(r._lid)) for r in got if not r._m.failed]
    sizes: dict = {}
    for s, _, good, propose in rows:
        sizes[s] = sizes.get(s, 0) + (good and not propose)
    group, by = pooled(sizes, alpha), {}
    for s, *row in rows:
        by.setdefault(group[s], []).append(row)
    found = {}
    for g, some in by.items():
        x, good, propose = (np.array(c) for c in zip(*some, strict=True))
        cut, bound = certify(x, good, propose, DELTA / len(by), alpha)
        if cut is not None:
            found[g] = ([float(c) for c in cut], bound)
    return {s: found[g] for s, g in group.items() if g in found}


#: From so many values on, ranks are sought among the values from this percentile up (the highest shares, with room for its error) only.
MANY, HIGH, ERROR = 10_000, 0.99, 10_000


def places(n: int) -> list[tuple[int, int, float]]:
    """For each of SHARES, the two ranks (from the largest of n values, which is 0) between which the quantile lies, and how far it is from the first to the second."""
    out = []
    for s in SHARES:
        at = (n - 1) * (1 - s)
        low = math.floor(at)
        out.append((n - 1 - low, n - 1 - min(low + 1, n - 1), at - low))
    return out


def quantiles(values: DataFrame) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """group g -> the largest value of each ratio and its quantiles at 1 - SHARES, of all values (g, j, v)."""
    spark = values.sparkSession
    tops = values.groupBy("g", "j").agg(F.max("v").alias("top"), F.count("v").alias("n"), F.percentile_approx("v", HIGH, ERROR).alias("high")).collect()
    if not tops:
        return {}
    wanted = [(r.g, r.j, r.high if r.n >= MANY else -1.0, sorted({k for lo, hi, _ in places(r.n) for k in (lo, hi)})) for r in tops]
    some = values.join(F.broadcast(spark.createDataFrame(wanted, "g int, j int, high double, ranks array<long>")), ["g", "j"]).where("v >= high")
    tally = some.groupBy("g", "j", "v").agg(F.count("v").alias("c"), F.first("ranks").alias("ranks"))
    upto = F.sum("c").over(Window.partitionBy("g", "j").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0))
    hit = tally.withColumn("upto", upto).withColumn("ranks", F.expr("filter(ranks, r -> r < upto and r >= upto - c)")).where("size(ranks) > 0")
    at = {(r.g, r.j, k): r.v for r in hit.collect() for k in r.ranks}
    out: dict = {}
    for r in sorted(tops, key=lambda r: (r.g, r.j)):
        top, rest = out.setdefault(r.g, ([], [[] for _ in SHARES]))
        top.append(r.top)
        for held, (lo, hi, t) in zip(rest, places(r.n), strict=True):
            held.append(np.quantile(np.array([at[r.g, r.j, lo], at[r.g, r.j, hi]]), t))
    return {g: (np.array(top), [np.array(q) for q in rest]) for g, (top, rest) in out.items()}


def fit_all(d: DataFrame, labels: DataFrame, alpha: float = ALPHA) -> dict:
    """stratum -> (cutoffs, bound on false rejection), from every labelled id. d: _lid long, _stratum string, _c as `with_counts` gives it."""
    lab = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_lid")).agg(F.max(F.col("quality").cast("int") == 1).alias("good"))
    s, q = F.col("_stratum"), F.col("_c")
    m = F.struct(s.isNull().alias("none"), s.alias("s"), base_failed(q).alias("failed"), F.array(*ratios(q)).alias("x")).alias("_m")
    one = d.where("_lid is not null").select("_lid", m).join(lab.hint("merge"), "_lid").groupBy("_lid", "good").agg(F.min("_m").alias("_m"))
    one = common.written(one.where("not _m.failed").select("good", F.expr(PROPOSES).alias("propose"), "_m.s", "_m.x"), "labelled")
    sizes = {r.s: r.n for r in one.groupBy("s").agg(F.count_if(F.expr("good and not propose")).alias("n")).collect()}
    group = pooled(sizes, alpha)
    groups = sorted(set(group.values()), key=str)
    if not groups:
        return {}
    g = F.lit(groups.index(None) if None in groups else -1)
    for k, of in enumerate(groups):
        g = g if of is None else F.when(F.col("s").eqNullSafe(F.lit(of[0])), k).otherwise(g)
    one = one.withColumn("g", g)
    paths = {k: path_of(*found) for k, found in quantiles(one.where("good and propose").select("g", F.posexplode("x").alias("j", "v"))).items()}
    if not paths:
        return {}
    table = one.sparkSession.createDataFrame([(k, [[float(c) for c in cut] for cut in cuts]) for k, cuts in paths.items()], "g int, cuts array<array<double>>")
    # How many of the path's cutoffs reject a row isn't enough, as quantiles of ratios need not fall together; each is counted.
    over = one.join(F.broadcast(table), "g").select("g", "good", "propose", F.expr("transform(cuts, c -> exists(zip_with(x, c, (a, b) -> a > b), y -> y))").alias("over"))
    steps = range(len(MARGINS) + len(SHARES))
    test = F.expr("good and not propose")
    counted = over.groupBy("g").agg(
        F.count_if(test).alias("n"), F.array(*(F.count_if(test & F.col("over")[k]) for k in steps)).alias("false"), F.array(*(F.count_if(~F.col("good") & F.col("over")[k]) for k in steps)).alias("caught")
    )
    found = {}
    for r in counted.collect():
        if r.n:
            cut, bound = walk(paths[r.g], r.false, r.caught, r.n, DELTA / len(groups), alpha)
            if cut is not None:
                found[groups[r.g]] = ([float(c) for c in cut], bound)
    return {k: found[of] for k, of in group.items() if of in found}


def verdict(q: Column, stratum: Column, cuts: dict) -> Column:
    """True where no ratio is above its stratum's cutoff."""
    bad = F.lit(False)
    for s, (cut, _) in sorted(cuts.items(), key=lambda kv: str(kv[0])):
        over = F.lit(False)
        for r, c in zip(ratios(q), cut, strict=True):
            over = over | (r > F.lit(c))
        bad = F.when(stratum.eqNullSafe(F.lit(s)), over).otherwise(bad)
    return ~bad


def bound_of(stratum: Column, cuts: dict) -> Column:
    """The bound on the false-rejection rate of the cutoffs that decide on a stratum; null where none do."""
    out = F.lit(None).cast("double")
    for s, (_, bound) in sorted(cuts.items(), key=lambda kv: str(kv[0])):
        out = F.when(stratum.eqNullSafe(F.lit(s)), F.lit(bound)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str | None = "lang", alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejection_bound."""
    stratum = F.col(f"`{stratum_col}`").cast("string") if stratum_col in docs.columns else F.lit(None).cast("string")
    d = with_counts(docs.select(F.col(f"`{id_col}`").alias("doc_id"), stratum.alias("_stratum"), F.col(f"`{text_col}`").alias("_text")), "_text")
    d = common.written(d.drop("_text"), "counts")
    q, s = F.col("_quality"), F.col("_stratum")
    cuts = fit_all(d.select(F.col("doc_id").cast("long").alias("_lid"), s, q.alias("_c")), labels, alpha)
    fields = [q[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select("doc_id", *fields, base_failed(q).alias("base_failed"), (~base_failed(q) & verdict(q, s, cuts)).alias("kept"), bound_of(s, cuts).alias("rejection_bound"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str | None = "lang", alpha: float = ALPHA) -> DataFrame:
    """`docs` with its columns, without the documents that the rules reject; rows are written once with their counts, and no text is shuffled."""
    stratum = F.col(f"`{stratum_col}`").cast("string") if stratum_col in docs.columns else F.lit(None).cast("string")
    name = common.free_name(docs, "_tw_quality")
    q = F.col(f"`{name}`")
    d = common.written(with_counts(docs, text_col, name), "rows")
    cuts = fit_all(d.select(F.col(f"`{id_col}`").cast("long").alias("_lid"), stratum.alias("_stratum"), q.alias("_c")), labels, alpha)
    return d.where(~base_failed(q) & verdict(q, stratum, cuts)).select([F.col(f"`{c}`") for c in docs.columns])
