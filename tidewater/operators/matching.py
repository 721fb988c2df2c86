"""Probable duplicates under different keys: blocked self-join, tiered thresholds, annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates, similarity, text

KEY, FIRST, LAST, DOB, SEX = "_k", "_f", "_l", "_d", "_g"


def records(df: DataFrame, key: str) -> DataFrame:
    """The columns that matching reads, names normalised."""
    null = lambda t: F.lit(None).cast(t)
    has = df.columns
    return df.select(
        F.col(key).cast("string").alias(KEY), text.normalize_name(F.col("first_name") if "first_name" in has else null("string")).alias(FIRST), text.normalize_name(F.col("last_name") if "last_name" in has else null("string")).alias(LAST),
        (F.col("date_of_birth").cast("date") if "date_of_birth" in has else null("date")).alias(DOB), (F.col("gender") if "gender" in has else null("string")).alias(SEX),
    )


def blocks(rec: DataFrame) -> DataFrame:
    """`rec` exploded by block: dated (boolean), kind, k1, k2. Five kinds; a record is in a kind's block at most once."""
    s = lambda dated, kind, a, b: F.struct(F.lit(dated).alias("dated"), F.lit(kind).alias("kind"), a.cast("string").alias("k1"), b.cast("string").alias("k2"))
    f, last, dob = F.col(FIRST), F.col(LAST), F.col(DOB)
    named = (f != "") | (last != "")
    none = F.lit("")
    kinds = F.array(
        F.when(dob.isNotNull(), s(True, "dob", dob, none)), F.when(dob.isNotNull() & (last != ""), s(True, "year_name", F.year(dob), F.substring(last, 1, 3))),
        F.when(named, s(False, "soundex", text.soundex_key(f), text.soundex_key(last))), F.when(named, s(False, "metaphone", text.metaphone_key(f), text.metaphone_key(last))), F.when(named, s(False, "signature", text.letter_signature(f, last), none)),
    )
    return rec.select("*", F.explode(F.array_compact(kinds)).alias("b")).select(*rec.columns, "b.*")


def candidates(blocked: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Distinct pairs of records that share a block of 2 to max_block members; a before b by key, nulls last.

    The name kinds admit a pair only if a side has no date. Block sizes are counted first, so no larger block is ever
    expanded: what joins is bounded by max_block rows a block.
    """
    keys = ["dated", "kind", "k1", "k2"]
    fit = blocked.groupBy(*keys).count().where(F.col("count").between(2, cfg.max_block)).select(*keys)
    kept = blocked.join(fit, keys, "left_semi")
    cols = [KEY, FIRST, LAST, DOB, SEX]
    a = kept.select(*keys, *[F.col(c).alias(f"{c}a") for c in cols])
    b = kept.select(*keys, *[F.col(c).alias(f"{c}b") for c in cols])
    before = (F.col("_ka") < F.col("_kb")) | (F.col("_ka").isNotNull() & F.col("_kb").isNull())
    pairs = a.join(b, keys).where(before & (F.col("dated") | F.col("_da").isNull() | F.col("_db").isNull()))
    return pairs.drop("kind", "k1", "k2").dropDuplicates(["_ka", "_kb"])


def required(relation: Column, cfg: Config) -> Column:
    return F.when(relation == "exact", cfg.threshold).when(relation == "unknown", cfg.no_dob_threshold).otherwise(cfg.strict_threshold)


def confidence(relation: Column, score: Column, cfg: Config) -> Column:
    return F.when((relation == "exact") & (score >= cfg.strict_threshold), "high").when(relation.isin("exact", "transposed"), "medium").otherwise("low")


def genders_conflict(relation: Column, a: Column, b: Column) -> Column:
    known = a.isNotNull() & b.isNotNull() & (a != "Unknown") & (b != "Unknown")
    return F.coalesce((relation == "unknown") & known & (a != b), F.lit(False))


def scored(pairs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Pairs that reach their tier's threshold, with relation, score and veto; pairs that can't are dropped unscored."""
    full = lambda f, last: F.trim(F.concat_ws(" ", f, last))
    p = pairs.withColumn("relation", dates.dob_relation(F.col("_da"), F.col("_db"))).where("relation is not null")
    p = p.withColumns({"na": full("_fa", "_la"), "nb": full("_fb", "_lb"), "nc": full("_lb", "_fb")})
    need = required(F.col("relation"), cfg)
    # jaro is at most (2 + shorter/longer) / 3 and the prefix adds at most 0.4 of the rest.
    short, long = F.least(F.length("na"), F.length("nb")), F.greatest(F.length("na"), F.length("nb"))
    p = p.where((short > 0) & ((2 + short / long) / 3 >= (need - 0.4) / 0.6 - 1e-9))
    p = p.withColumn("score", similarity.name_similarity(F.col("na"), F.col("nb"), F.col("nc"))).where(F.col("score") >= need)
    return p.withColumn("veto", genders_conflict(F.col("relation"), F.col("_ga"), F.col("_gb")))


def pair_table(hits: DataFrame, key: str, cfg: Config = Config()) -> DataFrame:
    return hits.where("not veto").select(
        F.col("_ka").alias(f"{key}_a"), F.col("_kb").alias(f"{key}_b"), F.col("na").alias("name_a"), F.col("nb").alias("name_b"), F.col("_da").alias("date_of_birth_a"), F.col("_db").alias("date_of_birth_b"),
        F.col("relation").alias("dob_relation"), F.round("score", 3).alias("name_score"), confidence(F.col("relation"), F.col("score"), cfg).alias("confidence"),
    )


def find_fuzzy_duplicates(df: DataFrame, key: str = "patient_id", cfg: Config = Config()) -> tuple[DataFrame, dict]:
    """The review queue, ordered by confidence (alphabetically) and score, and its statistics."""
    rec = records(df, key)
    blocked = blocks(rec)
    cand = candidates(blocked, cfg).cache()
    hits = scored(cand, cfg).cache()
    pairs = pair_table(hits, key, cfg)
    r = rec.agg(F.count_if(F.col(DOB).isNull()).alias("d"), F.count_if((F.col(FIRST) == "") & (F.col(LAST) == "")).alias("n"), F.count_if(F.col(DOB).isNull() & (F.col(FIRST) == "") & (F.col(LAST) == "")).alias("u")).first()
    b = blocked.groupBy("dated", "kind", "k1", "k2").count().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("count") > cfg.max_block).alias("big")).first()
    c = cand.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_da").isNull() | F.col("_db").isNull()).alias("name_only")).first()
    by = {x.confidence: x["count"] for x in pairs.groupBy("confidence").count().collect()}
    ids = pairs.select(F.col(f"{key}_a").alias("k")).union(pairs.select(F.col(f"{key}_b"))).agg(F.countDistinct("k")).first()[0]
    stats = {
        "threshold": cfg.threshold, "strict_threshold": cfg.strict_threshold, "no_dob_threshold": cfg.no_dob_threshold, "vetoed_on_gender_conflict": hits.where("veto").count(),
        "blocks_built": b.n, "pairs_compared": c.n, "pairs_from_name_only_blocks": c.name_only, "candidate_pairs": sum(by.values()), "records_involved": ids, "by_confidence": by,
        "records_without_dob": r.d, "records_without_name": r.n, "unmatchable_records": r.u, "oversized_blocks_skipped": b.big,
    }
    return pairs.orderBy("confidence", F.desc("name_score"), f"{key}_a", f"{key}_b"), stats


def annotate(df: DataFrame, pairs: DataFrame, key: str = "patient_id") -> DataFrame:
    """possible_duplicate_of: each row's partners, sorted and joined by ';'."""
    a, b = F.col(f"{key}_a"), F.col(f"{key}_b")
    both = pairs.select(a.alias("_k"), b.alias("_p")).union(pairs.select(b, a))
    partners = both.groupBy("_k").agg(F.array_join(F.array_sort(F.collect_set("_p")), ";").alias("possible_duplicate_of"))
    return df.join(partners, df[key] == partners["_k"], "left").drop("_k")
