"""The whole cleaning plan: text, dates, dedup, vocabularies, numbers, imputation, measures, matching, flags."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NEVER_FILLED, Config
from ..operators import clean as op
from ..operators import matching


def clean(df: DataFrame, convention: str = "auto", as_of: date | str | None = None, key: str = "patient_id", fuzzy_threshold: float | None = None, no_dob_threshold: float = 0.95, cfg: Config = Config()) -> tuple[DataFrame, dict, DataFrame]:
    """(clean table, report, review queue). Matching is off when fuzzy_threshold is None."""
    spark = df.sparkSession
    as_of = str(as_of or date.today())
    cfg = replace(cfg, key=key, threshold=fuzzy_threshold if fuzzy_threshold is not None else cfg.threshold, no_dob_threshold=no_dob_threshold)
    report: dict = {"generated_at": datetime.now().isoformat(timespec="seconds"), "volume": {"rows_in": df.count(), "columns_in": len(op.data_columns(df))}}
    std = op.standardize_text(op.with_order(df), cfg)
    report["missing_in_source"] = op.null_profile(std)
    dated, used = op.standardize_dates(std, convention, as_of, cfg)
    report["dates"] = _date_report(std, dated, used, as_of, cfg)
    unique, report["duplicates"] = op.drop_duplicates(dated, key)
    report["missing_before"] = op.null_profile(unique)
    conformed = op.conform(unique, cfg)
    report["categories"] = _category_report(unique, conformed, cfg)
    numbers = op.numerics(conformed, cfg)
    report["numerics"] = _numeric_report(conformed, cfg)
    aged = op.add_age(numbers, as_of)
    filled = op.derive(op.impute(aged, cfg))
    report["imputation"] = _imputation_report(aged, filled, cfg)
    pairs = spark.createDataFrame([], "empty string").drop("empty")
    report["fuzzy_duplicates"] = {"enabled": False}
    if fuzzy_threshold is not None:
        pairs, stats = matching.find_fuzzy_duplicates(filled, key, cfg)
        filled = matching.annotate(filled, pairs, key)
        report["fuzzy_duplicates"] = {"enabled": True, **stats}
    out = op.validate(filled)
    found = op.checks(out.columns)
    row = out.agg(*[F.count_if(e).alias(n) for n, e in found.items()], F.count_if("is_valid").alias("_ok"), F.count(F.lit(1)).alias("_n")).first()
    report["validation"] = {n: row[n] for n in found} | {"rows_passing_blocking_checks": row["_ok"]}
    out = out.drop(op.ORD)
    after = op.null_profile(out)
    report["missing_after"] = {c: after[c] for c in report["missing_before"] if c in after}
    report["volume"] |= {"rows_out": row["_n"], "columns_out": len(out.columns)}
    return out.orderBy(F.col(key).asc_nulls_last()), report, pairs


def _date_report(before: DataFrame, after: DataFrame, used: dict, as_of: str, cfg: Config) -> dict:
    from ..functions import dates

    aggs = []
    for c, how in used.items():
        at = dates.parse_date(F.col(c), how["convention_used"] == "dayfirst")
        fixed = F.count_if(at > F.lit(as_of).cast("timestamp_ntz")) if c in cfg.century_columns else F.lit(0)
        aggs += [F.count(c).alias(f"p_{c}"), F.count(at).alias(f"ok_{c}"), fixed.alias(f"f_{c}")]
    row = before.agg(*aggs).first() if aggs else {}
    return {c: {"values_present": row[f"p_{c}"], "parsed": row[f"ok_{c}"], "unparseable": row[f"p_{c}"] - row[f"ok_{c}"], "century_corrections": row[f"f_{c}"], **how} for c, how in used.items()}


def _category_report(before: DataFrame, after: DataFrame, cfg: Config) -> dict:
    out: dict = {}
    for c, vocabulary in cfg.vocabularies.items():
        if c in before.columns:
            r = before.agg(F.countDistinct(c).alias("b"), F.countDistinct(op.lookup(F.col(c), vocabulary)).alias("a"), F.count_if(F.col(c).isNotNull() & op.lookup(F.col(c), vocabulary).isNull()).alias("u")).first()
            out[c] = {"distinct_before": r.b, "distinct_after": r.a, "unmapped_values": r.u}
    if "blood_type" in before.columns:
        out["blood_type"] = {"invalid_values_nulled": before.where(F.col("blood_type").isNotNull() & op.blood_type(F.col("blood_type"), cfg.blood_types).isNull()).count()}
    if "phone" in before.columns:
        out["phone"] = {"invalid_values_nulled": before.where(F.col("phone").isNotNull() & op.phone(F.col("phone")).isNull()).count()}
    return out


def _numeric_report(before: DataFrame, cfg: Config) -> dict:
    mine = {c: r for c, r in cfg.ranges.items() if c in before.columns}
    if not mine:
        return {}
    aggs = []
    for c, (lo, hi) in mine.items():
        n = op.to_number(F.col(c))
        aggs += [F.count_if(F.col(c).isNotNull() & n.isNull()).alias(f"t_{c}"), F.count_if(~n.between(lo, hi)).alias(f"q_{c}")]
    row = before.agg(*aggs).first()
    return {c: {"non_numeric_coerced": row[f"t_{c}"], "implausible_quarantined": row[f"q_{c}"], "plausible_range": [lo, hi]} for c, (lo, hi) in mine.items()}


def _imputation_report(before: DataFrame, after: DataFrame, cfg: Config) -> dict:
    out: dict = {}
    mine = [c for c in (*cfg.constant_fills, *cfg.median_groups, *NEVER_FILLED) if c in before.columns]
    if not mine:
        return out
    b = before.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in mine]).first()
    for c in mine:
        if c in cfg.constant_fills:
            out[c] = {"strategy": f"constant {cfg.constant_fills[c]}", "filled": b[c]}
        elif c in cfg.median_groups:
            if b[c]:
                out[c] = {"strategy": "median by " + ", ".join(cfg.median_groups[c]), "filled": b[c]}
        else:
            out[c] = {"strategy": "left null by design", "still_missing": b[c]}
    return out
