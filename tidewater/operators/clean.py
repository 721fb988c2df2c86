"""The pipeline's stages, each DataFrame -> DataFrame and callable on its own.

Stages skip columns that the table lacks. Nothing is collected inside a stage but where its result depends on a whole
column (date convention, medians' existence), and then one row is.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AGE_BANDS, Config
from ..functions import dates, text

ORD = "_ord"


def with_order(df: DataFrame) -> DataFrame:
    """Adds the file order, which breaks ties."""
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORD]


def standardize_text(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    return df.select(*[text.null_tokens(text.squeeze(F.col(c).cast("string")), cfg.null_tokens).alias(c) if c != ORD else F.col(c) for c in df.columns])


def date_evidence(df: DataFrame, columns) -> dict[str, tuple[int, int]]:
    """column -> (day-first, month-first) counts, by one aggregate over all columns."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return {}
    aggs = [e.alias(f"{k}_{c}") for c in columns for k, e in zip("dm", dates.evidence(F.col(c)), strict=True)]
    row = df.agg(*aggs).first()
    return {c: (row[f"d_{c}"], row[f"m_{c}"]) for c in columns}


def standardize_dates(df: DataFrame, convention: str = "auto", as_of="today", cfg: Config = Config()) -> tuple[DataFrame, dict]:
    """Dates at day grain, and per column the convention used with its evidence (None where it was forced)."""
    columns = [c for c in cfg.date_columns if c in df.columns]
    found = date_evidence(df, columns) if convention == "auto" else {}
    used, out = {}, {}
    for c in columns:
        day_first = dates.infer_day_first(*found[c]) if convention == "auto" else convention == "dayfirst"
        at = dates.parse_date(F.col(c), day_first)
        out[c] = (dates.fix_century(at, as_of) if c in cfg.century_columns else at).cast("date")
        used[c] = {"convention_used": "dayfirst" if day_first else "monthfirst", "day_first_evidence": found[c][0] if found else None, "month_first_evidence": found[c][1] if found else None}
    return df.withColumns(out), used


def exact_dedup(df: DataFrame) -> DataFrame:
    """One row for rows equal in every column (nulls are equal): the first of the file."""
    df = with_order(df)
    return df.groupBy(*[F.col(f"`{c}`") for c in data_columns(df)]).agg(F.min(ORD).alias(ORD)).select(df.columns)


def _preferred(columns: list[str], recency: str) -> list[Column]:
    filled = sum((F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return [filled.desc(), *([F.col(recency).desc_nulls_last()] if recency in columns else []), F.col(ORD)]


def survivorship(df: DataFrame, key: str, recency: str = "admission_date") -> DataFrame:
    """One row a key: the most complete, then the most recent (nulls last), then the first of the file."""
    df = with_order(df)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*_preferred(data_columns(df), recency)))).where("_rank = 1").drop("_rank")


def drop_duplicates(df: DataFrame, key: str, recency: str = "admission_date") -> tuple[DataFrame, dict]:
    """Exact copies, then rows of one key; with the counts of the report.

    The result is persisted, and each of its rows knows how many rows and how many unlike rows its key had, so the
    input is read once and the counts are sums over what is left.
    """
    df = with_order(df)
    columns = data_columns(df)
    once = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(ORD).alias(ORD), F.count(F.lit(1)).alias("_copies"))
    best = _preferred(columns, recency)
    by = Window.partitionBy(key)
    rows = once.withColumns({"_rank": F.row_number().over(by.orderBy(*best)), "_rows": F.sum("_copies").over(by), "_unlike": F.count(F.lit(1)).over(by)})
    out = rows.where("_rank = 1").drop("_rank", "_copies").persist(StorageLevel.MEMORY_AND_DISK)
    n = out.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("a"), F.coalesce(F.sum("_unlike"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("c")).first()
    return out.select(df.columns), {"rows_in": n.a, "exact_duplicate_rows_removed": n.a - n.b, "same_patient_rows_removed": n.b - n.c, "rows_out": n.c}


def lookup(c: Column, vocabulary: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in vocabulary.items() for x in kv]
    return F.create_map(*pairs)[F.lower(F.trim(c))]


def phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 10, F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3"))


def blood_type(c: Column, kinds) -> Column:
    tight = F.regexp_replace(F.upper(c), r"(?U)\s+", "")
    return F.when(tight.isin(*kinds), tight)


def conform(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Controlled vocabularies and text formats."""
    rules = {c: lookup(F.col(c), v) for c, v in cfg.vocabularies.items()}
    rules |= {"blood_type": blood_type(F.col("blood_type"), cfg.blood_types), "diagnosis_code": F.trim(F.upper(F.col("diagnosis_code"))), "email": F.trim(F.lower(F.col("email"))), "phone": phone(F.col("phone"))}
    rules |= {c: text.title_case(F.col(c)) for c in ("first_name", "last_name")}
    return df.withColumns({c: e for c, e in rules.items() if c in df.columns})


def to_number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def quarantine(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def numerics(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    return df.withColumns({c: quarantine(to_number(F.col(c)), *r) for c, r in cfg.ranges.items() if c in df.columns})


def age(dob: Column, as_of) -> Column:
    return F.floor(F.datediff(F.lit(str(as_of)).cast("date"), dob) / 365.25).cast("int")


def age_band(years: Column) -> Column:
    out = F.when(years.isNull(), "Unknown")
    for top, name in AGE_BANDS:
        out = out.when(years < top, name) if top is not None else out.otherwise(name)
    return out


def add_age(df: DataFrame, as_of) -> DataFrame:
    if "date_of_birth" not in df.columns:
        return df
    return df.withColumn("age", age(F.col("date_of_birth"), as_of)).withColumn("age_band", age_band(F.col("age")))


def tenth(c: Column) -> Column:
    """One decimal, ties to the even digit."""
    return F.rint(c * 10) / 10


def impute(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Constants, then group medians, then the median of what groups filled; `imputed_fields` names the cells made up.

    A measure without missing values stays as it is; otherwise all its values are rounded to one decimal.
    """
    constants = {c: v for c, v in cfg.constant_fills.items() if c in df.columns}
    measures = {c: g for c, g in cfg.median_groups.items() if c in df.columns and all(x in df.columns for x in g)}
    df = df.withColumns({f"_was_{c}": F.col(c).isNull() for c in (*constants, *measures)})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in constants.items()})
    for group in dict.fromkeys(measures.values()):
        mine = [c for c, g in measures.items() if g == group]
        medians = df.groupBy(*group).agg(*[F.median(c).alias(f"_group_{c}") for c in mine]).withColumnsRenamed({g: f"_key_{g}" for g in group})
        same = [df[g].eqNullSafe(medians[f"_key_{g}"]) & df[g].isNotNull() for g in group]
        on = same[0]
        for s in same[1:]:
            on = on & s
        df = df.join(medians, on, "left").drop(*[f"_key_{g}" for g in group])
    if measures:
        row = df.agg(*[F.median(F.coalesce(c, f"_group_{c}")).alias(f"m_{c}") for c in measures], *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in measures]).first()
        df = df.withColumns({c: tenth(F.coalesce(c, f"_group_{c}", F.lit(row[f"m_{c}"]).cast("double"))) for c in measures if row[f"n_{c}"]})
    names = [F.when(F.col(f"_was_{c}") & F.col(c).isNotNull(), F.lit(c)) for c in (*constants, *measures)]
    df = df.withColumn("imputed_fields", F.nullif(F.concat_ws(";", *names), F.lit("")) if names else F.lit(None).cast("string"))
    return df.drop(*[f"_was_{c}" for c in (*constants, *measures)], *[f"_group_{c}" for c in measures])


def derive(df: DataFrame) -> DataFrame:
    if {"height_cm", "weight_kg"} <= set(df.columns):
        df = df.withColumn("bmi", tenth(F.try_divide(F.col("weight_kg"), F.pow(F.col("height_cm") / 100, F.lit(2.0)))))
    if {"admission_date", "discharge_date"} <= set(df.columns):
        df = df.withColumn("length_of_stay_days", F.datediff("discharge_date", "admission_date"))
    return df


def checks(columns) -> dict[str, Column]:
    """name -> condition, in flag order; a check whose columns are missing is left out."""
    c = F.col
    rules = {
        "dob_missing": (["date_of_birth"], lambda: c("date_of_birth").isNull()),
        "age_out_of_range": (["age"], lambda: (c("age") < 0) | (c("age") > 120)),
        "admission_missing": (["admission_date"], lambda: c("admission_date").isNull()),
        "discharge_before_admission": (["length_of_stay_days"], lambda: c("length_of_stay_days") < 0),
        "still_admitted": (["admission_date", "discharge_date"], lambda: c("admission_date").isNotNull() & c("discharge_date").isNull()),
        "bp_inverted": (["systolic_bp", "diastolic_bp"], lambda: c("systolic_bp") <= c("diastolic_bp")),
        "bmi_implausible": (["bmi"], lambda: (c("bmi") < 10) | (c("bmi") > 60)),
        "no_contact_details": (["email", "phone"], lambda: c("email").isNull() & c("phone").isNull()),
        "possible_duplicate": (["possible_duplicate_of"], lambda: c("possible_duplicate_of").isNotNull()),
    }
    return {n: F.coalesce(make(), F.lit(False)) for n, (need, make) in rules.items() if set(need) <= set(columns)}


def validate(df: DataFrame) -> DataFrame:
    """dq_flags and is_valid; rows are flagged, never dropped."""
    from ..config import BLOCKING_CHECKS

    found = checks(df.columns)
    flags = F.nullif(F.concat_ws(";", *[F.when(e, F.lit(n)) for n, e in found.items()]), F.lit("")) if found else F.lit(None).cast("string")
    bad = F.lit(False)
    for n in BLOCKING_CHECKS:
        if n in found:
            bad = bad | found[n]
    return df.withColumn("dq_flags", flags).withColumn("is_valid", ~bad)


def null_profile(df: DataFrame) -> dict[str, int]:
    cols = data_columns(df)
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}
