"""One query per operator over the provided tables, with DuckDB SQL for the same rows.

The tables hold clean data; each query first makes them dirty by a rule on their keys that both engines spell alike.
Every query reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEPARTMENTS, NULL_TOKENS, Config
from .functions import dates, similarity, text
from .operators import clean as op
from .operators import matching

AS_OF = "2026-09-01"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)
_DIRTY_TEXT = "CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' WHEN c_custkey % 7 = 1 THEN 'N/A' WHEN c_custkey % 7 = 2 THEN ' unknown' WHEN c_custkey % 7 = 3 THEN c_mktsegment || '   ' || c_name ELSE c_name END"


@query(f"SELECT c_custkey, CASE WHEN lower(s) IN ({_TOKENS}) THEN NULL ELSE s END AS value FROM (SELECT c_custkey, trim(regexp_replace({_DIRTY_TEXT}, '\\s+', ' ', 'g')) AS s FROM customer)")
def standardize_text(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.expr(_DIRTY_TEXT).alias("value"))
    return op.standardize_text(df.withColumnRenamed("c_custkey", op.ORD)).withColumnRenamed(op.ORD, "c_custkey")


def _rendered_spark(at: str = "o_orderdate") -> Column:
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "dd-MMM-yyyy", "yyyyMMdd", "dd/MM/yy", "yyyy-MM-dd HH:mm:ss"]
    out = F.when(F.lit(False), "")
    for i, f in enumerate(forms):
        out = out.when(F.col("o_orderkey") % 7 == i, F.date_format(at, f))
    return out


_RENDERED = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%d-%b-%Y", "%Y%m%d", "%d/%m/%y", "%Y-%m-%d %H:%M:%S"))) + " END"


@query(f"SELECT o_orderkey, coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d-%b-%Y'), CASE WHEN length(s) = 8 AND s NOT LIKE '%/%' THEN try_strptime(s, '%Y%m%d') END, CASE WHEN length(s) = 10 THEN try_strptime(s, '%d/%m/%Y') END, try_strptime(s, '%d.%m.%Y'), try_strptime(s, '%d/%m/%y'))::DATE AS parsed FROM (SELECT o_orderkey, {_RENDERED} AS s FROM orders)")
def parse_dates(spark, sf):
    df = _t(spark, sf, "orders").select("o_orderkey", _rendered_spark().alias("s"))
    return df.select("o_orderkey", dates.parse_date(F.col("s"), True).cast("date").alias("parsed"))


#: Every format that dates are read in, as Spark and as DuckDB write it; the last five exist in both orders.
_FORMATS = (
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd-MMM-yyyy", "%d-%b-%Y"),
    ("dd MMM yyyy", "%d %b %Y"), ("MMM dd, yyyy", "%b %d, %Y"), ("MMMM dd, yyyy", "%B %d, %Y"), ("dd-MMMM-yyyy", "%d-%B-%Y"), ("yyyyMMdd", "%Y%m%d"),
    ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"), ("dd/MM/yyyy", "%d/%m/%Y"), ("dd.MM.yyyy", "%d.%m.%Y"), ("dd/MM/yy", "%d/%m/%y"), ("dd.MM.yy", "%d.%m.%y"),
)


def _formats(day_first: bool) -> list[tuple[str, str]]:
    swap = lambda s, d, m: s.replace(d, "\0").replace(m, d).replace("\0", m)
    return [*_FORMATS[:10], *(f if day_first else (swap(f[0], "dd", "MM"), swap(f[1], "%d", "%m")) for f in _FORMATS[10:])]


def _all_formats_sql(day_first: bool) -> str:
    at = " ".join(f"WHEN {i} THEN try_strptime(strftime(o_orderdate, '{d}'), '{d}')" for i, (_, d) in enumerate(_formats(day_first)))
    return f"SELECT o_orderkey, (CASE o_orderkey % 17 {at} END)::DATE AS parsed FROM orders"


def _all_formats(spark: SparkSession, sf: str, day_first: bool) -> DataFrame:
    s = F.when(F.col("o_orderkey") % 17 == 15, "no date").when(F.col("o_orderkey") % 17 == 16, "31/31/1999")
    for i, (f, _) in enumerate(_formats(day_first)):
        s = s.when(F.col("o_orderkey") % 17 == i, F.date_format("o_orderdate", f))
    return _t(spark, sf, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", dates.parse_date(F.col("s"), day_first).cast("date").alias("parsed"))


@query(_all_formats_sql(True))
def parse_dates_day_first(spark, sf):
    return _all_formats(spark, sf, True)


@query(_all_formats_sql(False))
def parse_dates_month_first(spark, sf):
    return _all_formats(spark, sf, False)


@query(f"SELECT count(*) FILTER (a > 12) AS day_first, count(*) FILTER (b > 12) AS month_first, count(*) FILTER (a > 12) >= count(*) FILTER (b > 12) AS is_day_first FROM (SELECT try_cast(regexp_extract(s, '^(\\d{{1,2}})[/.](\\d{{1,2}})[/.](\\d{{2,4}})$', 1) AS INT) AS a, try_cast(regexp_extract(s, '^(\\d{{1,2}})[/.](\\d{{1,2}})[/.](\\d{{2,4}})$', 2) AS INT) AS b FROM (SELECT {_RENDERED} AS s FROM orders))")
def infer_convention(spark, sf):
    d, m = dates.evidence(F.col("s"))
    return _t(spark, sf, "orders").select(_rendered_spark().alias("s")).agg(d.alias("day_first"), m.alias("month_first")).withColumn("is_day_first", F.col("day_first") >= F.col("month_first"))


@query("SELECT o_orderkey, (CASE WHEN d > TIMESTAMP '2026-09-01' THEN d - INTERVAL 100 YEAR ELSE d END)::DATE AS fixed FROM (SELECT o_orderkey, o_orderdate + to_years(CAST(o_orderkey % 3 * 20 AS INTEGER)) AS d FROM orders)")
def century_fix(spark, sf):
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_ym_interval((F.col("o_orderkey") % 3 * 20).cast("int"), F.lit(0))
    return _t(spark, sf, "orders").select("o_orderkey", dates.fix_century(at, AS_OF).cast("date").alias("fixed"))


@query("SELECT text, lang, source, min(doc_id) AS doc_id FROM documents GROUP BY text, lang, source")
def exact_duplicate_rows(spark, sf):
    df = _t(spark, sf, "documents").select("text", "lang", "source", F.col("doc_id").alias(op.ORD))
    return op.exact_dedup(df).withColumnRenamed(op.ORD, "doc_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (status IS NOT NULL)::INT + (price IS NOT NULL)::INT + (admission_date IS NOT NULL)::INT DESC, admission_date DESC NULLS LAST, o_orderkey) AS r FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE END AS admission_date FROM orders)) WHERE r = 1")
def survivorship(spark, sf):
    df = _t(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias(op.ORD), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END").alias("status"), F.expr("CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END").alias("price"), F.expr("CASE WHEN o_orderkey % 5 > 0 THEN to_date(o_orderdate) END").alias("admission_date"))
    return op.survivorship(df, "o_custkey").select("o_custkey", F.col(op.ORD).alias("o_orderkey"))


_DEPARTMENT = "CASE c_custkey % 9 WHEN 0 THEN 'Cardio' WHEN 1 THEN 'ONC' WHEN 2 THEN ' ortho' WHEN 3 THEN 'Peds' WHEN 4 THEN 'neuro ' WHEN 5 THEN 'ER' WHEN 6 THEN 'a&e' WHEN 7 THEN 'Gen Med' ELSE c_mktsegment END"
_DEPARTMENT_MAP = "CASE lower(trim(s)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEPARTMENTS.items()) + " END"


@query(f"SELECT c_custkey, {_DEPARTMENT_MAP} AS department FROM (SELECT c_custkey, {_DEPARTMENT} AS s FROM customer)")
def map_vocabulary(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", op.lookup(F.expr(_DEPARTMENT), DEPARTMENTS).alias("department"))


@query(f"SELECT count(DISTINCT s) AS distinct_before, count(DISTINCT m) AS distinct_after, count(*) FILTER (s IS NOT NULL AND m IS NULL) AS unmapped_values FROM (SELECT s, {_DEPARTMENT_MAP} AS m FROM (SELECT {_DEPARTMENT} AS s FROM customer))")
def unmapped_report(spark, sf):
    df = _t(spark, sf, "customer").select(F.expr(_DEPARTMENT).alias("s")).withColumn("m", op.lookup(F.col("s"), DEPARTMENTS))
    return df.agg(F.countDistinct("s").alias("distinct_before"), F.countDistinct("m").alias("distinct_after"), F.count_if(F.col("s").isNotNull() & F.col("m").isNull()).alias("unmapped_values"))


_MONEY = "CASE o_orderkey % 4 WHEN 0 THEN '$' || cents WHEN 1 THEN 'USD ' || cents WHEN 2 THEN cents ELSE 'n/k-' END"
_CENTS = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS {})"


@query(f"SELECT o_orderkey, n AS number, CASE WHEN n BETWEEN 1000 AND 200000 THEN n END AS kept FROM (SELECT o_orderkey, try_cast(regexp_replace({_MONEY}, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS n FROM (SELECT o_orderkey, {_CENTS.format('VARCHAR')} || '.50' AS cents FROM orders))")
def clean_numeric(spark, sf):
    df = _t(spark, sf, "orders").select("o_orderkey", F.expr(_CENTS.format("STRING") + " || '.50'").alias("cents")).select("o_orderkey", op.to_number(F.expr(_MONEY)).alias("number"))
    return df.select("o_orderkey", "number", op.quarantine(F.col("number"), 1000, 200000).alias("kept"))


@query("WITH p AS (SELECT p_partkey, p_brand AS b, CASE WHEN p_partkey % 6 = 0 OR p_brand = 'Brand#11' THEN NULL ELSE p_retailprice END AS x FROM part), g AS (SELECT b, median(x) AS m FROM p GROUP BY b), f AS (SELECT p_partkey, x, coalesce(x, m) AS y FROM p LEFT JOIN g USING (b)), a AS (SELECT median(y) AS m FROM f) SELECT p_partkey, round_even(coalesce(y, a.m) * 10, 0) / 10 AS total_charges, CASE WHEN x IS NULL THEN 'total_charges' END AS imputed_fields FROM f, a")
def impute_group_median(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.expr("CASE WHEN p_partkey % 6 = 0 OR p_brand = 'Brand#11' THEN NULL ELSE p_retailprice END").alias("total_charges"))
    return op.impute(df, Config(constant_fills={}, median_groups={"total_charges": ("brand",)})).select("p_partkey", "total_charges", "imputed_fields")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END, 'Unknown') AS department, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_name END, 'Self-Pay') AS insurance_provider, nullif(concat_ws(';', CASE WHEN c_custkey % 4 = 0 THEN 'department' END, CASE WHEN c_custkey % 5 = 0 THEN 'insurance_provider' END), '') AS imputed_fields FROM customer")
def impute_constant(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END").alias("department"), F.expr("CASE WHEN c_custkey % 5 > 0 THEN c_name END").alias("insurance_provider"))
    return op.impute(df, Config(median_groups={}))


_PERSON = """SELECT c_custkey AS key, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {add}(DATE '1920-01-01', {days}) END AS date_of_birth,
CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {add}(DATE '2025-01-01', {stay}) END AS admission_date, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE {add}(DATE '2025-01-01', {left}) END AS discharge_date,
CAST(100 + c_custkey % 100 AS DOUBLE) AS height_cm, CAST(10 + c_custkey % 140 AS DOUBLE) AS weight_kg, CAST(80 + c_custkey % 60 AS DOUBLE) AS systolic_bp, CAST(60 + c_custkey % 70 AS DOUBLE) AS diastolic_bp,
CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'x@y.example' END AS email, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '555-555-0100' END AS phone FROM customer"""
_DAYS = {"days": "CAST(c_custkey * 37 % 40000 AS INT)", "stay": "CAST(c_custkey % 300 AS INT)", "left": "CAST(c_custkey % 310 AS INT)"}
_PERSON_SPARK = _PERSON.format(add="date_add", **_DAYS)
_PERSON_DUCK = _PERSON.format(add="add", **_DAYS)
_DERIVED_DUCK = f"SELECT *, CAST(floor((DATE '{AS_OF}' - date_of_birth) / 365.25) AS INT) AS age, round_even(weight_kg / pow(height_cm / 100, 2) * 10, 0) / 10 AS bmi, CAST(discharge_date - admission_date AS INT) AS length_of_stay_days FROM ({_PERSON_DUCK})"
_FLAGS = (
    ("dob_missing", "date_of_birth IS NULL"), ("age_out_of_range", "age < 0 OR age > 120"), ("admission_missing", "admission_date IS NULL"), ("discharge_before_admission", "length_of_stay_days < 0"),
    ("still_admitted", "admission_date IS NOT NULL AND discharge_date IS NULL"), ("bp_inverted", "systolic_bp <= diastolic_bp"), ("bmi_implausible", "bmi < 10 OR bmi > 60"), ("no_contact_details", "email IS NULL AND phone IS NULL"),
)
_FLAGS_DUCK = "nullif(concat_ws(';', " + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in _FLAGS) + "), '')"
_VALID_DUCK = " AND ".join(f"NOT coalesce({e}, false)" for n, e in _FLAGS if n not in ("still_admitted", "no_contact_details"))


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_PERSON_SPARK.replace("FROM customer", "FROM {customer}"), customer=_t(spark, sf, "customer"))


def _derived(spark: SparkSession, sf: str) -> DataFrame:
    return op.derive(op.add_age(_people(spark, sf), AS_OF))


@query(f"SELECT key, age, CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 13 THEN '0-12' WHEN age < 18 THEN '13-17' WHEN age < 40 THEN '18-39' WHEN age < 65 THEN '40-64' ELSE '65+' END AS age_band, bmi, length_of_stay_days FROM ({_DERIVED_DUCK})")
def derived_measures(spark, sf):
    return _derived(spark, sf).select("key", "age", "age_band", "bmi", "length_of_stay_days")


@query(f"SELECT key, {_FLAGS_DUCK} AS dq_flags, {_VALID_DUCK} AS is_valid FROM ({_DERIVED_DUCK})")
def dq_flags(spark, sf):
    return op.validate(_derived(spark, sf)).select("key", "dq_flags", "is_valid")


@query(f"SELECT key FROM ({_DERIVED_DUCK}) WHERE {_VALID_DUCK}")
def valid_only(spark, sf):
    return op.validate(_derived(spark, sf)).where("is_valid").select("key")


@query("SELECT " + ", ".join(f"count(*) FILTER ({e}) AS {n}" for n, e in _FLAGS) + f" FROM ({_DERIVED_DUCK})")
def validation_counts(spark, sf):
    df = _derived(spark, sf)
    return df.agg(*[F.count_if(e).alias(n) for n, e in op.checks(df.columns).items()])


@query(f"SELECT count(*) FILTER (date_of_birth IS NULL) AS date_of_birth, count(*) FILTER (admission_date IS NULL) AS admission_date, count(*) FILTER (email IS NULL) AS email, count(*) FILTER (phone IS NULL) AS phone FROM ({_PERSON_DUCK})")
def null_profile(spark, sf):
    return _people(spark, sf).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("date_of_birth", "admission_date", "email", "phone")])


_PHONE = "CASE c_custkey % 3 WHEN 0 THEN '(' || lpad(CAST(c_custkey % 1000 AS {t}), 3, '5') || ') 555-' || lpad(CAST(c_custkey % 10000 AS {t}), 4, '0') WHEN 1 THEN '555.' || CAST(c_custkey AS {t}) ELSE '5550' || lpad(CAST(c_custkey % 1000000 AS {t}), 6, '0') END"


@query(f"SELECT c_custkey, CASE WHEN length(d) = 10 THEN regexp_replace(d, '^(\\d{{3}})(\\d{{3}})(\\d{{4}})$', '\\1-\\2-\\3') END AS phone, lower(trim(e)) AS email, CASE WHEN regexp_replace(upper(b), '\\s', '', 'g') IN ('A+', 'A-', 'B+', 'B-', 'AB+', 'AB-', 'O+', 'O-') THEN regexp_replace(upper(b), '\\s', '', 'g') END AS blood_type FROM (SELECT c_custkey, regexp_replace({_PHONE.format(t='VARCHAR')}, '\\D', '', 'g') AS d, ' ' || c_name || '@Example.ORG' AS e, CASE c_custkey % 4 WHEN 0 THEN 'ab +' WHEN 1 THEN ' o-' WHEN 2 THEN 'C+' ELSE 'a+' END AS b FROM customer)")
def contact_formats(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.expr(_PHONE.format(t="STRING")).alias("phone"), F.expr("' ' || c_name || '@Example.ORG'").alias("email"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'ab +' WHEN 1 THEN ' o-' WHEN 2 THEN 'C+' ELSE 'a+' END").alias("blood_type"))
    return op.conform(df).select("c_custkey", "phone", "email", "blood_type")


@query("SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(p_name || '-' || lower(p_brand), '([A-Za-z]+|[^A-Za-z]+)'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') AS title FROM part")
def title_case(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", text.title_case(F.concat("p_name", F.lit("-"), F.lower("p_brand"))).alias("title"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM documents")
def normalize_name(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("name"))


_NAMES = "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last FROM part"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_NAMES.replace("FROM part", "FROM {part}"), part=_t(spark, sf, "part"))


@query(f"SELECT p_partkey, jaro_similarity(first, last) AS jaro, jaro_winkler_similarity(first, last) AS jaro_winkler FROM ({_NAMES})")
def jaro_winkler(spark, sf):
    return _names(spark, sf).select("p_partkey", similarity.jaro(F.col("first"), F.col("last")).alias("jaro"), similarity.jaro_winkler(F.col("first"), F.col("last")).alias("jaro_winkler"))


@query(f"SELECT p_partkey, array_to_string(list_sort(string_split(first || last, '')), '') AS signature FROM ({_NAMES})")
def signature_keys(spark, sf):
    return _names(spark, sf).select("p_partkey", text.letter_signature(F.col("first"), F.col("last")).alias("signature"))


def _soundex_sql(x: str) -> str:
    """Soundex of a lower-case name in DuckDB's SQL: H and W (9) part nothing, vowels (0) part equal sounds."""
    u = f"upper(regexp_replace({x}, '[^a-z]', '', 'g'))"
    code = f"translate({u}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000099')"
    runs = f"replace(left({code}, 1), '9', '0') || replace(substr({code}, 2), '9', '')"
    for digit in "0123456":
        runs = f"regexp_replace({runs}, '{digit}+', '{digit}', 'g')"
    return f"CASE WHEN {u} = '' THEN '' ELSE left(left({u}, 1) || replace(substr({runs}, 2), '0', '') || '000', 4) END"


def _metaphone_sql(x: str) -> str:
    """The phonetic key in DuckDB's SQL; contains() holds for the empty string, which a word's edge gives."""
    u = f"upper(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    w = f"CASE WHEN regexp_matches({u}, '^(AE|GN|KN|PN|WR)') THEN substr({u}, 2) WHEN {u} LIKE 'X%' THEN 'S' || substr({u}, 2) WHEN {u} LIKE 'WH%' THEN 'W' || substr({u}, 3) ELSE {u} END"
    at = lambda k: f"CASE WHEN i + {k} < 1 THEN '' ELSE substr({w}, CAST(i + {k} AS BIGINT), 1) END"
    near = f"list_transform(range(1, length({w}) + 1), lambda i: {{'i': i, 'p2': {at(-2)}, 'p': {at(-1)}, 'c': {at(0)}, 'n': {at(1)}, 'n2': {at(2)}}})"
    return f"""array_to_string(list_transform({near}, lambda s: CASE
WHEN s.p = s.c AND s.c <> 'C' THEN '' WHEN contains('AEIOU', s.c) THEN CASE WHEN s.i = 1 THEN s.c ELSE '' END
WHEN s.c = 'B' THEN CASE WHEN s.p = 'M' AND s.n = '' THEN '' ELSE 'B' END
WHEN s.c = 'C' THEN CASE WHEN s.n = 'I' AND s.n2 = 'A' THEN 'X' WHEN s.n = 'H' THEN CASE WHEN s.p = 'S' THEN 'K' ELSE 'X' END WHEN contains('EIY', s.n) THEN CASE WHEN s.p = 'S' THEN '' ELSE 'S' END ELSE 'K' END
WHEN s.c = 'D' THEN CASE WHEN s.n = 'G' AND contains('EYI', s.n2) THEN 'J' ELSE 'T' END
WHEN s.c = 'G' THEN CASE WHEN s.p = 'D' AND s.p2 <> 'D' AND contains('EYI', s.n) THEN '' WHEN s.n = 'H' THEN CASE WHEN contains('AEIOU', s.n2) THEN 'K' ELSE '' END WHEN s.n = 'N' THEN '' WHEN contains('EIY', s.n) THEN 'J' ELSE 'K' END
WHEN s.c = 'H' THEN CASE WHEN contains('AEIOU', s.p) AND NOT contains('AEIOU', s.n) OR contains('CSPTG', s.p) THEN '' ELSE 'H' END
WHEN s.c = 'P' THEN CASE WHEN s.n = 'H' THEN 'F' ELSE 'P' END WHEN s.c = 'Q' THEN 'K'
WHEN s.c = 'S' THEN CASE WHEN s.n = 'H' OR s.n = 'I' AND contains('OA', s.n2) THEN 'X' ELSE 'S' END
WHEN s.c = 'T' THEN CASE WHEN s.n = 'I' AND contains('OA', s.n2) THEN 'X' WHEN s.n = 'H' THEN '0' ELSE 'T' END
WHEN s.c = 'V' THEN 'F' WHEN s.c = 'X' THEN 'KS' WHEN s.c = 'Z' THEN 'S' WHEN s.c IN ('W', 'Y') THEN CASE WHEN contains('AEIOU', s.n) THEN s.c ELSE '' END
ELSE s.c END), '')"""


@query(f"SELECT doc_id, w AS word, {_soundex_sql('w')} AS soundex, {_metaphone_sql('w')} AS metaphone FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS w FROM documents WHERE text IS NOT NULL)")
def phonetic_keys(spark, sf):
    """Of every distinct word of ASCII letters in every document."""
    words = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)))
    d = _t(spark, sf, "documents").select("doc_id", words.alias("word")).select("doc_id", F.lower("word").alias("word")).distinct()
    return d.select("doc_id", "word", text.soundex_key(F.col("word")).alias("soundex"), text.metaphone_key(F.col("word")).alias("metaphone"))


# People whose blocks keep their size as the table grows: four in a row share a date and letters of their number's hash.
_GROUP = "CAST((p_partkey - p_partkey % 4) / 4 AS BIGINT)"
_LETTERS = f"translate(md5(CAST({_GROUP} AS {{t}})), '0123456789abcdef', 'bcdfgklmnprstaei')"
_MATCH = f"""SELECT CAST(p_partkey AS {{t}}) AS patient_id, CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN substr(w, 8, 7) WHEN p_partkey % 4 = 2 THEN substr(w, 1, 7) || 'e' ELSE substr(w, 1, 7) END AS first_name,
CASE WHEN p_partkey % 25 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN substr(w, 1, 7) WHEN p_partkey % 4 = 3 THEN substr(w, 15, 7) ELSE substr(w, 8, 7) END AS last_name,
CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE {{add}}(DATE '1950-01-01', CAST({_GROUP} % 2900000 + p_partkey % 3 * 30 AS INT)) END AS date_of_birth, CASE p_partkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'Unknown' ELSE 'F' END AS gender FROM (SELECT p_partkey, {_LETTERS} AS w FROM part)"""


def _matchable(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_MATCH.format(t="STRING", add="date_add").replace("FROM part", "FROM {part}"), part=_t(spark, sf, "part"))


_BLOCKED = f"""m AS ({_MATCH.format(t='VARCHAR', add='add')}),
ph AS (SELECT *, {_soundex_sql('first_name')} AS sf, {_soundex_sql('last_name')} AS sl, {_metaphone_sql('first_name')} AS mf, {_metaphone_sql('last_name')} AS ml, array_to_string(list_sort(string_split(first_name || last_name, '')), '') AS sig FROM m),
bl AS (SELECT ph.*, b.* FROM ph, LATERAL (VALUES (true, 'dob', CAST(date_of_birth AS VARCHAR), '', date_of_birth IS NOT NULL), (true, 'year_name', CAST(year(date_of_birth) AS VARCHAR), left(last_name, 3), date_of_birth IS NOT NULL AND last_name <> ''),
  (false, 'soundex', sf, sl, first_name || last_name <> ''), (false, 'metaphone', mf, ml, first_name || last_name <> ''), (false, 'signature', sig, '', first_name || last_name <> '')) AS b(dated, kind, k1, k2, has) WHERE has),
fit AS (SELECT kind, k1, k2 FROM bl GROUP BY ALL HAVING count(*) BETWEEN 2 AND 100),
pr AS (SELECT DISTINCT a.patient_id AS a, b.patient_id AS b, trim(a.first_name || ' ' || a.last_name) AS na, trim(b.first_name || ' ' || b.last_name) AS nb, trim(b.last_name || ' ' || b.first_name) AS nc, a.date_of_birth AS da, b.date_of_birth AS db, a.gender AS ga, b.gender AS gb
  FROM bl a JOIN fit USING (kind, k1, k2) JOIN bl b USING (kind, k1, k2) WHERE a.patient_id < b.patient_id AND (a.dated OR a.date_of_birth IS NULL OR b.date_of_birth IS NULL))"""


@query(f"WITH {_BLOCKED} SELECT a, b FROM pr")
def block_pairs(spark, sf):
    """All five block kinds, undated records too."""
    return matching.candidates(matching.blocks(matching.records(_matchable(spark, sf), "patient_id"))).select(F.col("_ka").alias("a"), F.col("_kb").alias("b"))


_SCORED = f"""{_BLOCKED},
sc AS (SELECT *, CASE WHEN da IS NULL OR db IS NULL THEN 'unknown' WHEN da = db THEN 'exact' WHEN year(da) = year(db) AND month(da) = day(db) AND day(da) = month(db) THEN 'transposed' WHEN year(da) = year(db) THEN 'same_year' END AS dob_relation,
  CASE WHEN na = '' OR nb = '' THEN 0 ELSE greatest(jaro_winkler_similarity(na, nb), jaro_winkler_similarity(na, nc)) END AS s FROM pr),
hit AS (SELECT *, dob_relation = 'unknown' AND ga <> 'Unknown' AND gb <> 'Unknown' AND ga <> gb AS veto, CASE WHEN dob_relation = 'exact' AND s >= 0.96 THEN 'high' WHEN dob_relation IN ('exact', 'transposed') THEN 'medium' ELSE 'low' END AS confidence
  FROM sc WHERE s >= CASE dob_relation WHEN 'exact' THEN 0.9 WHEN 'unknown' THEN 0.95 ELSE 0.96 END AND dob_relation IS NOT NULL),
ok AS (SELECT * FROM hit WHERE NOT veto)"""


@query(f"WITH {_SCORED} SELECT a AS patient_id_a, b AS patient_id_b, na AS name_a, nb AS name_b, da AS date_of_birth_a, db AS date_of_birth_b, dob_relation, round(s, 3) AS name_score, confidence FROM ok")
def fuzzy_duplicates(spark, sf):
    """Admission, thresholds, veto and confidence over all block kinds."""
    rec = matching.records(_matchable(spark, sf), "patient_id")
    return matching.pair_table(matching.scored(matching.candidates(matching.blocks(rec))), "patient_id")


@query(f"WITH {_SCORED}, both_ways AS (SELECT a AS k, b AS p FROM ok UNION ALL SELECT b, a FROM ok), ps AS (SELECT k, string_agg(DISTINCT p, ';' ORDER BY p) AS possible_duplicate_of FROM both_ways GROUP BY k) SELECT patient_id, possible_duplicate_of FROM m LEFT JOIN ps ON k = patient_id")
def annotate_partners(spark, sf):
    return matching.annotate(_matchable(spark, sf), fuzzy_duplicates(spark, sf)).select("patient_id", "possible_duplicate_of")


@query(f"""WITH {_SCORED} SELECT CAST(0.9 AS DOUBLE) AS threshold, CAST(0.96 AS DOUBLE) AS strict_threshold, CAST(0.95 AS DOUBLE) AS no_dob_threshold, (SELECT count(*) FROM hit WHERE veto) AS vetoed_on_gender_conflict,
(SELECT count(*) FROM (SELECT DISTINCT kind, k1, k2 FROM bl)) AS blocks_built, (SELECT count(*) FROM pr) AS pairs_compared, (SELECT count(*) FROM pr WHERE da IS NULL OR db IS NULL) AS pairs_from_name_only_blocks,
(SELECT count(*) FROM ok) AS candidate_pairs, (SELECT count(*) FROM (SELECT a FROM ok UNION SELECT b FROM ok)) AS records_involved, (SELECT count(*) FROM ok WHERE confidence = 'high') AS high, (SELECT count(*) FROM ok WHERE confidence = 'medium') AS medium,
(SELECT count(*) FROM ok WHERE confidence = 'low') AS low, (SELECT count(*) FROM m WHERE date_of_birth IS NULL) AS records_without_dob, (SELECT count(*) FROM m WHERE first_name || last_name = '') AS records_without_name,
(SELECT count(*) FROM m WHERE date_of_birth IS NULL AND first_name || last_name = '') AS unmatchable_records, (SELECT count(*) FROM (SELECT 1 FROM bl GROUP BY kind, k1, k2 HAVING count(*) > 100)) AS oversized_blocks_skipped""")
def fuzzy_stats(spark, sf):
    """The statistics of the review queue, as one row."""
    stats = matching.find_fuzzy_duplicates(_matchable(spark, sf))[1]
    by = stats.pop("by_confidence")
    stats |= {k: by.get(k, 0) for k in ("high", "medium", "low")}
    return spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in stats.items()))


_REPORT_DUCK = ", ".join(f"count(*) FILTER (d IS NOT NULL AND k % 17 {c}) AS {n}" for n, c in (("values_present", ">= 0"), ("parsed", "< 15"), ("unparseable", ">= 15")))


@query(f"SELECT {_REPORT_DUCK}, count(*) FILTER (k % 17 < 15 AND d + to_years(CAST(k % 3 * 20 AS INTEGER)) > TIMESTAMP '{AS_OF}') AS century_corrections FROM (SELECT o_orderkey AS k, o_orderdate AS d FROM orders)")
def date_report(spark, sf):
    """What the report says of a column of birth dates in four-digit years, some of them in the future."""
    from .plans.pipeline import _date_report

    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_ym_interval((F.col("o_orderkey") % 3 * 20).cast("int"), F.lit(0))
    s = F.when(F.col("o_orderkey") % 17 >= 15, "31/31/1999")
    for i, f in enumerate(f for f, _ in _FORMATS[:13]):
        s = s.when(F.col("o_orderkey") % 17 % 13 == i, F.date_format(at, f))
    df = _t(spark, sf, "orders").select(s.alias("date_of_birth"))
    out, used = op.standardize_dates(df, "dayfirst", AS_OF)
    row = _date_report(df, out, used, AS_OF, Config())["date_of_birth"]
    names = ("values_present", "parsed", "unparseable", "century_corrections")
    return spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} long" for n in names))


_COPIES = "SELECT c_nationkey % 5 AS k, c_mktsegment AS segment, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS nation, CASE WHEN c_custkey % 3 > 0 THEN DATE '2025-01-01' END AS admission_date FROM customer"


@query(f"WITH d AS ({_COPIES}) SELECT (SELECT count(*) FROM d) AS rows_in, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS exact_duplicate_rows_removed, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) - (SELECT count(*) FROM (SELECT DISTINCT k FROM d)) AS same_patient_rows_removed, (SELECT count(*) FROM (SELECT DISTINCT k FROM d)) AS rows_out")
def duplicate_report(spark, sf):
    df = spark.sql(_COPIES.replace("FROM customer", "FROM {customer}"), customer=_t(spark, sf, "customer"))
    out, report = op.drop_duplicates(df, "k")
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} long" for k in report))


@query()
def clean_pipeline(spark, sf):
    """Flagship: dirty people through text, dates, vocabularies, numbers, imputation, measures and flags."""
    people = _people(spark, sf)
    names = ", ".join(f"CAST({c} AS STRING) AS {c}" for c in people.columns if c not in ("key", "date_of_birth"))
    raw = people.selectExpr("CAST(key AS STRING) AS patient_id", "date_format(date_of_birth, 'dd/MM/yyyy') AS date_of_birth", *names.split(", "), "CASE key % 3 WHEN 0 THEN ' male' WHEN 1 THEN 'F' ELSE 'n/a' END AS gender")
    std, _ = op.standardize_dates(op.standardize_text(op.with_order(raw)), "auto", AS_OF)
    one = op.survivorship(op.exact_dedup(std), "patient_id")
    return op.validate(op.derive(op.impute(op.add_age(op.numerics(op.conform(one)), AS_OF)))).drop(op.ORD)
