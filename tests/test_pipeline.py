import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater import queries
from tidewater.config import NULL_TOKENS, Config
from tidewater.operators import clean as op
from tidewater.operators import matching
from tidewater.plans.pipeline import clean
from tidewater.sources import datagen, files

S = "patient_id string, first_name string, last_name string, admission_date date, email string, _ord long"


def test_survivorship(spark):
    d = dt.date
    rows = [("1", "A", None, d(2024, 5, 1), None, 0), ("1", "A", "B", d(2020, 1, 1), None, 1), ("2", "A", "B", d(2020, 1, 1), "e", 2), ("2", "C", "B", d(2021, 1, 1), "e", 3), ("3", "A", None, None, None, 4), ("3", "B", None, None, None, 5), (None, "A", None, None, None, 6), (None, "B", "B", None, None, 7)]
    got = {r.patient_id: r._ord for r in op.survivorship(spark.createDataFrame(rows, S), "patient_id").collect()}
    assert got == {"1": 1, "2": 3, "3": 4, None: 7}


def test_dedup_counts(spark):
    rows = [("P1", "A", "B", None, "e", 0), ("P1", "A", "B", None, "e", 1), ("P1", "A", None, None, None, 2), ("P2", "A", "B", None, None, 3)]
    out, report = op.drop_duplicates(spark.createDataFrame(rows, S), "patient_id")
    assert report == {"rows_in": 4, "exact_duplicate_rows_removed": 1, "same_patient_rows_removed": 1, "rows_out": 2}
    assert {r._ord for r in out.collect()} == {0, 3}


def test_numbers_and_phone(spark):
    df = spark.createDataFrame([("$1,234.50", "(555) 123-4567"), ("USD 12", "12"), ("1e5", None), ("-", "555.123.4567x"), ("5.", "")], "n string, p string")
    assert [r.x for r in df.select(op.to_number(F.col("n")).alias("x")).collect()] == [1234.5, 12.0, 15.0, None, 5.0]
    assert [r.x for r in df.select(op.phone(F.col("p")).alias("x")).collect()] == ["555-123-4567", None, None, "555-123-4567", None]


def test_impute(spark):
    cfg = Config(constant_fills={}, median_groups={"total_charges": ("department",)})
    df = spark.createDataFrame([("a", 1.04), ("a", 3.0), ("a", None), ("b", None), ("c", 106.25)], "department string, total_charges double")
    got = sorted((r.department, r.total_charges, r.imputed_fields) for r in op.impute(df, cfg).collect() if r.imputed_fields is None)
    assert got == [("a", 1.0, None), ("a", 3.0, None), ("c", 106.2, None)]
    assert {r.department: r.total_charges for r in op.impute(df, cfg).where("imputed_fields is not null").collect()} == {"a": 2.0, "b": 2.5}
    whole = spark.createDataFrame([("a", 1.04)], "department string, total_charges double")
    assert op.impute(whole, cfg).first().total_charges == 1.04


def test_age_bands(spark):
    got = spark.createDataFrame([(None,), (-1,), (12,), (13,), (17,), (18,), (39,), (40,), (64,), (65,)], "a int").select(op.age_band(F.col("a")).alias("b")).collect()
    assert [r.b for r in got] == ["Unknown", "0-12", "0-12", "13-17", "13-17", "18-39", "18-39", "40-64", "40-64", "65+"]


def people(spark, rows):
    return spark.createDataFrame([(k, f, last, dt.date.fromisoformat(d) if d else None, g) for k, f, last, d, g in rows], "patient_id string, first_name string, last_name string, date_of_birth date, gender string")


def test_matching(spark):
    df = people(spark, [("1", "Lucia", "Wong", "1985-04-12", "F"), ("2", "Ulcia", "Wogn", "1985-04-12", "F"), ("3", "Ana", "Ruiz", None, "F"), ("4", "Ana", "Ruiz", "1990-01-01", "M"), ("5", "Ana", "Ruiz", None, "F"), ("6", "Bo", "Xu", "1970-01-02", None)])
    pairs, stats = matching.find_fuzzy_duplicates(df)
    assert {(r.patient_id_a, r.patient_id_b, r.dob_relation, r.confidence) for r in pairs.collect()} == {("1", "2", "exact", "medium"), ("3", "5", "unknown", "low")}
    assert stats["vetoed_on_gender_conflict"] == 2 and stats["records_without_dob"] == 2 and stats["records_involved"] == 4
    got = {r.patient_id: r.possible_duplicate_of for r in matching.annotate(df, pairs).collect()}
    assert got == {"1": "2", "2": "1", "3": "5", "4": None, "5": "3", "6": None}


def test_block_limits(spark):
    for n, pairs in ((100, 4950), (101, 0)):
        df = people(spark, [(f"{i:03d}", "Ana", f"{chr(97 + i % 26)}{chr(97 + i // 26)}x", "1985-04-12", "F") for i in range(n)])
        assert matching.candidates(matching.blocks(matching.records(df, "patient_id"))).count() == pairs
    apart = people(spark, [(f"{i:03d}", "Ana", "Ruiz", f"{1950 + i}-04-12", "F") for i in range(30)])
    assert matching.candidates(matching.blocks(matching.records(apart, "patient_id"))).count() == 0


def test_clean(spark, tmp_path):
    raw = datagen.generate(spark, 120)
    files.write_single(raw, str(tmp_path / "raw.csv"))
    df = files.load_raw(spark, str(tmp_path / "raw.csv"))
    out, report, pairs = clean(df, as_of="2026-09-01", fuzzy_threshold=0.9)
    rows = out.collect()
    assert len({r.patient_id for r in rows}) == len(rows) == report["volume"]["rows_out"] and len(out.columns) == 27
    d = report["duplicates"]
    assert d["rows_in"] - d["exact_duplicate_rows_removed"] - d["same_patient_rows_removed"] == d["rows_out"]
    assert all("discharge_before_admission" in r.dq_flags for r in rows if r.length_of_stay_days is not None and r.length_of_stay_days < 0)
    files.write_report(report, str(tmp_path / "report.json"))
    files.print_report(report)


def test_partial_and_empty(spark):
    df = spark.createDataFrame([], "patient_id string, email string, phone string")
    out, report, pairs = clean(df, as_of="2026-09-01")
    assert out.count() == 0 and pairs.columns == [] and "bp_inverted" not in report["validation"]


def test_every_query_has_unique_columns(spark):
    for name, f in queries.QUERIES.items():
        cols = f(spark, "/root/testdata/sf0.001").columns
        assert len(cols) == len(set(cols)), name


def test_normalize_name_reads_whole_texts(spark, tmp_path):
    import re
    import unicodedata

    texts = ["word " * 40 + "Zoë Ångström-O'Neil", "Ü" * 300 + "\tŐ x", "a\n b 1c " * 200, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
        got = {r.doc_id: r.name for r in queries.QUERIES["normalize_name"](spark, sf).collect()}
        assert got.keys() == docs.keys()
        for k, t in docs.items():
            plain = "".join(c for c in unicodedata.normalize("NFKD", t or "").lower() if not unicodedata.combining(c))
            assert got[k] == re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", " ", plain)).strip()


def test_blocks_keep_their_size(spark, tmp_path):
    found = {}
    for n in (4_000, 40_000):
        spark.range(1, n + 1).selectExpr("id AS p_partkey", "'a b' AS p_name").write.parquet(str(tmp_path / f"{n}/part.parquet"))
        sizes = matching.blocks(matching.records(queries._matchable(spark, str(tmp_path / f"{n}")), "patient_id")).groupBy("kind", "dated", "k1", "k2").count()
        most = {r.kind: r.m for r in sizes.groupBy("kind").agg(F.max("count").alias("m")).collect()}
        pairs = [queries.QUERIES[q](spark, str(tmp_path / f"{n}")) for q in ("block_pairs", "fuzzy_duplicates")]
        found[n] = most, [pairs[0].count(), pairs[1].where("dob_relation <> 'unknown'").count(), pairs[1].where("dob_relation = 'unknown'").count()]
    (small, few), (large, many) = found[4_000], found[40_000]
    exact = ("dob", "signature")  # kinds whose blocks hold one family of the made-up people
    assert len(large) == 5 and all(large[k] <= max(16, 2 * small[k]) for k in exact), found
    assert all(8 * a < b < 40 * a for a, b in zip(few, many, strict=True)), found


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    import os

    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("customer", "documents", "orders", "part"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall(), key=str)
    got = sorted(map(tuple, df.select(cols).collect()), key=str)
    assert len(got) == len(want) and want
    assert all(x == y or isinstance(x, float) and x == pytest.approx(y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_csv_rows_and_headers(spark, tmp_path):
    def read(text: str):
        (tmp_path / "x.csv").write_text(text, encoding="utf-8")
        return files.load_raw(spark, str(tmp_path / "x.csv"))

    rows = read('"a,b","a,c"\n0012," x "\n"q""q","two\nlines"\nshort\n').drop("_ord").collect()
    assert [tuple(r) for r in rows] == [("0012", " x "), ('q"q', "two\nlines"), ("short", None)]
    for bad in ("a,b\n1,2\n3,4,5\n", "a,b\n1,2,3,4,5\n"):
        with pytest.raises(Exception, match="more cells than its header"):
            read(bad).collect()
        with pytest.raises(Exception, match="more cells than its header"):
            read(bad).count()
    with pytest.raises(ValueError, match="repeated header"):
        read("a,a\n1,2\n")
    with pytest.raises(FileNotFoundError):
        files.load_raw(spark, str(tmp_path / "none.csv"))


def test_single_file_keeps_every_cell(spark, tmp_path):
    rows = [(i, t, dt.date(2024, 1, 2) if i % 2 else None, i % 3 == 0) for i, t in enumerate(['a"b', "c,d", "two\nlines", None, "é", ""])]
    df = spark.createDataFrame(rows, 'i long, `x,y` string, d date, ok boolean').repartition(3)
    path = str(tmp_path / "out/one.csv")
    files.write_single(df, path)
    got = {tuple(r) for r in files.load_raw(spark, path).drop("_ord").collect()}
    assert got == {(str(i), t or None, str(d) if d else None, str(ok)) for i, t, d, ok in rows}
    assert not (tmp_path / "out/one.csv.parts").exists()


def test_source_of_dirty_rows(spark):
    rows = datagen.generate(spark, 400).collect()
    assert sorted(rows) == sorted(datagen.generate(spark, 400).repartition(7).collect()) and rows != datagen.generate(spark, 400, 7).collect()
    keys = {r.patient_id for r in rows}
    assert len(rows) == 400 and len(keys) == 364 and 400 - len(set(rows)) == 18
    by: dict = {}
    for r in rows:
        by.setdefault(r.patient_id, set()).add(r)
    near = [g for g in by.values() if len(g) > 1]
    assert near and all(len({r.email for r in g} | {r.phone for r in g} | {r.weight_kg for r in g} | {r.insurance_provider for r in g} | {r.blood_type for r in g}) > 5 for g in near)
    # A key's birth dates are renderings of one date, and all that isn't a gap can be read.
    born = spark.createDataFrame(datagen.generate(spark, 3000).collect()).select("patient_id", "date_of_birth", datagen.read_birth(F.col("date_of_birth")).alias("b")).cache()
    assert born.where("b is null").select("date_of_birth").distinct().count() <= len(NULL_TOKENS)
    assert born.where("b is not null").groupBy("patient_id").agg(F.countDistinct(F.expr("date_format(b, 'MM-dd')")).alias("n")).where("n > 1").count() == 0
    dice = datagen.Dice(1, F.col("id"))
    slips = spark.range(200).select(datagen.slip(F.lit("abcdef"), dice, "x").alias("s"), datagen.slip(F.lit("ab"), dice, "x").alias("short")).collect()
    assert {len(r.s) for r in slips} == {5, 6, 7} and all(r.s != "abcdef" and r.short == "ab" for r in slips)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import json

    from tidewater import cli

    monkeypatch.setattr(spark, "stop", lambda: None)
    raw, out, report, pairs = (str(tmp_path / n) for n in ("raw.csv", "clean.csv", "report.json", "pairs.csv"))
    assert cli.main(["--generate", "300", "--output", raw, "--seed", "3"]) == 0
    assert "300 rows, 273 distinct keys, 14 exact duplicates, 13 more rows of a known key" in capsys.readouterr().out
    assert cli.main(["-i", raw, "-o", out, "--report-json", report, "--fuzzy-report", pairs, "--as-of", "2026-09-01", "--date-convention", "dayfirst"]) == 0
    found = json.loads(open(report).read())
    rows = files.load_raw(spark, out)
    assert rows.count() == found["volume"]["rows_out"] == 273 and rows.columns[0] == "patient_id"
    assert files.load_raw(spark, pairs).count() == found["fuzzy_duplicates"]["candidate_pairs"]
    assert cli.main(["-i", raw, "-o", out, "--as-of", "2026-09-01", "--valid-only", "--no-fuzzy"]) == 0
    valid = files.load_raw(spark, out)
    assert 0 < valid.count() < 273 and {r.is_valid for r in valid.select("is_valid").collect()} == {"True"}
    assert cli.main(["-i", str(tmp_path / "none.csv")]) == 1


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    from tidewater.streaming.stages import stateless

    raw = datagen.generate(spark, 60)
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateless(stream, "dayfirst", "2026-09-01").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).start(str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    want = stateless(raw, "dayfirst", "2026-09-01")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        stateless(stream, "auto", "2026-09-01")


def test_sql_functions(spark):
    from tidewater.functions import similarity

    similarity.register(spark)
    row = spark.sql("SELECT normalize_name('Bergström-O''X  1') AS n, normalize_name(null) AS e, letter_signature('ba', 'c a') AS s, jaro('MARTHA', 'MARHTA') AS j, jaro_winkler('a', null) AS w").first()
    assert (row.n, row.e, row.s, row.w) == ("bergstrom o x", "", "aabc", None) and row.j == pytest.approx(17 / 18)
