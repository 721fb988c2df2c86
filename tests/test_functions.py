import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import dates, similarity, text


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    day = dt.datetime(1985, 4, 12)
    same = ["1985-04-12", "1985/04/12", "12/04/1985", "12.04.1985", "12-Apr-1985", "12 Apr 1985", "April 12, 1985", "19850412", "12/04/85", "1985-4-12", "1985412"]
    assert column(spark, same, lambda c: dates.parse_date(c, True)) == [day] * len(same)
    assert column(spark, ["04/12/1985", "25/04/1985"], lambda c: dates.parse_date(c, False)) == [day, dt.datetime(1985, 4, 25)]
    assert column(spark, ["04/12/1985"], lambda c: dates.parse_date(c, True)) == [dt.datetime(1985, 12, 4)]
    none = ["not a date", "31/31/1985", "", None, "29/02/2023", "1600-01-01", "2300-01-01", "12 April 1985", "April 12,1985"]
    assert column(spark, none, lambda c: dates.parse_date(c, True)) == [None] * len(none)
    assert column(spark, ["1985-04-12T09:30:00"], lambda c: dates.parse_date(c, True)) == [dt.datetime(1985, 4, 12, 9, 30)]


def test_century(spark):
    got = column(spark, ["2055-04-12", "2026-09-01", None, "1955-04-12"], lambda c: dates.fix_century(c.cast("timestamp_ntz"), "2026-09-01"))
    assert got == [dt.datetime(1955, 4, 12), dt.datetime(2026, 9, 1), None, dt.datetime(1955, 4, 12)]


@pytest.mark.parametrize("values, expected", [(["25/04/1985", "31/01/1990", "04/12/1985"], (2, 0)), (["04/25/1985", "01/31/1990", "04/12/1985"], (0, 2)), ([None, "1985-04-12"], (0, 0)), (["31/31/1985", "25/04.1985"], (2, 1))])
def test_evidence(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert tuple(df.agg(*dates.evidence(F.col("s"))).first()) == expected


def test_relation(spark):
    rows = [("1985-04-12", "1985-04-12", "exact"), ("1985-04-12", "1985-12-04", "transposed"), ("1985-04-12", "1985-07-30", "same_year"), ("1985-04-12", "1990-04-12", None), ("1985-04-12", None, "unknown")]
    df = spark.createDataFrame(rows, "a string, b string, e string").select(dates.dob_relation(F.to_date("a"), F.to_date("b")).alias("x"), "e")
    assert all(r.x == r.e for r in df.collect())


@pytest.mark.parametrize("a, b, j", [("MARTHA", "MARHTA", 0.944), ("DIXON", "DICKSONX", 0.767), ("DWAYNE", "DUANE", 0.822), ("JELLYFISH", "SMELLYFISH", 0.896), ("CRATE", "TRACE", 0.733), ("ABCVWXYZ", "CABVWXYZ", 0.958), ("aaab", "abcd", 0.5), ("", "", 1.0), ("a", "", 0.0)])
def test_jaro(a, b, j):
    assert similarity.jaro_score(a, b) == pytest.approx(j, abs=1e-3)
    assert similarity.jaro_score(b, a) == pytest.approx(j, abs=1e-3)


@pytest.mark.parametrize("a, b, j", [("MARTHA", "MARHTA", 0.961), ("DIXON", "DICKSONX", 0.813), ("DWAYNE", "DUANE", 0.840), ("JELLYFISH", "SMELLYFISH", 0.896), ("lucia wong", "ulcia wogn", 0.9333)])
def test_jaro_winkler(a, b, j):
    assert similarity.jaro_winkler_score(a, b) == pytest.approx(j, abs=1e-3)


def test_names(spark):
    raw = ["Bergström", "Núñez", "O'Souza", "Smith-Jones", "  A  B ", None, "", "Søren"]
    assert column(spark, raw, text.normalize_name) == ["bergstrom", "nunez", "o souza", "smith jones", "a b", "", "", "s ren"]
    assert similarity.name_score("dominic ng", "ng dominic", "dominic ng") == 1.0
    assert column(spark, ["o'souza", "smith-JONES", "2nd"], text.title_case) == ["O'Souza", "Smith-Jones", "2Nd"]
    assert column(spark, ["robert", "rupert", "rubin", "ashcraft", "tymczak", "pfister", "honeyman", ""], text.soundex_key) == ["R163", "R163", "R150", "A261", "T522", "P236", "H555", ""]


def test_metaphone(spark):
    words = ["hana", "hassan", "noah", "marc", "wong", "knight", "night", "smith", "smyth", "phil", "fil", ""]
    got = dict(zip(words, column(spark, words, text.metaphone_key), strict=True))
    assert [got[w] for w in ("hana", "hassan", "noah", "marc", "wong", "")] == ["N", "SN", "NH", "MRS", "WNJ", ""]
    assert got["knight"] == got["night"] and got["phil"] == got["fil"] and got["smith"] == got["smyth"]


def test_squeeze_and_tokens(spark):
    assert column(spark, ["  a   b ", "N/A", "Unknown", "0012"], lambda c: text.null_tokens(text.squeeze(c))) == ["a b", None, None, "0012"]
