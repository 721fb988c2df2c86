"""Dates: one convention per column, inferred from evidence; ordered formats, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: A format is a regular expression and the field that each group holds. y: two digits, b: short month, B: full month.
_D, _T = r"(\d{1,2})", r" (\d{1,2}):(\d{1,2}):(\d{1,2})"
UNAMBIGUOUS = (
    (rf"^(\d{{4}})-{_D}-{_D}{_T}$", "YmdHMS"), (rf"^(\d{{4}})-{_D}-{_D}T{_T[1:]}$", "YmdHMS"), (rf"^(\d{{4}})-{_D}-{_D}$", "Ymd"), (rf"^(\d{{4}})/{_D}/{_D}$", "Ymd"),
    (rf"^{_D}-([A-Za-z]{{3}})-(\d{{4}})$", "dbY"), (rf"^{_D} ([A-Za-z]{{3}}) (\d{{4}})$", "dbY"), (rf"^([A-Za-z]{{3}}) {_D}, (\d{{4}})$", "bdY"), (rf"^([A-Za-z]+) {_D}, (\d{{4}})$", "BdY"),
    (rf"^{_D}-([A-Za-z]+)-(\d{{4}})$", "dBY"), (r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$", "Ymd"),
)


def _numeric(first: str, second: str) -> tuple:
    return (
        (rf"^{_D}/{_D}/(\d{{4}}){_T}$", f"{first}{second}YHMS"), (rf"^{_D}/{_D}/(\d{{4}})$", f"{first}{second}Y"), (rf"^{_D}\.{_D}\.(\d{{4}})$", f"{first}{second}Y"),
        (rf"^{_D}/{_D}/(\d{{2}})$", f"{first}{second}y"), (rf"^{_D}\.{_D}\.(\d{{2}})$", f"{first}{second}y"),
    )


DAY_FIRST, MONTH_FIRST = _numeric("d", "m"), _numeric("m", "d")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
EVIDENCE = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{2,4})$"


def _read(c: Column, pattern: str, fields: str) -> Column:
    part = {f: F.regexp_extract(c, pattern, i + 1) for i, f in enumerate(fields)}
    number = lambda f: F.expr("0") if f not in part else part[f].try_cast("int")
    if "y" in part:
        year = number("y") + F.when(number("y") >= 69, 1900).otherwise(2000)
    else:
        year = number("Y")
    if "b" in part or "B" in part:
        names = [m[:3] for m in MONTHS] if "b" in part else list(MONTHS)
        month = F.array_position(F.array(*map(F.lit, names)), F.lower(part.get("b", part.get("B")))).cast("int")
    else:
        month = number("m")
    at = F.try_make_timestamp_ntz(year, month, number("d"), number("H"), number("M"), number("S"))
    return F.when(c.rlike(pattern), at)


def parse_date(c: Column, day_first: bool) -> Column:
    """TIMESTAMP_NTZ, or null where no format fits or the date is outside 1677-09-22 .. 2262-04-11."""
    ordered = UNAMBIGUOUS + (DAY_FIRST + MONTH_FIRST if day_first else MONTH_FIRST + DAY_FIRST)
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1677-09-22", "2262-04-11"))
    return let(F.coalesce(*[_read(c, p, f) for p, f in ordered]), lambda at: F.when(at.between(low, high), at))


def evidence(c: Column) -> tuple[Column, Column]:
    """Aggregates: how many values can only be day-first, and only month-first."""
    hit = c.rlike(EVIDENCE)
    over = lambda g: F.count_if(hit & (F.regexp_extract(c, EVIDENCE, g).try_cast("int") > 12))
    return over(1), over(2)


def infer_day_first(day: int, month: int) -> bool:
    return day >= month


def fix_century(at: Column, as_of) -> Column:
    """A time after `as_of` (a date or text) goes back 100 years, once."""
    return let(at, lambda x: F.when(x > F.lit(str(as_of)).cast("timestamp_ntz"), x - F.make_ym_interval(F.lit(100), F.lit(0))).otherwise(x))


def dob_relation(a: Column, b: Column) -> Column:
    swapped = (F.month(a) == F.dayofmonth(b)) & (F.dayofmonth(a) == F.month(b))
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "exact").when((F.year(a) == F.year(b)) & swapped, "transposed").when(F.year(a) == F.year(b), "same_year")
