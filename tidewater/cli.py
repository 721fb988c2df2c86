"""python -m tidewater.cli: clean a CSV extract, or generate one."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import SparkSession

from .plans.pipeline import clean
from .sources import datagen, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", "-i", default="data/raw/messy_patients.csv")
    p.add_argument("--output", "-o", default="data/clean/patients_clean.csv")
    p.add_argument("--report-json")
    p.add_argument("--key", default="patient_id")
    p.add_argument("--date-convention", choices=("auto", "dayfirst", "monthfirst"), default="auto")
    p.add_argument("--as-of", default=None)
    p.add_argument("--valid-only", action="store_true")
    p.add_argument("--fuzzy-threshold", type=float, default=0.90)
    p.add_argument("--no-dob-threshold", type=float, default=0.95)
    p.add_argument("--no-fuzzy", action="store_true")
    p.add_argument("--fuzzy-report")
    p.add_argument("--generate", type=int, metavar="ROWS", help="write ROWS dirty rows to --output instead")
    p.add_argument("--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidewater").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.generate:
        df = datagen.generate(spark, a.generate, a.seed, date.fromisoformat(a.as_of) if a.as_of else date(2026, 9, 1))
        files.write_single(df, a.output)
        keys, rows = df.select("patient_id").distinct().count(), df.distinct().count()
        print(f"{a.generate} rows, {keys} distinct keys, {a.generate - rows} exact duplicates, {rows - keys} more rows of a known key")
        return 0
    try:
        raw = files.load_raw(spark, a.input)
    except FileNotFoundError:
        print(f"No such file: {a.input}", file=sys.stderr)
        return 1
    out, report, pairs = clean(raw, a.date_convention, a.as_of, a.key, None if a.no_fuzzy else a.fuzzy_threshold, a.no_dob_threshold)
    if a.valid_only:
        out = out.where("is_valid")
        report["volume"]["rows_written"] = out.count()
    files.write_single(out, a.output) if a.output.endswith(".csv") else files.write_output(out, a.output)
    if a.report_json:
        files.write_report(report, a.report_json)
    if a.fuzzy_report and not a.no_fuzzy:
        files.write_single(pairs, a.fuzzy_report)
    files.print_report(report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
