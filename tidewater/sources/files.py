"""CSV in (every cell literal text) and CSV, JSON, console out."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import ORD

OVER = "_tw_over"


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the file order in `_ord`. Short rows lack their last cells; a row with more cells than the header is an error when read, a repeated header at once."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    head = spark.read.text(path).first()
    names = next(csv.reader([head.value]), []) if head else []
    if len(set(names)) < len(names):
        raise ValueError(f"repeated header in {path}")
    if not names:
        return spark.createDataFrame([], f"{ORD} long")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*names, OVER])
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    fits = F.when(F.col(OVER).isNotNull(), F.raise_error(F.lit(f"a row of {path} has more cells than its header")).cast("boolean")).otherwise(F.lit(True))
    return df.where(fits).drop(OVER).withColumn(ORD, F.monotonically_increasing_id())


def as_text(df: DataFrame) -> DataFrame:
    """Dates as yyyy-MM-dd, booleans as True/False, the rest as it is."""
    how = {"date": lambda c: F.date_format(c, "yyyy-MM-dd"), "boolean": lambda c: F.initcap(F.col(c).cast("string"))}
    return df.select(*[how[t](c).alias(c) if t in how else F.col(c) for c, t in df.dtypes])


def write_output(df: DataFrame, path: str, header: bool = True) -> None:
    """A folder of CSV parts; missing cells are empty."""
    as_text(df).write.mode("overwrite").options(header=header, emptyValue="", quote='"', escape='"').csv(path)


def write_single(df: DataFrame, path: str) -> None:
    """One CSV file: parts are written by the executors, then joined by the file system as streams."""
    spark = df.sparkSession
    parts = f"{path}.parts"
    write_output(df, parts, header=False)
    (at, fs), (folder, _) = _at(spark, path), _at(spark, parts)
    jvm = spark.sparkContext._jvm
    out = fs.create(at, True)
    out.write(bytearray((",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') else c for c in df.columns) + "\n").encode()))
    for name in sorted(s.getPath().getName() for s in fs.listStatus(folder)):
        if name.startswith("part-"):
            part = fs.open(_at(spark, f"{parts}/{name}")[0])
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    out.close()
    fs.delete(folder, True)


def write_report(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, default=str), encoding="utf-8")


def print_report(report: dict) -> None:
    v, d = report["volume"], report["duplicates"]
    print(f"Volume: {v['rows_in']} rows in, {v['rows_out']} out; {v['columns_in']} columns in, {v['columns_out']} out")
    print(f"Duplicates: {d['exact_duplicate_rows_removed']} exact, {d['same_patient_rows_removed']} of the same key")
    for c, x in report["dates"].items():
        print(f"Dates, {c}: {x['convention_used']}, {x['parsed']} parsed, {x['unparseable']} not, {x['century_corrections']} moved a century")
    for c, n in report["missing_before"].items():
        print(f"Missing, {c}: {n} -> {report['missing_after'].get(c, n)}")
    for c, x in report["numerics"].items():
        print(f"Quarantine, {c}: {x['implausible_quarantined']} outside {x['plausible_range']}, {x['non_numeric_coerced']} not numbers")
    if report["fuzzy_duplicates"]["enabled"]:
        x = report["fuzzy_duplicates"]
        print(f"Probable duplicates: {x['candidate_pairs']} pairs among {x['pairs_compared']} compared, {x['vetoed_on_gender_conflict']} vetoed")
    for c, n in report["validation"].items():
        print(f"Check, {c}: {n}")
