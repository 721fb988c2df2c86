"""What the corpus operators share: shipping code, the shared folder, column handling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's class for the contract's white space, `[\x20\x09-\x0D]`; bytes.split() splits at the same six.
SPACE = r"[\x20\x09-\x0D]"

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that functions pickle by reference."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="tidewater-")) / "tidewater_pkg.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    atexit.register(shutil.rmtree, to.parent, ignore_errors=True)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it is unset (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidewater-shared-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    at, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    at, fs = _at(spark, path)
    half, _ = _at(spark, f"{path}.part")
    stream = fs.create(half, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    fs.rename(half, at)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table lacks, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


_paths: dict[int, str] = {}


def drop_written(df: DataFrame) -> None:
    """Delete what `written` made; the table must have no further reader."""
    path = _paths.pop(id(df), None)
    if path:
        remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now rather than at some later collection of garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(c: str | Column) -> Column:
    """The text as a string that is never null."""
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def tokenizer_file(name: str) -> str:
    """Where an installed public tokenizer lies; looked up where it is used, as each machine has its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions, as the session sets them for the input at hand."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def env_threads() -> None:
    """One thread for native libraries inside a task: Spark owns the parallelism."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def reuse_memory() -> None:
    """Let the C library keep freed blocks, so that large numpy temporaries aren't mapped anew each time."""
    import contextlib
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD
