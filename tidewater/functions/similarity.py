"""Jaro and Jaro-Winkler; no built-in exists, so Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def jaro_score(a: str, b: str) -> float:
    """Matches are sought left to right within the window, each place once; half-transpositions round down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    open_b, left = list(b), []
    for i, ch in enumerate(a):
        lo = max(0, i - reach)
        try:
            j = open_b.index(ch, lo, min(len(b), i + reach + 1))
        except ValueError:
            continue
        open_b[j] = None
        left.append(ch)
    if not left:
        return 0.0
    right = [ch for ch, free in zip(b, open_b, strict=True) if free is None]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_score(a: str, b: str, weight: float = 0.1, longest: int = 4, floor: float = 0.7) -> float:
    base = jaro_score(a, b)
    if base < floor:
        return base
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return base + min(same, longest) * weight * (1 - base)


def _pairwise(score):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else score(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return run.asNondeterministic()  # so that a filter and a projection share one evaluation


def jaro(a: Column, b: Column) -> Column:
    return _pairwise(jaro_score)(a, b)


def jaro_winkler(a: Column, b: Column, weight: float = 0.1, longest: int = 4, floor: float = 0.7) -> Column:
    return _pairwise(lambda x, y: jaro_winkler_score(x, y, weight, longest, floor))(a, b)


def name_score(left: str, right: str, swapped: str) -> float:
    return max(jaro_winkler_score(left, right), jaro_winkler_score(left, swapped)) if left and right else 0.0


def name_similarity(left: Column, right: Column, swapped: Column) -> Column:
    """Full names against each other, the right one also in the other order; an empty name scores zero."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([name_score(*x) for x in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)], pa.float64())

    return run.asNondeterministic()(left, right, swapped)


@F.arrow_udf(StringType())
def _normalized(names: pa.Array) -> pa.Array:
    import re
    import unicodedata

    def one(x: str | None) -> str:
        wide = unicodedata.normalize("NFKD", x or "").lower()
        return " ".join(re.sub(r"[^a-z\s]", " ", "".join(c for c in wide if not unicodedata.category(c).startswith("M"))).split())

    return pa.array([one(x) for x in names.to_pylist()], pa.string())


def register(spark) -> None:
    """SQL functions jaro, jaro_winkler, normalize_nfkd, normalize_name, letter_signature; soundex is Spark's own."""
    from .text import _decompose

    @F.arrow_udf("string")
    def signature(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else "".join(sorted((x + y).replace(" ", ""))) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    for name, f in (("jaro", _pairwise(jaro_score)), ("jaro_winkler", _pairwise(jaro_winkler_score)), ("normalize_nfkd", _decompose), ("normalize_name", _normalized), ("letter_signature", signature)):
        spark.udf.register(name, f)
