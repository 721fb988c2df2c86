"""The stages without global state, for streams: text, dates under a fixed convention, vocabularies, numbers, measures."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Config
from ..operators import clean as op


def stateless(stream: DataFrame, convention: str, as_of, cfg: Config = Config()) -> DataFrame:
    if convention == "auto":
        raise ValueError("a stream needs a fixed date convention: evidence is a property of the whole column")
    out, _ = op.standardize_dates(op.standardize_text(stream, cfg), convention, as_of, cfg)
    return op.validate(op.derive(op.add_age(op.numerics(op.conform(out, cfg), cfg), as_of)))
