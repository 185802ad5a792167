"""Vectors as comma-separated text, there and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def serialized(values: Column) -> Column:
    """An array as one line."""
    return F.concat_ws(",", F.transform(values, lambda x: x.cast("string")))


def deserialized(line: Column, kind: str = "double") -> Column:
    """A line as an array; an empty line is an empty array."""
    parts = F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast(kind))
    return F.when(F.length(F.trim(line)) == 0, F.array().cast(f"array<{kind}>")).otherwise(parts)
