"""A matrix of counts and its deltas kept up to date from a stream of edges.

Each micro-batch hands on what has changed, and only that: entries with their new counts, and parts of rows'
deltas.  Changes are written under their batch's number, so a batch that is run again replaces itself; of
each key the last change holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "batch long, i long, j long, v long"
PARTS = "batch long, i long, part int, delta long"


def changed_entries(edges: DataFrame) -> DataFrame:
    """``i, j, v`` of a streaming ``i, j``, in update mode: entries that a batch has changed. The state is Spark's own."""
    return edges.dropna(subset=["i", "j"]).groupBy("i", "j").agg(F.count("*").alias("v"))


def changed_deltas(edges: DataFrame, parts: int = 16) -> DataFrame:
    """``i, part, delta`` of a streaming ``i, j``, in update mode: sums of squares of the parts of rows that a batch has changed.

    A row's columns are dealt to *parts* by their hash, so that no key holds a whole long row.  A part's state
    has its columns and counts in order; a change of d to a count v adds ``d (2 v + d)``.
    """
    dealt = edges.dropna(subset=["i", "j"]).select("i", "j", F.pmod(F.xxhash64("j"), F.lit(parts)).cast("int").alias("part"))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        j, v, delta = (np.array(x, np.int64) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
        for frame in frames:
            new, more = np.unique(frame["j"].to_numpy(np.int64), return_counts=True)
            at = np.searchsorted(j, new)
            known = np.zeros(len(new), bool)
            inside = at < len(j)
            known[inside] = j[at[inside]] == new[inside]
            old = np.zeros(len(new), np.int64)
            old[known] = v[at[known]]
            delta = delta + int((more * (2 * old + more)).sum())
            v[at[known]] += more[known]
            j, v = np.insert(j, at[~known], new[~known]), np.insert(v, at[~known], more[~known])
        state.update((j.tolist(), v.tolist(), delta.tolist()))
        yield pd.DataFrame({"i": [key[0]], "part": [key[1]], "delta": delta})

    return dealt.groupBy("i", "part").applyInPandasWithState(update, "i long, part int, delta long", "j array<long>, v array<long>, delta array<long>", "update", "NoTimeout")


def keep(changes: DataFrame, path: str, checkpoint: str):
    """A started query that keeps a stream of changes under *path*."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def _last(spark: SparkSession, path: str, schema: str, keys: list[str], value: str) -> DataFrame:
    found = spark.read.schema(schema).option("basePath", path).parquet(path)
    return found.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def kept_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, v``: the adjacency after the last batch."""
    return _last(spark, path, ENTRIES, ["i", "j"], "v")


def kept_deltas(spark: SparkSession, path: str) -> DataFrame:
    """``i, delta`` after the last batch."""
    return _last(spark, path, PARTS, ["i", "part"], "delta").groupBy("i").agg(F.sum("delta").alias("delta"))


def compacted(changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Changes (with their ``batch``) of which only the last of each key is left, under its batch."""
    return changes.groupBy(*keys).agg(F.max_by(value, "batch").alias(value), F.max("batch").alias("batch")).select("batch", *keys, value)
