"""Connected components: in one task up to a checked number of edges, beyond it by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: Edges that one task takes, in about 200 MB; more are never brought together.
ALONE = 1 << 21


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges and the smallest node of each one's component."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (label[x], label[y], x, y):
            np.minimum.at(new, end, low)
        while not np.array_equal(new, up := new[new]):
            new = up
        if np.array_equal(new, label):
            return node, node[label]
        label = new


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60, alone: int | None = None) -> DataFrame:
    """``node, component`` of every node of *edges* (columns ``a`` and ``b``, bigint), by its smallest member.

    Nodes without edges aren't in the result.  Self-loops, repeated edges and edges with a null end don't
    count.  A round keeps no more edges than there were; the number of rounds grows with the logarithm
    of a component's diameter, and more than *rounds* are an error.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()
    now = shared.stored(clean)
    if now.count() <= (ALONE if alone is None else alone):
        return _together(now)
    mark = _print(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("small").alias("big"), F.col("big").alias("small"))).withColumnsRenamed({"big": "u", "small": "v"})
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = shared.stored(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct())
        least = large.groupBy("big").agg(F.min("small").alias("m"))
        joined = large.join(least, "big")
        small = joined.select(F.col("small").alias("big"), F.col("m").alias("small")).where("big <> small").unionByName(least.select("big", F.col("m").alias("small"))).distinct()
        new = shared.stored(small)
        shared.dropped(now, large)
        new_mark = _print(new)
        now, old, mark = new, mark, new_mark
        if new_mark == old:
            break
    else:
        raise RuntimeError(f"components aren't done after {rounds} rounds")
    # every edge now leads from a node to its component's smallest member
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(now.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct())


def _together(edges: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for batch in batches:
            for side, name in zip(ends, ("big", "small"), strict=True):
                side.append(batch.column(batch.schema.get_field_index(name)).to_numpy())
        node, least = least_labels(*(np.concatenate(x) for x in ends))
        for lo in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (node, least)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(shared.frugal(solve), "node long, component long")
