"""Meta paths relaxed from the same place to places nearby: ``M(i, c, m)``, exactly or over a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import decay_weight, half_edge_weight

from .epsilon import nearest_pairs


def weighted_pairs(coordinates: DataFrame, eps_m: float, weighted: bool = False, of: DataFrame | None = None) -> DataFrame:
    """``u, v, w``: all places *v* in range of each place *u*, itself included; with *of* (``id``) only for these *u*."""
    probes = coordinates if of is None else coordinates.join(of.select("id").distinct(), "id", "left_semi")
    return nearest_pairs(probes, coordinates, eps_m).select("u", "v", decay_weight(F.col("dist"), eps_m, weighted).alias("w")).where("w > 0")


def pair_columns(coordinates: DataFrame, eps_m: float, weighted: bool = False, of: DataFrame | None = None) -> DataFrame:
    """``j, u, v, w``: each pair of places in range is a column, with an entry for either place (one for a place with itself).

    With *of* (``id``) only entries of these places.
    """
    pairs = weighted_pairs(coordinates, eps_m, weighted, of)
    return pairs.select(F.col("u").alias("j"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), half_edge_weight(F.col("w"), weighted).alias("w"))


def cell_columns(coordinates: DataFrame, eps_m: float, cells, weighted: bool = False) -> DataFrame:
    """``j, cell, w``: each anchor in range of a place is a column; weights of repeated coordinates add."""
    if eps_m < 0:
        raise ValueError("a distance can't be negative")
    found = cells.near(coordinates, eps_m).withColumn("w", decay_weight(F.col("dist"), eps_m, weighted)).where("w > 0")
    return found.select(F.col("id").alias("j"), "cell", "w").groupBy("j", "cell").agg(F.sum("w").alias("w"))


def extend_columns(left: DataFrame, columns: DataFrame, weighted: bool = False) -> DataFrame:
    """``i, c, m``: *left* through what :func:`pair_columns` or :func:`cell_columns` made."""
    return _extended(left, columns, F.struct("u", "v") if "u" in columns.columns else F.col("cell"), weighted)


def _extended(left: DataFrame, right: DataFrame, column: Column, weighted: bool) -> DataFrame:
    value = F.col("v").cast("double") if weighted else F.col("v")
    right = right.select(F.col("j").alias("place"), column.alias("c"), "w")
    joined = left.select("i", "j", value.alias("v")).join(right, F.col("j") == F.col("place"))
    return joined.groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("m"))


def extend_exact(left: DataFrame, coordinates: DataFrame, eps_m: float, weighted: bool = False) -> DataFrame:
    """``i, c, m`` with ``c`` a struct of two places: *left* (``i, j, v``) through all pairs of places in range."""
    return _extended(left, pair_columns(coordinates, eps_m, weighted), F.struct("u", "v"), weighted)


def extend_grid(left: DataFrame, coordinates: DataFrame, eps_m: float, cells, weighted: bool = False) -> DataFrame:
    """``i, c, m`` with ``c`` a cell: *left* through all anchors in range."""
    return _extended(left, cell_columns(coordinates, eps_m, cells, weighted), F.col("cell"), weighted)


def through(extended: DataFrame, columns: DataFrame, right: DataFrame) -> DataFrame:
    """Goes on from a relaxed place to the rest of a path: ``i, j, v`` of *extended* x *columns* transposed x *right*.

    *columns* is what *extended* was made with (:func:`pair_columns` or :func:`cell_columns`).
    """
    key = F.struct("u", "v") if "u" in columns.columns else F.col("cell")
    back = columns.select(key.alias("to"), F.col("j").alias("place"), "w")
    rest = right.select(F.col("i").alias("at"), F.col("j").alias("end"), F.col("v").alias("by"))
    places = extended.join(back, F.col("c") == F.col("to")).groupBy("i", "place").agg(F.sum(F.col("m") * F.col("w")).alias("m"))
    return places.join(rest, F.col("place") == F.col("at")).groupBy("i", F.col("end").alias("j")).agg(F.sum(F.col("m") * F.col("by")).alias("v"))


def place_sums(coordinates: DataFrame, eps_m: float, weighted: bool = False, of: DataFrame | None = None) -> DataFrame:
    """``j, n, s, k``: how many columns of :func:`pair_columns` a place is in, the sum of its entries there and of their squares."""
    pairs = weighted_pairs(coordinates, eps_m, weighted, of)
    return pairs.groupBy(F.col("u").alias("j")).agg(F.count("*").alias("n"), F.sum(half_edge_weight(F.col("w"), weighted)).alias("s"), F.sum("w").alias("k"))


def place_kernel(coordinates: DataFrame, eps_m: float, weighted: bool = False, of: DataFrame | None = None) -> DataFrame:
    """``a, b, k``: how much two places share, so that scores need no extended matrix; with *of* (``id``) only for these *a*.

    The columns' inner products: of two places the weight of their pair; of a place with itself the sum of
    the weights of all its pairs.
    """
    between = weighted_pairs(coordinates, eps_m, weighted, of).where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("k"))
    own = place_sums(coordinates, eps_m, weighted, of)
    return between.unionByName(own.select(F.col("j").alias("a"), F.col("j").alias("b"), "k"))


def cell_kernel(coordinates: DataFrame, eps_m: float, cells, weighted: bool = False) -> DataFrame:
    """``a, b, k`` of the grid's columns: the inner products of two places' anchors, by a join on the anchor."""
    c = cell_columns(coordinates, eps_m, cells, weighted)
    x, y = (c.select(F.col("j").alias(p), "cell", F.col("w").alias(f"w_{p}")) for p in "ab")
    return x.join(y, "cell").groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("k"))
