"""Distances, weights and boxes as column expressions; everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in metres. A fixed value.
RADIUS_M = 6371008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2.0))
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.lit(2.0 * RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def decay_weight(distance: Column, eps_m: float, weighted: bool) -> Column:
    """1 for every pair in range, or a weight that falls linearly to 0 at *eps_m*."""
    if not weighted:
        return F.lit(1).cast("bigint")
    if eps_m <= 0:
        return F.when(distance <= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(float(eps_m)))


def half_edge_weight(weight: Column, weighted: bool) -> Column:
    """Of each half of an edge through a pair of places: the halves multiply back to the weight."""
    return F.sqrt(weight) if weighted else weight


def pair_score(dot: Column, delta_a: Column, delta_b: Column) -> Column:
    """``2 dot / (delta_a + delta_b)``, and 0 where both deltas are 0."""
    total = delta_a + delta_b
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(2.0) * dot / total)


def box_gap_squared(low: list[Column], high: list[Column], box_low: list[float], box_high: list[float]) -> Column:
    """Squared planar distance between axis-parallel boxes; 0 where they touch."""
    total = F.lit(0.0)
    for a, b, c, d in zip(low, high, box_low, box_high, strict=True):
        gap = F.greatest(F.lit(0.0), F.lit(float(c)) - b, a - F.lit(float(d)))
        total = total + gap * gap
    return total


def discounted_gain(relevance: Column, rank: Column) -> Column:
    """``(2^rel - 1) / log2(rank + 1)`` for ranks from 1."""
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)


def cell_hex(cell: Column) -> Column:
    """A cell's id in lower-case hexadecimal."""
    return F.lower(F.hex(cell))
