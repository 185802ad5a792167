"""The covering radius of a grid: how far a cell's boundary is from its anchor, over all cells.

Distances along a boundary that is made of great-circle arcs are largest at an end of an arc or where
the arc's plane turns from the anchor; vectors on the unit sphere give both in closed form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions import hexagons
from waymesh.functions.geo import RADIUS_M

from .grid import LatticeCells


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Points on the unit sphere, one per row, from degrees."""
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], -1)


def central_angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(-1))


def farthest_on_arc(centre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest angle from *centre* to a point of the shorter arc from *start* to *end*."""
    best = np.maximum(central_angle(centre, start), central_angle(centre, end))
    normal = np.cross(start, end)
    size = np.linalg.norm(normal, axis=-1, keepdims=True)
    normal = np.divide(normal, size, out=np.zeros_like(normal), where=size > 1e-15)
    # the points of the arc's circle that are nearest to and farthest from the centre
    flat = centre - (centre * normal).sum(-1, keepdims=True) * normal
    length = np.linalg.norm(flat, axis=-1, keepdims=True)
    turn = np.divide(flat, length, out=np.zeros_like(flat), where=length > 1e-15)
    for point in (turn, -turn):
        inside = ((np.cross(start, point) * normal).sum(-1) >= 0) & ((np.cross(point, end) * normal).sum(-1) >= 0) & (size[..., 0] > 1e-15) & (length[..., 0] > 1e-15)
        best = np.where(inside, np.maximum(best, central_angle(centre, point)), best)
    return best


def cell_radius(spark: SparkSession, cells: LatticeCells) -> DataFrame:
    """One row: ``cells, vertex_m, boundary_m, farthest_cell, rho_m`` over all cells of a lattice.

    The corners of a cell are joined by great-circle arcs; columns of a band are alike, so a band's cells
    have one geometry and are counted, not repeated.
    """
    lon, lat = cells.centre(F.col("cell"))
    # the first cell of each band, and how many there are
    first = spark.range(cells.bands).select(F.col("id").alias("b"), (F.col("id") * F.lit(1 << 32)).alias("cell"), cells._columns(F.col("id")).cast("bigint").alias("n"))
    bands = first.select("cell", "n", lon.alias("lon"), lat.alias("lat"), "b")
    height = cells.height

    def measure(batches):
        for x in batches:
            low = x["b"].to_numpy() * height - 90
            high = np.minimum(low + height, 90.0)
            half = 180.0 / x["n"].to_numpy()
            lon0, lat0 = x["lon"].to_numpy(), x["lat"].to_numpy()
            centre = unit_vectors(lon0, lat0)
            corners = [unit_vectors(lon0 + s * half, v) for s, v in ((-1, low), (1, low), (1, high), (-1, high))]
            vertex = np.max([central_angle(centre, c) for c in corners], 0)
            arcs = [farthest_on_arc(centre, a, b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
            yield pd.DataFrame({"cell": x["cell"], "n": x["n"], "vertex": vertex * RADIUS_M, "boundary": np.max(arcs, 0) * RADIUS_M})

    return _farthest(bands.mapInPandas(measure, "cell long, n long, vertex double, boundary double"))


def hex_radius(cells: DataFrame) -> DataFrame:
    """The same of hexagons: of *cells* (``cell``), such as ``HexCells.all_cells``, or those that places lie in."""

    def measure(batches):
        for x in batches:
            cell = x["cell"].to_numpy(np.int64)
            corners = hexagons.boundaries(cell)
            size = np.array([len(c) for c in corners], int)
            if not len(size):
                continue
            start = np.concatenate(corners)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            after = np.arange(len(start)) + 1
            after[first + size - 1] = first
            centre = np.repeat(hexagons.centres(cell), size, axis=0)
            vertex = np.maximum.reduceat(central_angle(centre, start), first)
            boundary = np.maximum.reduceat(farthest_on_arc(centre, start, start[after]), first)
            yield pd.DataFrame({"cell": cell, "n": 1, "vertex": vertex * RADIUS_M, "boundary": boundary * RADIUS_M})

    return _farthest(cells.select("cell").dropna().distinct().mapInPandas(measure, "cell long, n long, vertex double, boundary double"))


def _farthest(measured: DataFrame) -> DataFrame:
    return measured.agg(F.sum("n").alias("cells"), F.max("vertex").alias("vertex_m"), F.max("boundary").alias("boundary_m"), F.max_by("cell", F.struct("boundary", F.col("cell"))).alias("farthest_cell"), F.ceil(F.greatest(F.max("vertex"), F.max("boundary"))).cast("bigint").alias("rho_m"))
