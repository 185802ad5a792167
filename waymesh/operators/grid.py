"""Fixed anchor points that cover the Earth: a lattice in closed form, or the hexagons of an icosahedron."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions import hexagons
from waymesh.functions.geo import RADIUS_M, haversine_m

#: Covering radius in metres by resolution of the hexagonal grid. Fixed values.
COVER_M = {5: 10838, 6: 4097, 7: 1549, 8: 586, 9: 222}
_SHIFT = 1 << 32


class LatticeCells:
    """Bands of *height* degrees, each cut into columns about as wide; a cell's anchor is its centre.

    Any point is within ``radius_m`` of the anchor of its own cell: half a band along the meridian, then
    half a column along the anchor's parallel.  Ids and scores differ from those of a hexagonal grid.
    """

    def __init__(self, height: float):
        if not 0 < height <= 90:
            raise ValueError("a band is over 0 and up to 90 degrees high")
        self.height = height
        self.bands = math.ceil(180 / height)
        self.radius_m = RADIUS_M * math.radians(height)

    @classmethod
    def of_resolution(cls, resolution: int) -> "LatticeCells":
        """The lattice with the covering radius of a hexagonal grid's resolution (0 to 15)."""
        if not 0 <= resolution <= 15:
            raise ValueError("a resolution is from 0 to 15")
        near = min(max(resolution, 5), 9)
        radius = COVER_M[near] * math.sqrt(7) ** (near - resolution)
        return cls(min(90.0, math.degrees(radius / RADIUS_M)))

    def _middle(self, band: Column) -> Column:
        """Latitude of a band's centre; the last band ends at the pole."""
        low = band * F.lit(self.height) - 90
        return (low + F.least(low + self.height, F.lit(90.0))) / 2

    def _columns(self, band: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.lit(360.0) * F.cos(F.radians(self._middle(band))) / self.height).cast("int"))

    def cell_of(self, lon: Column, lat: Column) -> Column:
        """The id of the cell that a point lies in."""
        band = F.least(F.greatest(F.floor((lat + 90) / self.height), F.lit(0)), F.lit(self.bands - 1)).cast("bigint")
        columns = self._columns(band)
        column = F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * columns), columns - 1)
        return (band * F.lit(_SHIFT) + column).cast("bigint")

    def centre(self, cell: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a cell's anchor."""
        band = F.floor(cell / F.lit(_SHIFT))
        column = F.pmod(cell, F.lit(_SHIFT))
        return (column + F.lit(0.5)) * 360 / self._columns(band) - 180, self._middle(band)

    def all_cells(self, spark) -> DataFrame:
        """``cell`` of the whole Earth."""
        bands = spark.range(self.bands).select(F.col("id").alias("band"))
        return bands.select(F.explode(F.sequence(F.lit(0), self._columns(F.col("band")) - 1)).alias("column"), "band").select((F.col("band") * F.lit(_SHIFT) + F.col("column")).cast("bigint").alias("cell"))

    def near(self, places: DataFrame, eps_m: float) -> DataFrame:
        """``id, cell, dist`` of every anchor up to *eps_m* metres from each place, without a join."""
        step = math.degrees(eps_m / RADIUS_M) + self.height
        first = F.greatest(F.floor((F.col("lat") - step + 90) / self.height), F.lit(0)).cast("bigint")
        last = F.least(F.floor((F.col("lat") + step + 90) / self.height), F.lit(self.bands - 1)).cast("bigint")
        banded = places.dropna().withColumn("band", F.explode(F.sequence(first, last))).withColumn("c_lat", self._middle(F.col("band"))).withColumn("columns", self._columns(F.col("band")))
        phi, psi = F.radians("lat"), F.radians("c_lat")
        below = F.cos(phi) * F.cos(psi)
        cosine = (F.lit(math.cos(min(eps_m / RADIUS_M, math.pi))) - F.sin(phi) * F.sin(psi)) / F.greatest(below, F.lit(1e-15))
        # half the width of the range of longitudes, a little wider than exact
        half = F.when(cosine <= -1, F.lit(180.0)).when(cosine > F.lit(1 + 1e-9), F.lit(-1.0)).otherwise(F.degrees(F.acos(F.least(cosine, F.lit(1.0)))) + 1e-6)
        width = F.lit(360.0) / F.col("columns")
        at = F.pmod(F.col("lon") + 180, F.lit(360.0))
        low = F.floor((at - half) / width - 0.5).cast("bigint")
        high = F.ceil((at + half) / width).cast("bigint")
        some = F.when(half < 0, F.array().cast("array<bigint>")).when(high - low + 1 >= F.col("columns"), F.sequence(F.lit(0).cast("bigint"), F.col("columns").cast("bigint") - 1)).otherwise(F.transform(F.sequence(low, high), lambda k: F.pmod(k, F.col("columns").cast("bigint"))))
        each = banded.withColumn("column", F.explode(some))
        c_lon = (F.col("column") + F.lit(0.5)) * width - 180
        dist = haversine_m(F.col("lon"), F.col("lat"), c_lon, F.col("c_lat"))
        return each.select("id", (F.col("band") * F.lit(_SHIFT) + F.col("column")).cast("bigint").alias("cell"), dist.alias("dist")).where(F.col("dist") <= F.lit(float(eps_m)))


class HexCells:
    """Hexagons (and twelve pentagons) of a resolution, whose ids are those of the public icosahedral index."""

    def __init__(self, resolution: int):
        if not 0 <= resolution <= hexagons.MOST_RESOLUTION:
            raise ValueError("a resolution is from 0 to 15")
        self.resolution = resolution
        self.radius_m = COVER_M.get(resolution)
        self.count = 2 + 120 * 7**resolution

    def cell_of(self, lon: Column, lat: Column) -> Column:
        """The id of the cell that a point lies in; null for a point without coordinates."""
        resolution = self.resolution

        def cells(lon: pd.Series, lat: pd.Series) -> pd.Series:
            out = pd.Series(pd.NA, index=lon.index, dtype="Int64")
            there = lon.notna() & lat.notna()
            out[there] = hexagons.cells_at(lon[there].to_numpy(float), lat[there].to_numpy(float), resolution)
            return out

        return F.pandas_udf(cells, "long")(lon, lat)

    def centre(self, cell: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a cell's anchor."""

        def points(cell: pd.Series) -> pd.DataFrame:
            lon, lat = hexagons.degrees(hexagons.centres(cell.to_numpy(np.int64)))
            return pd.DataFrame({"lon": lon, "lat": lat})

        point = F.pandas_udf(points, "lon double, lat double")(cell)
        return point["lon"], point["lat"]

    def all_cells(self, spark) -> DataFrame:
        """``cell`` of the whole Earth: base cells and their digits, without what pentagons lack."""
        n = self.resolution
        digits = [F.expr(f"(id div {7 ** (n - r)}) % 7") for r in range(1, n + 1)]
        base = F.expr(f"id div {7**n}")
        leading = F.lit(0)
        for d in reversed(digits):
            leading = F.when(d > 0, d).otherwise(leading)
        cell = F.lit(1 << 59 | n << 52 | ((1 << 3 * (15 - n)) - 1)) + F.shiftleft(base, 45)
        for r, d in enumerate(digits, 1):
            cell = cell + F.shiftleft(d, 45 - 3 * r)
        return spark.range(122 * 7**n).where(~(base.isin(*hexagons.pentagons()) & (leading == 1))).select(cell.alias("cell"))

    def disk(self, cells: DataFrame, k: int) -> DataFrame:
        """``origin, cell``: the cells up to *k* steps from each of *cells* (``cell``), itself included."""
        resolution = self.resolution

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                origin = batch["cell"].to_numpy(np.int64)
                for lo in range(0, len(origin), 1024):
                    who, found = hexagons.disks(origin[lo : lo + 1024], k, resolution)
                    yield pd.DataFrame({"origin": origin[lo + who], "cell": found})

        return cells.select("cell").dropna().mapInPandas(run, "origin long, cell long")

    def boundary(self, cells: DataFrame) -> DataFrame:
        """``cell, n, lon, lat``: the corners of each of *cells* (``cell``), counter-clockwise."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cell = batch["cell"].to_numpy(np.int64)
                corners = hexagons.boundaries(cell)
                size = [len(c) for c in corners]
                lon, lat = hexagons.degrees(np.concatenate(corners)) if size else (np.zeros(0), np.zeros(0))
                yield pd.DataFrame({"cell": np.repeat(cell, size), "n": np.concatenate([np.arange(k) for k in size]) if size else np.zeros(0, int), "lon": lon, "lat": lat})

        return cells.select("cell").dropna().mapInPandas(run, "cell long, n int, lon double, lat double")

    def near(self, places: DataFrame, eps_m: float) -> DataFrame:
        """``id, cell, dist`` of every anchor up to *eps_m* metres from each place, without a join."""
        resolution, angle = self.resolution, min(eps_m / RADIUS_M * (1 + 1e-9) + 1e-12, math.pi)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                v = hexagons.vectors(batch["lon"].to_numpy(), batch["lat"].to_numpy())
                for row, cell, centre in hexagons.around(v, angle, resolution):
                    lon, lat = hexagons.degrees(centre)
                    some = batch.iloc[row]
                    yield pd.DataFrame({"id": some["id"].to_numpy(), "lon": some["lon"].to_numpy(), "lat": some["lat"].to_numpy(), "cell": cell, "c_lon": lon, "c_lat": lat})

        found = places.dropna().select("id", "lon", "lat").mapInPandas(run, "id long, lon double, lat double, cell long, c_lon double, c_lat double")
        dist = haversine_m(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat"))
        return found.select("id", "cell", dist.alias("dist")).where(F.col("dist") <= F.lit(float(eps_m)))


def grid_epsilon(eps_m: float, radius_m: float, mode: str = "under") -> float:
    """The grid's distance for an exact one: half (finds no pair too far apart), or half and the covering radius (misses none)."""
    if mode not in ("under", "over"):
        raise ValueError("mode is 'under' or 'over'")
    return eps_m / 2 + (radius_m if mode == "over" else 0)


def distinct_cells(near: DataFrame, group: str) -> DataFrame:
    """*group* and ``cells``: how many different anchors the places of each group are near to, and (null) those of all."""
    return near.select(group, "cell").distinct().rollup(group).agg(F.countDistinct("cell").alias("cells"))
