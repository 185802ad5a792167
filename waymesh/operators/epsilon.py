"""Places within a distance of each other, and searches among boxes.

The join within a distance runs on cells of latitude bands, each cut into columns as wide as the
distance needs there; one side looks into three columns of three bands.  It finds every pair once,
across the antimeridian and around the poles.  Cells are counted first: those of many places are dealt to
tiles, shares of one side by shares of the other, so that no key has a whole city.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import RADIUS_M, box_gap_squared, haversine_m
from waymesh.sources.shared import written

_WIDER = 1 + 1e-9
#: Places of a cell, of either side, that are one key; more are dealt to several.
DENSE = 4096
#: Probes of a task, about.
PROBES = 1024


def _columns_of_band(band: Column, step: float, eps_m: float) -> Column:
    """Columns in a latitude band: wide enough for the distance at the band's and its neighbours' highest latitude."""
    top = F.greatest(F.abs((band - 1) * F.lit(step)), F.abs((band + 2) * F.lit(step)))
    sine = math.sin(min(eps_m / RADIUS_M, math.pi / 2))
    width = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(sine) / F.greatest(F.cos(F.radians(F.least(top, F.lit(89.999999)))), F.lit(1e-12))))) * F.lit(_WIDER)
    return F.when(top + F.lit(step) >= 90, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / width).cast("int")))


def _column(lon: Column, columns: Column) -> Column:
    at = F.floor(F.pmod(lon + F.lit(180.0), F.lit(360.0)) / F.lit(360.0) * columns).cast("int")
    return F.least(at, columns - 1)


def within_distance(probes: DataFrame, targets: DataFrame, eps_m: float) -> DataFrame:
    """All rows of *probes* (``id, lon, lat``) with those of *targets* up to *eps_m* metres away: ``u, v, dist``."""
    if eps_m < 0:
        raise ValueError("a distance can't be negative")
    p = probes.select(F.col("id").alias("u"), F.col("lon").alias("u_lon"), F.col("lat").alias("u_lat")).dropna()
    t = targets.select(F.col("id").alias("v"), F.col("lon").alias("v_lon"), F.col("lat").alias("v_lat")).dropna()
    near = haversine_m(F.col("u_lon"), F.col("u_lat"), F.col("v_lon"), F.col("v_lat"))
    if eps_m == 0:
        joined = p.join(t, (p["u_lon"] == t["v_lon"]) & (p["u_lat"] == t["v_lat"]))
        return joined.select("u", "v", near.alias("dist")).where("dist <= 0")
    step = math.degrees(eps_m / RADIUS_M) * _WIDER
    band = F.floor(F.col("v_lat") / step).cast("int")
    t = t.withColumn("band", band).withColumn("cell", _column(F.col("v_lon"), _columns_of_band(F.col("band"), step, eps_m)))
    here = F.floor(F.col("u_lat") / step).cast("int")
    p = p.withColumn("band", F.explode(F.array(here - 1, here, here + 1))).withColumn("columns", _columns_of_band(F.col("band"), step, eps_m))
    mid = _column(F.col("u_lon"), F.col("columns"))
    p = p.withColumn("cell", F.explode(F.array_distinct(F.array(*(F.pmod(mid + k, F.col("columns")) for k in (-1, 0, 1))))))
    p, t, keys = _dealt(p.drop("columns"), t)
    # few places may have many pairs: a table that fits one task is dealt to several
    parts = min(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), probes.count() // PROBES)
    if parts > 1:
        p = p.repartition(parts, *keys, "u")
    return p.join(t, keys).select("u", "v", near.alias("dist")).where(F.col("dist") <= F.lit(float(eps_m)))


def _dealt(p: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns that they meet on: cells, and in dense cells tiles."""
    cell = ["band", "cell"]
    counts = [x.groupBy(*cell).agg(F.count("*").alias(n)).where(F.col(n) > DENSE) for x, n in ((p, "n_p"), (t, "n_t"))]
    share = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(1)) / DENSE).cast("int").alias(n)
    dense = written(counts[0].join(counts[1], cell, "full_outer").select(*cell, share("n_p"), share("n_t")))
    if dense.isEmpty():
        return p, t, cell
    # each side's rows have a share of their own side and are copied to all shares of the other
    out = []
    for x, own, other, ids in ((p, "n_p", "n_t", ("u", "u_lon", "u_lat")), (t, "n_t", "n_p", ("v", "v_lon", "v_lat"))):
        mine = F.pmod(F.xxhash64(*ids), F.coalesce(F.col(own), F.lit(1)).cast("bigint")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        out.append(x.join(dense, cell, "left").withColumns({f"of_{own}": mine}).withColumn(f"of_{other}", copies).drop("n_p", "n_t"))
    return out[0], out[1], [*cell, "of_n_p", "of_n_t"]


def nearest_pairs(probes: DataFrame, targets: DataFrame, eps_m: float) -> DataFrame:
    """:func:`within_distance` with each pair of ids once, by its least distance.

    Only pairs of an id with several coordinates are grouped; of all others there is one row anyway, so that no
    task holds pairs.
    """
    several = [x.select("id", "lon", "lat").dropna().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id") for x in (probes, targets)]
    many = written(several[0].unionByName(several[1]).distinct())
    if many.isEmpty():
        return within_distance(probes, targets, eps_m)
    one = [x.join(many, "id", "left_anti") for x in (probes, targets)]
    some = [x.join(many, "id", "left_semi") for x in (probes, targets)]
    rest = within_distance(some[0], targets, eps_m).unionByName(within_distance(one[0], some[1], eps_m))
    return within_distance(*one, eps_m).unionByName(rest.groupBy("u", "v").agg(F.min("dist").alias("dist")))


def epsilon_pairs(coordinates: DataFrame, eps_m: float) -> DataFrame:
    """``u, v, dist`` with ``u <= v``: unordered pairs of places up to *eps_m* metres apart, each place with itself too.

    A place with several coordinates counts with its least distances.
    """
    return nearest_pairs(coordinates, coordinates, eps_m).where("u <= v")


def range_query(coordinates: DataFrame, lon: float, lat: float, eps_m: float) -> DataFrame:
    """``id, dist`` of places up to *eps_m* metres from a point: the latitudes are pushed down to the scan."""
    if eps_m < 0:
        raise ValueError("a distance can't be negative")
    step = math.degrees(eps_m / RADIUS_M) * _WIDER
    some = coordinates.where(F.col("lat").between(lat - step - 1e-9, lat + step + 1e-9))
    return some.select("id", haversine_m(F.lit(float(lon)), F.lit(float(lat)), F.col("lon"), F.col("lat")).alias("dist")).where(F.col("dist") <= F.lit(float(eps_m)))


def _sides(rects: DataFrame) -> tuple[list[Column], list[Column]]:
    """Columns ``min0, min1, ...`` and ``max0, max1, ...``."""
    n = sum(c.startswith("min") for c in rects.columns)
    return [F.col(f"min{k}") for k in range(n)], [F.col(f"max{k}") for k in range(n)]


def box_search(rects: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Rectangles that a closed box touches; a rectangle with a side below 0 touches nothing."""
    a, b = _sides(rects)
    hit = F.lit(True)
    for x, y, lo, hi in zip(a, b, low, high, strict=True):
        hit = hit & (x <= y) & (x <= F.lit(float(hi))) & (y >= F.lit(float(lo)))
    return rects.where(hit)


def nearest(rects: DataFrame, low: list[float], high: list[float], n: int) -> DataFrame:
    """The *n* rectangles with the least squared planar distance to a box, ties by id: ``id, gap``."""
    if n < 1:
        raise ValueError("n is at least 1")
    a, b = _sides(rects)
    return rects.select("id", box_gap_squared(a, b, low, high).alias("gap")).orderBy("gap", "id").limit(n)


def removed(rects: DataFrame, ids: DataFrame, low: list[float] | None = None, high: list[float] | None = None) -> DataFrame:
    """*rects* without those whose id is in *ids*; with a box, only those that touch it go."""
    gone = rects if low is None or high is None else box_search(rects, low, high)
    gone = gone.join(ids.select("id"), "id", "left_semi")
    keys = rects.columns
    return rects.join(gone.select(*(F.col(k).alias(f"gone_{k}") for k in keys)), [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in keys], "left_anti")
