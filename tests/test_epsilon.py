import math
import random

import pytest

from waymesh.operators import epsilon, grid, spatial
from waymesh.sources.model import COORDINATES

R = 6371008.8


def distance(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    h = min(max(h, 0), 1)
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(1 - h))


AREAS = {
    "globe": (-180, 180, -90, 90, 400, 500_000),
    "antimeridian": (179.7, 180.3, -1, 1, 150, 20_000),
    "city": (13.0, 13.4, 52.3, 52.6, 150, 3_000),
    "north": (-180, 180, 89.3, 90, 150, 20_000),
    "south": (-180, 180, -90, -89.3, 150, 20_000),
    "ring": (-180, 180, 84.9, 85.1, 250, 50_000),
    "pole": (-180, 180, 90, 90, 30, 1_000),
}


def points(area):
    a, b, c, d, n, eps = AREAS[area]
    rng = random.Random(area)
    return [(i, (rng.uniform(a, b) + 180) % 360 - 180, rng.uniform(c, d)) for i in range(n)], eps


@pytest.mark.parametrize("area", AREAS)
def test_pairs_equal_brute_force(spark, area):
    pts, eps = points(area)
    found = [(r["u"], r["v"]) for r in epsilon.within_distance(*[spark.createDataFrame(pts, COORDINATES)] * 2, eps).where("u <= v").collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a[0], b[0]) for a in pts for b in pts if a[0] <= b[0] and distance(a, b) <= eps}


def test_zero_distance_and_errors(spark):
    at = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.0), (3, 5.0, 6.0)], COORDINATES)
    assert {(r["u"], r["v"]) for r in epsilon.epsilon_pairs(at, 0).collect()} == {(1, 1), (1, 2), (2, 2), (3, 3)}
    with pytest.raises(ValueError):
        epsilon.epsilon_pairs(at, -1)


def test_repeated_coordinates(spark):
    at = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.02, 0.0), (2, 0.021, 0.0)], COORDINATES)
    got = {(r["u"], r["v"]): r["dist"] for r in epsilon.epsilon_pairs(at, 5000).collect()}
    assert got[1, 2] == pytest.approx(distance((0, 0.02, 0), (0, 0.021, 0)))  # the least one


@pytest.mark.parametrize("area", ["globe", "antimeridian", "north", "pole"])
def test_lattice_covers(spark, area):
    pts, _ = points(area)
    pts = pts[:40]
    cells = grid.LatticeCells(1.0)
    every = cells.all_cells(spark)
    lon, lat = cells.centre(every["cell"])
    anchors = [(r["cell"], r["lon"], r["lat"]) for r in every.select("cell", lon.alias("lon"), lat.alias("lat")).collect()]
    at = spark.createDataFrame(pts, COORDINATES)
    eps = cells.radius_m
    found = [(r["id"], r["cell"]) for r in cells.near(at, eps).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(p[0], c[0]) for p in pts for c in anchors if distance(p, c) <= eps}
    home = {r["id"]: r["cell"] for r in at.select("id", cells.cell_of(at["lon"], at["lat"]).alias("cell")).collect()}
    assert set(home.items()) <= set(found)  # the own anchor is within the radius


def test_under_and_over(spark):
    pts, _ = points("city")
    at = spark.createDataFrame(pts, COORDINATES)
    cells, eps = grid.LatticeCells(0.01), 2000

    def linked(distance_m):
        c = spatial.cell_columns(at, distance_m, cells).select("j", "cell")
        other = c.withColumnRenamed("j", "k")
        return {(r["j"], r["k"]) for r in c.join(other, "cell").where("j < k").select("j", "k").distinct().collect()}

    exact = {(r["u"], r["v"]) for r in epsilon.epsilon_pairs(at, eps).where("u < v").collect()}
    assert linked(grid.grid_epsilon(eps, cells.radius_m, "under")) <= exact <= linked(grid.grid_epsilon(eps, cells.radius_m, "over"))
    with pytest.raises(ValueError):
        grid.grid_epsilon(eps, cells.radius_m, "sideways")


def test_grid_weights_add(spark):
    at = spark.createDataFrame([(1, 0.005, 0.005), (1, 0.005, 0.005)], COORDINATES)
    assert all(r["w"] == 2 for r in spatial.cell_columns(at, 500, grid.LatticeCells(0.01)).collect())


RECTS = [(0, 0, 0, 2, 2), (2, 5, 5, 7, 7), (3, 8, 5, 9, 6), (5, 7, 1, 9, 2)]
BOXES = "id bigint, min0 double, min1 double, max0 double, max1 double"


def floats(rows):
    return [(r[0], *map(float, r[1:])) for r in rows]


def test_box_search(spark):
    r = spark.createDataFrame(floats(RECTS), BOXES)
    assert sorted(x["id"] for x in epsilon.box_search(r, [6, 4], [10, 6]).collect()) == [2, 3]
    # a box whose sides overflow, or are turned round, touches nothing
    odd = spark.createDataFrame(floats([(1, 1750, 365, -200, 9), (2, 10, 1521, 9, 1532)]), BOXES)
    assert epsilon.box_search(odd, [6, 4], [10, 6]).count() == 0
    huge = spark.createDataFrame([(1, -1e300, -1e300, 1e300, 1e300)], BOXES)
    assert epsilon.box_search(huge, [6, 4], [10, 6]).count() == 1


def test_nearest(spark):
    r = spark.createDataFrame(floats([(0, 0, 0, 2, 1), (1, 5, 5, 7, 7), (2, 8, 5, 9, 6), (3, 7, 1, 9, 2), (4, 4, 5, 5, 6)]), BOXES)
    assert [x["id"] for x in epsilon.nearest(r, [4, 3], [4, 3], 5).collect()] == [4, 1, 0, 3, 2]
    assert epsilon.nearest(r, [4, 3], [4, 3], 2).count() == 2
    with pytest.raises(ValueError):
        epsilon.nearest(r, [4, 3], [4, 3], 0)


def test_removal(spark):
    r = spark.createDataFrame([(i, float(i), float(i), float(i), float(i)) for i in range(100)], BOXES)
    gone = spark.createDataFrame([(i,) for i in range(90, 100)], "id bigint")
    assert sorted(x["id"] for x in epsilon.removed(r, gone).collect()) == list(range(90))
    assert epsilon.removed(r, gone, [0, 0], [94, 94]).count() == 95


def test_high_dimension(spark):
    rng = random.Random(1)
    rows = [(i, *(rng.random() for _ in range(8)), *(1 + rng.random() for _ in range(8))) for i in range(200)]
    names = ["id", *(f"min{k}" for k in range(8)), *(f"max{k}" for k in range(8))]
    assert epsilon.box_search(spark.createDataFrame(rows, names), [0.0] * 8, [2.0] * 8).count() == 200


@pytest.mark.parametrize("area", ["city", "north", "globe"])
def test_dense_cells_equal_brute_force(spark, monkeypatch, area):
    monkeypatch.setattr(epsilon, "DENSE", 6)
    pts, eps = points(area)
    pts += [(1000 + k, *pts[0][1:]) for k in range(60)]  # one place many times
    probes = pts[::3]
    found = [(r["u"], r["v"]) for r in epsilon.within_distance(spark.createDataFrame(probes, COORDINATES), spark.createDataFrame(pts, COORDINATES), eps).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a[0], b[0]) for a in probes for b in pts if distance(a, b) <= eps}


def test_a_dense_city_has_no_large_key(spark, monkeypatch):
    """20,000 places in a cell among 20,000 elsewhere: no key's work is over ten times the median of the city's keys."""
    monkeypatch.setattr(epsilon, "DENSE", 512)
    city = spark.range(20_000).selectExpr("id", "13.4 + 0.00001 * (id % 141) AS lon", "52.5 + 0.00001 * (id div 141) AS lat")
    wide = spark.range(20_000).selectExpr("id + 100000 AS id", "-170 + 0.017 * (id % 20000) AS lon", "-60 + 0.006 * (id * 7919 % 20000) AS lat")
    sides = {}
    dealt = epsilon._dealt

    def seen(p, t):
        sides["p"], sides["t"], sides["keys"] = out = dealt(p, t)
        return out

    monkeypatch.setattr(epsilon, "_dealt", seen)
    epsilon.within_distance(city.unionByName(wide), city.unionByName(wide), 5000)
    a, b = (sides[x].groupBy(*sides["keys"]).count().withColumnRenamed("count", x) for x in "pt")
    work = sorted(r["p"] * r["t"] for r in a.join(b, sides["keys"]).collect())
    tiles = [w for w in work if w > 512]
    assert len(tiles) > 1000 and max(tiles) <= 10 * tiles[len(tiles) // 2] and max(tiles) <= 2 * 512 * 512
