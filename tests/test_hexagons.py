"""The hexagonal grid against published ids, the sphere's area and plain geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.functions import hexagons
from waymesh.functions.geo import RADIUS_M
from waymesh.operators import cell_radius, grid

#: Published ids of points (latitude, longitude).
POINTS = [
    (37.769377, -122.388903, 9, "89283082e73ffff"),
    (37.3615593, -122.0553238, 7, "87283472bffffff"),
    (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
    (math.degrees(0.659966917655), math.degrees(-2.1364398519396), 9, "89283080dcbffff"),
]
#: Published base cells of the twelve pentagons.
PENTAGONS = ["8009fffffffffff", "801dfffffffffff", "8031fffffffffff", "804dfffffffffff", "8063fffffffffff", "8075fffffffffff", "807ffffffffffff", "8091fffffffffff", "80a7fffffffffff", "80c3fffffffffff", "80d7fffffffffff", "80ebfffffffffff"]


@pytest.fixture(scope="module")
def whole(spark):
    """All cells of resolutions 0 to 3."""
    return {r: np.array([x["cell"] for x in grid.HexCells(r).all_cells(spark).collect()], np.int64) for r in range(4)}


def test_published_ids(spark):
    for lat, lon, r, want in POINTS:
        cells = grid.HexCells(r)
        found = spark.createDataFrame([(lon, lat), (None, lat)], "lon double, lat double").select(cells.cell_of(F.col("lon"), F.col("lat")).alias("cell"))
        assert [None if x["cell"] is None else f"{x['cell']:x}" for x in found.collect()] == [want, None]
    cells = grid.HexCells(7)
    one = spark.createDataFrame([(0x87283472BFFFFFF,)], "cell long")
    lon, lat = cells.centre(F.col("cell"))
    assert one.select(lat, lon).first() == pytest.approx((37.35171820183272, -122.05032565263946), abs=1e-11)
    ring = {f"{r['cell']:x}" for r in cells.disk(one, 1).collect()}
    assert ring == {"87283472bffffff", "87283472affffff", "87283470cffffff", "87283470dffffff", "872834776ffffff", "872834729ffffff", "872834728ffffff"}
    corners = [(r["lat"], r["lon"]) for r in cells.boundary(one).orderBy("n").collect()]
    assert len(corners) == 6 and corners[0] == pytest.approx((37.341099093235684, -122.04156135164334), abs=1e-11)
    # the ring around the fourth point
    nine = grid.HexCells(9)
    ring = {f"{r['cell']:x}" for r in nine.disk(spark.createDataFrame([(0x89283080DCBFFFF,)], "cell long"), 1).collect()}
    assert ring == {"89283080dcbffff", "89283080ddbffff", "89283080c37ffff", "89283080c27ffff", "89283080d53ffff", "89283080dcfffff", "89283080dc3ffff"}


def test_pentagons(whole):
    five = whole[0][hexagons.is_pentagon(whole[0])]
    assert [f"{c:x}" for c in np.sort(five)] == PENTAGONS
    for r in range(1, 10):
        lon, lat = hexagons.degrees(hexagons.centres(five))
        inner = hexagons.cells_at(lon, lat, r)
        assert hexagons.is_pentagon(inner).all() and ((inner >> 45 & 127) == (five >> 45 & 127)).all()
        who, beside = hexagons.neighbours(inner, r)
        assert (np.bincount(who) == 5).all() and not hexagons.is_pentagon(beside).any()
        assert {len(b) for b in hexagons.boundaries(inner)} == {10 if r % 2 else 5}


def test_every_cell_is_told_by_its_centre(whole):
    for r, cells in whole.items():
        assert len(cells) == len(np.unique(cells)) == 2 + 120 * 7**r
        v = hexagons.centres(cells)
        assert (hexagons.cells_at(*hexagons.degrees(v), r) == cells).all()
        who, beside = hexagons.neighbours(cells, r)
        pairs = set(zip(cells[who].tolist(), beside.tolist(), strict=True))
        assert set(beside.tolist()) == set(cells.tolist()) and all((b, a) in pairs for a, b in pairs)
        assert np.bincount(np.bincount(who)).tolist()[5:] == [12, len(cells) - 12]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 3))
    for r in (5, 6, 7, 8, 9, 15):
        cells = hexagons.cells_at(*hexagons.degrees(x / np.linalg.norm(x, axis=1)[:, None]), r)
        assert (hexagons.cells_at(*hexagons.degrees(hexagons.centres(cells)), r) == cells).all()


def test_boundaries_cover_the_sphere(whole):
    for r in range(3):
        total = 0.0
        for c, ring in zip(hexagons.centres(whole[r]), hexagons.boundaries(whole[r]), strict=True):
            x, y = ring, np.roll(ring, -1, axis=0)
            total += (2 * np.arctan2(np.cross(x, y) @ c, 1 + x @ c + y @ c + (x * y).sum(1))).sum()
        assert abs(total - 4 * math.pi) < 1e-8


@pytest.mark.parametrize(("r", "angle"), [(0, 0.5), (1, 0.3), (2, 0.2), (3, 0.05), (2, 2.5)])
def test_cells_around_points(whole, r, angle):
    v = np.random.default_rng(2).normal(size=(40, 3))
    v = np.concatenate([v / np.linalg.norm(v, axis=1)[:, None], hexagons.centres(whole[0][::8])])  # corners among them
    centres = hexagons.centres(whole[r])
    want = {(i, int(c)) for i in range(len(v)) for c in whole[r][np.arccos(np.clip(centres @ v[i], -1, 1)) <= angle]}
    got = [(int(i), int(c)) for rows, cells, _ in hexagons.around(v, angle, r) for i, c in zip(rows, cells, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_disks_are_rings_of_rings(spark, whole):
    cells = grid.HexCells(2)
    some = [int(c) for c in whole[2][::700]] + [int(c) for c in whole[2][hexagons.is_pentagon(whole[2])][:2]]
    who, beside = hexagons.neighbours(whole[2], 2)
    near = {}
    for a, b in zip(whole[2][who].tolist(), beside.tolist(), strict=True):
        near.setdefault(a, set()).add(b)
    got = {}
    for r in cells.disk(spark.createDataFrame([(c,) for c in some], "cell long"), 3).collect():
        got.setdefault(r["origin"], []).append(r["cell"])
    for c in some:
        want = {c}
        for _ in range(3):
            want |= {b for a in want for b in near[a]}
        assert len(got[c]) == len(want) and set(got[c]) == want


def test_near_places(spark):
    places = spark.createDataFrame([(1, 10.0, 50.0), (2, None, 1.0), (3, 179.999, -12.0), (4, 0.0, 90.0), (4, 0.0, 90.0)], "id bigint, lon double, lat double")
    cells = grid.HexCells(7)
    found = cells.near(places, 4000.0).collect()
    assert {r["id"] for r in found} == {1, 3, 4} and all(r["dist"] <= 4000 for r in found)
    lone = {r["cell"] for r in found if r["id"] == 3}
    home = hexagons.cells_at(np.array([179.999]), np.array([-12.0]), 7)
    ring = hexagons.disks(home, 5, 7)[1]
    far = np.arccos(np.clip(hexagons.centres(ring) @ hexagons.vectors(np.array(179.999), np.array(-12.0)), -1, 1)) * RADIUS_M
    assert lone == set(ring[far <= 4000].tolist())
    assert cells.near(places.limit(0), 4000.0).count() == 0


def test_covering_radius(spark):
    """No boundary is farther from its anchor than the published radius, and the farthest are nearly as far."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    corners = hexagons.to_sphere(np.arange(20), np.full(20, 0.0j))
    lon, lat = hexagons.degrees(np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], corners]))
    for r in (5, 7, 9):
        cells = spark.createDataFrame([(int(c),) for c in hexagons.cells_at(lon, lat, r)], "cell long")
        found = cell_radius.hex_radius(cells).first()
        assert found["vertex_m"] <= found["boundary_m"] + 1e-6 and 0.97 * grid.COVER_M[r] < found["rho_m"] <= grid.COVER_M[r]


def test_wrong_arguments():
    with pytest.raises(ValueError):
        grid.HexCells(16)
    with pytest.raises(ValueError):
        hexagons.disks(np.array([0x87283472BFFFFFF]), -1, 7)
