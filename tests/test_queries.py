"""Registered queries that must cover their whole input."""

import math

import pytest

from waymesh.operators import quality
from waymesh.plans import queries, session


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """120 suppliers in three nations."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, i % 3) for i in range(1, 121)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    # customers 21 to 60 have an order each, of three suppliers; 20 and below have none
    spark.createDataFrame([(i, i) for i in range(21, 61)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(i, 1 + i * k % 120) for i in range(21, 61) for k in (1, 7, 11)], "l_orderkey bigint, l_suppkey bigint").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_haversine_of_every_place(spark, folder):
    at = {r["id"]: (math.radians(r["lon"]), math.radians(r["lat"])) for r in queries.places(spark, folder).collect()}
    found = {(r["u"], r["v"]): r["dist"] for r in queries.haversine_pairs(spark, folder).collect()}
    assert set(found) == {({0: 3, 1: 1, 2: 2}[v % 3], v) for v in at}
    for (u, v), dist in found.items():
        (x, a), (y, b) = at[u], at[v]
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((y - x) / 2) ** 2
        assert abs(dist - 2 * 6371008.8 * math.asin(math.sqrt(h))) < 1e-3


@pytest.mark.parametrize("small", [False, True])
def test_kernels_compare_as_matrices_do(spark, folder, monkeypatch, small):
    if small:  # several blocks and runs of places
        for name, n in (("QUERIES", 7), ("OBJECTS", 9), ("PLACES", 5)):
            monkeypatch.setattr(quality, name, n)
    left = queries._left(spark, folder)
    every = left.select("i").distinct().withColumnRenamed("i", "query").unionByName(spark.createDataFrame([(9999,)], "query bigint"))
    want = quality.compare_quality(queries._exact(spark, folder), queries._grid(spark, folder), every).first()
    p = queries.places(spark, folder)
    got = quality.compare_kernels(left, queries.spatial.place_kernel(p, queries.EPS_M), queries.spatial.cell_kernel(p, queries.EPS_M / 2, queries.CELLS), every).first()
    assert got.asDict() == pytest.approx(want.asDict(), abs=1e-12)


def test_pieces_are_not_copied_for_each_task(spark, folder, monkeypatch):
    """Several tasks read objects and kernels where they are stored, and the plan makes no copies of them; kernels by columns give the same."""
    monkeypatch.setattr(quality, "QUERIES", 9)
    monkeypatch.setattr(quality, "KEPT", 40)
    got = queries._compared(spark, folder)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroupsInArrow" not in plan and plan.count("MapInArrow") == 1
    every = queries._left(spark, folder).select("i").distinct().withColumnRenamed("i", "query")
    want = quality.compare_quality(queries._exact(spark, folder), queries._grid(spark, folder), every).first()
    assert got.first().asDict() == pytest.approx(want.asDict(), abs=1e-12)


def test_quality_of_every_customer(spark, folder):
    assert queries.quality_precision_recall(spark, folder).first()["queries"] == 40
    overlap, ndcg = queries.quality_overlap(spark, folder).first(), queries.quality_ndcg(spark, folder).first()
    assert list(overlap.asDict()) == [f"overlap_{k}" for k in quality.KS] and list(ndcg.asDict()) == [f"ndcg_{k}" for k in quality.KS]
    # another way to the same: each customer asked alone, then the mean over those with ten results
    exact, near = queries._exact(spark, folder).persist(), queries._grid(spark, folder).persist()
    asked = queries._asked(spark, tuple(range(21, 61)))
    best = {name: {} for name in ("e", "g")}
    for name, m in (("e", exact), ("g", near)):
        for r in quality.rankings(m, asked).collect():
            best[name].setdefault(r["query"], []).append((r["rank"], r["node"]))
    shares = [len({n for k, n in rows if k <= 10} & {n for k, n in best["g"].get(q, []) if k <= 10}) / 10 for q, rows in best["e"].items() if len(rows) >= 10]
    assert shares and abs(overlap["overlap_10"] - sum(shares) / len(shares)) < 1e-6


def test_radius_of_the_cells_in_use(spark, folder):
    r = queries.cell_radius(spark, folder).first()
    bands = [math.cos(math.radians(-90 + (b + 0.5) * queries.CELLS.height)) for b in range(queries.CELLS.bands)]
    assert abs(r["cells"] - sum(max(1, math.ceil(360 * c / queries.CELLS.height)) for c in bands)) <= 2  # rounding at whole numbers
    assert queries.CELLS.radius_m / 2 < r["boundary_m"] <= r["rho_m"] <= queries.CELLS.radius_m


def test_shuffles_are_cut_finely(spark, folder):
    """A shuffle has more parts than the session's few, so that what a task gets doesn't grow with the tables; small ones are put together."""
    found = queries._left(spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"{session.PARTS})" in plan
    assert found.rdd.getNumPartitions() < 8
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(name, 5)
    session.bounded(spark)
    assert spark.conf.get(name) == "5"
    spark.conf.unset(name)
