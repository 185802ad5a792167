"""Files along a curve, and nearest boxes of many queries, against plain arithmetic."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh.operators import boxes, epsilon
from waymesh.sources.model import COORDINATES

RECTS = "id bigint, min0 double, min1 double, max0 double, max1 double"


def random_rects(seed, n, span=100.0, size=1.0):
    rng = np.random.default_rng(seed)
    low = rng.uniform(-span, span, (n, 2))
    return np.concatenate([low, low + rng.exponential(size, (n, 2))], 1)


def frame(spark, rects, name="id"):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rects)], RECTS.replace("id", name, 1))


def test_small_boxes_read_few_files(spark, tmp_path):
    rects = random_rects(1, 40_000)
    table = frame(spark, rects)
    kept = boxes.Placed.build(table.unionByName(spark.createDataFrame([(-1, None, 1.0, 2.0, 3.0)], RECTS)), f"{tmp_path}/rects", 100)
    assert kept.bounds.count() > 60 and kept.bounds.agg({"n": "sum"}).first()[0] == 40_000
    for low, high in (((10.0, 10.0), (14.0, 13.0)), ((-60.0, 30.0), (-55.0, 31.0)), ((500.0, 500.0), (501.0, 501.0))):
        found = kept.box_search(low, high)
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in epsilon.box_search(table, list(low), list(high)).collect())
        assert len(kept.files(low, high)) < kept.bounds.count() / 10 and {f.rsplit("/", 1)[1] for f in found.inputFiles()} == {f.rsplit("/", 1)[1] for f in kept.files(low, high)}
    again = boxes.Placed(spark, f"{tmp_path}/rects")
    assert again.box_search((10.0, 10.0), (14.0, 13.0)).count() == kept.box_search((10.0, 10.0), (14.0, 13.0)).count() > 0


def test_places_around_a_point(spark, tmp_path):
    rng = np.random.default_rng(2)
    places = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-180, 180, 20_000), rng.uniform(-90, 90, 20_000), strict=True))], COORDINATES)
    kept = boxes.Placed.build(places, f"{tmp_path}/places", 64)
    for lon, lat, eps in ((10.0, 50.0, 300_000), (179.9, 0.0, 500_000), (0.0, 89.5, 400_000), (20.0, -30.0, 0)):
        want = sorted(map(tuple, epsilon.range_query(places, lon, lat, eps).collect()))
        assert sorted(map(tuple, kept.range_query(lon, lat, eps).collect())) == want
    assert kept.range_query(10.0, 50.0, 300_000).inputFiles() and len(kept.range_query(10.0, 50.0, 300_000).inputFiles()) < kept.bounds.count() / 10


def brute(rects, queries, n):
    out = set()
    for q, (a, b, c, d) in enumerate(queries):
        x = np.maximum(0, np.maximum(a - rects[:, 2], rects[:, 0] - c))
        y = np.maximum(0, np.maximum(b - rects[:, 3], rects[:, 1] - d))
        gap = 0.0 + x * x + y * y
        best = np.lexsort((np.arange(len(rects)), gap))[:n]
        out |= {(q, int(k), float(gap[k])) for k in best}
    return out


def test_nearest_of_many_queries(spark):
    """10,000 query boxes among boxes of all sizes, clustered and alone."""
    rects = np.concatenate([random_rects(3, 3000), random_rects(4, 1500, 2.0, 0.01), random_rects(5, 20, 100.0, 60.0), [[900.0, 900.0, 901.0, 901.0]]])
    queries = np.concatenate([random_rects(6, 9900, 120.0, 0.5), random_rects(7, 99, 300.0, 40.0), [[0.0, 0.0, 0.0, 0.0]]])
    found = boxes.nearest_of_many(frame(spark, rects), frame(spark, queries, "query"), 5)
    rows = [(r["query"], r["id"], r["gap"]) for r in found.collect()]
    assert len(rows) == len(queries) * 5 and set(rows) == brute(rects, queries, 5)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_with_ties_and_few_boxes(spark):
    rects = np.array([[1.0, 0.0, 1.0, 0.0], [-1.0, 0.0, -1.0, 0.0], [0.0, 1.0, 0.0, 1.0], [5.0, 5.0, 5.0, 5.0]])
    queries = np.array([[0.0, 0.0, 0.0, 0.0], [5.0, 5.0, 6.0, 6.0]])
    for n in (1, 2, 9):
        found = boxes.nearest_of_many(frame(spark, rects), frame(spark, queries, "query"), n)
        assert {(r["query"], r["id"], r["gap"]) for r in found.collect()} == brute(rects, queries, n)
    bad = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0), (2, 3.0, 0.0, 1.0, 1.0)], RECTS)
    assert boxes.nearest_of_many(bad, frame(spark, queries, "query"), 2).count() == 0
    assert boxes.nearest_of_many(frame(spark, rects), frame(spark, queries, "query").limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        boxes.nearest_of_many(bad, bad.withColumnRenamed("id", "query"), 0)


@pytest.mark.parametrize("pairs", [1, 1 << 20])
def test_many_boxes_of_a_cell(spark, monkeypatch, pairs):
    """Boxes that all touch each other, with ties by id: what a cell hands on is the best of each query, not all pairs."""
    monkeypatch.setattr(boxes, "PAIRS", pairs)
    found = boxes._nearest_of_cell(3, 9.0)
    asked = pa.table({"query": [1, 2], **{f"q_{s}": [0.0, 5.0 if s.startswith("min") else 6.0] for s in boxes.SIDES}})
    near = pa.table({"id": [9, 4, 7, 5, 8], **{s: [0.0, 0.0, 0.0, 20.0, 2.0] for s in boxes.SIDES}})
    assert sorted(map(tuple, (r.values() for r in found(asked, near).to_pylist()))) == [(1, 4, 0.0), (1, 7, 0.0), (1, 9, 0.0), (2, 4, 50.0), (2, 7, 50.0), (2, 8, 18.0)]
    assert len(found(asked.slice(0, 0), near)) == len(found(asked, near.slice(0, 0))) == 0
    r = spark.range(60).select("id", F.lit(0.0).alias("min0"), F.lit(0.0).alias("min1"), (F.col("id") % 2 + 1.0).alias("max0"), F.lit(1.0).alias("max1"))
    assert sorted(map(tuple, boxes.nearest_of_many(r, r.withColumnRenamed("id", "query"), 2).collect())) == sorted((q, k, 0.0) for q in range(60) for k in (0, 1))
