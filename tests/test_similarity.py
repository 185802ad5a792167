"""Five places on the equator, a kilometre apart: rankings with exact scores."""

import random

import pytest
from pyspark.sql import functions as F

from waymesh.functions.geo import haversine_m
from waymesh.functions.metapath import EdgeType
from waymesh.operators import matrix, similarity, spatial
from waymesh.plans import search
from waymesh.plans.catalog import Catalog
from waymesh.sources.model import COORDINATES, EDGES, NODES, Graph

STEP = 0.00899320363724538
EXPECTED = {
    0: ({0: [(0, 1)], 1: [(1, 1)], 2: [(2, 1)]}, [1, 2, 2]),
    1: ({0: [(0, 1), (1, 2 / 10)], 1: [(1, 1), (0, 2 / 10), (2, 2 / 15)], 2: [(2, 1), (1, 2 / 15)]}, [2, 8, 7]),
    2: ({0: [(0, 1), (1, 4 / 14)], 1: [(1, 1), (2, 6 / 20), (0, 4 / 14)], 2: [(2, 1), (1, 6 / 20)]}, [3, 11, 9]),
    3: ({0: [(0, 1), (1, 4 / 16), (2, 2 / 15)], 1: [(1, 1), (2, 8 / 23), (0, 4 / 16)], 2: [(2, 1), (1, 8 / 23), (0, 2 / 15)]}, [4, 12, 11]),
    4: ({0: [(0, 1), (2, 4 / 17), (1, 4 / 17)], 1: [(1, 1), (2, 8 / 24), (0, 4 / 17)], 2: [(2, 1), (1, 8 / 24), (0, 4 / 17)]}, [5, 12, 12]),
}


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(list(enumerate([0, 0, 0, 1, 1, 1, 1, 1])), NODES)
    edges = spark.createDataFrame([(0, 0, 3), (1, 0, 4), (1, 0, 5), (2, 0, 6), (2, 0, 7)], EDGES)
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, STEP, 0.0), (2, 0.01798640727449076, 0.0), (3, 0.02697961091173614, 0.0), (4, 0.03597281454898152, 0.0)], COORDINATES)
    return Graph(nodes, edges, ["item", "place"], [EdgeType("located_at", "item", "place")], {"place": at})


def test_step_is_a_kilometre(graph):
    d = graph.coordinates["place"].where("id = 1").select(haversine_m(F.lit(0.0), F.lit(0.0), F.col("lon"), F.col("lat"))).first()[0]
    assert abs(d - 1000) < 1e-8


@pytest.mark.parametrize("by_value", [1000, 1, 0])
@pytest.mark.parametrize("km", range(5))
def test_rankings(graph, km, by_value, monkeypatch):
    # queries by value and side by side, by value, or by a join
    monkeypatch.setattr(similarity, "BY_VALUE", 1000 if by_value else 1)
    monkeypatch.setattr(similarity, "SIDE_BY_SIDE", by_value)
    eps = km * 1000 + 1 if km else 0
    left = matrix.compose(graph, "IP", by="initials")
    m = spatial.extend_exact(left, graph.coordinates["place"], eps).persist()
    wanted, deltas = EXPECTED[km]
    assert [r["delta"] for r in matrix.deltas(m).orderBy("i").collect()] == deltas
    queries = graph.nodes.sparkSession.createDataFrame([(q,) for q in wanted], "query bigint")
    found = similarity.top_k_batch(m, queries, 8).orderBy("query", "rank").collect()
    assert {q: [(r["node"], r["score"]) for r in found if r["query"] == q] for q in wanted} == wanted
    kernel = similarity.kernel_top_k(left, spatial.place_kernel(graph.coordinates["place"], eps), queries, 8).orderBy("query", "rank").collect()
    assert kernel == found
    assert [tuple(r) for r in similarity.top_k(m, 0, 8).orderBy("rank").select("node", "score").collect()] == wanted[0]
    m.unpersist()


def test_search_builds_once(spark, graph, tmp_path, monkeypatch):
    built = []
    build = spatial.extend_exact
    monkeypatch.setattr(spatial, "extend_exact", lambda *a: built.append(a) or build(*a))
    wanted = EXPECTED[2][0]
    queries = spark.createDataFrame([(q,) for q in wanted], "query bigint")
    for _ in range(2):  # the second one finds what the first has kept
        s = search.Search(graph, Catalog(spark, str(tmp_path)), "initials")
        found = s.top_k(queries, 8, "IP", "place", 2001).orderBy("query", "rank").collect()
        assert {q: [(r["node"], r["score"]) for r in found if r["query"] == q] for q in wanted} == wanted
    assert len(built) == 1
    plan = s.top_k(queries, 8, "IP", "place", 2001)._jdf.queryExecution().toString()
    assert "Haversine" not in plan and "ATAN2" not in plan.upper()
    changed = Graph(graph.nodes, graph.edges.unionByName(graph.edges.limit(1)), graph.node_types, graph.edge_types, graph.coordinates)
    search.Search(changed, Catalog(spark, str(tmp_path)), "initials").matrix("IP", "place", 2001)
    assert len(built) == 2
    over = s.top_k(queries, 8, "IP", "place", 2001, mode="over", resolution=9).where("query = 0").collect()
    assert {n for n, _ in wanted[0]} <= {r["node"] for r in over}
    with pytest.raises(ValueError):
        s.matrix("IP", "place", 2001, mode="under")


def test_ties_and_limits(spark, graph):
    m = spark.createDataFrame([(1, 9, 2), (5, 9, 2), (7, 8, 1)], "i bigint, j bigint, v bigint")
    assert [tuple(r) for r in similarity.top_k(m, 1, 1).collect()] == [(5, 1.0, 1)]  # the larger id goes first
    assert similarity.top_k(m, 99, 3).collect() == []
    with pytest.raises(ValueError):
        similarity.top_k(m, 1, 0)
    found = similarity.ranked(similarity.scores(m, spark.createDataFrame([(1,)], "query bigint")))
    assert similarity.rank_position(found, 1, 7).first()["rank"] == -1
    assert {r["i"] for r in similarity.candidates(m, 1).collect()} == {1, 5}


def test_weights(spark):
    left = spark.createDataFrame([(0, 0, 1), (1, 1, 1)], "i bigint, j bigint, v bigint")
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, STEP, 0.0)], COORDINATES)
    d = at.where("id = 1").select(haversine_m(F.lit(0.0), F.lit(0.0), F.col("lon"), F.col("lat"))).first()[0]
    # a pair at the very distance has weight 0 and drops out; unweighted it stays
    assert spatial.pair_columns(at, d, True).where("u <> v").count() == 0
    assert spatial.pair_columns(at, d, False).where("u <> v").count() == 2
    w = spatial.pair_columns(at, 2000, True).where("u <> v").select("w").collect()
    assert abs(w[0]["w"] * w[1]["w"] - (1 - d / 2000)) < 1e-12
    s = similarity.scores(spatial.extend_exact(left, at, 2000, True), spark.createDataFrame([(0,)], "query bigint")).where("node = 1").first()
    half = 1 - d / 2000
    assert abs(s["score"] - 2 * half / (2 * (1 + half))) < 1e-12


def test_places_without_coordinates(spark):
    left = spark.createDataFrame([(0, 0, 1), (1, 7, 1)], "i bigint, j bigint, v bigint")
    at = spark.createDataFrame([(0, 0.0, 0.0)], COORDINATES)
    assert [r["i"] for r in spatial.extend_exact(left, at, 10).collect()] == [0]


def test_overflow_raises(spark):
    m = spark.createDataFrame([(0, 0, 2**62), (0, 1, 2**62)], "i bigint, j bigint, v bigint")
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        matrix.deltas(m).collect()


def test_pair_report(spark):
    m = spark.createDataFrame([(1, 9, 2), (5, 9, 1), (5, 8, 1)], "i bigint, j bigint, v bigint")
    got = {r["measure"]: r["value"] for r in similarity.pair_report(m, m, 1, 5, 5).collect()}
    assert (got["plain_dot"], got["plain_delta_a"], got["plain_delta_b"], got["plain_score"], got["plain_rank"]) == (2, 4, 2, 4 / 6, 2)
    none = {r["measure"]: r["value"] for r in similarity.pair_report(m, m, 77, 78, 5).collect()}
    assert none["plain_score"] == 0 and none["plain_rank"] == -1


def test_best_of_all_rows(spark):
    """Every row asked by bounds gives what asking each row gives; ties and rows of few results among them."""
    import random

    rng = random.Random(4)
    rows = [(i, rng.randrange(40), rng.choice([1, 1, 2, 5, 40, 900])) for i in range(120) for _ in range(rng.choice([1, 3, 9]))]
    rows += [(200, 1000, 3), (201, 1000, 3), (202, 1000, 3000), (203, 2000, 7)]
    m = spark.createDataFrame(rows, "i bigint, j bigint, v bigint").groupBy("i", "j").sum("v").toDF("i", "j", "v")
    asked = m.select(F.col("i").alias("query")).distinct()
    for k in (1, 3, 50):
        want = sorted(map(tuple, similarity.top_k_batch(m, asked, k).collect()))
        assert sorted(map(tuple, similarity.top_k_all(m, k).collect())) == want
    assert similarity.top_k_all(m.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        similarity.top_k_all(m, 0)


def test_chains_are_multiplied_in_the_cheapest_order(spark, monkeypatch):
    """A hub makes the left product huge; from the right it has a few terms. The rows are the same."""
    to_hub = spark.range(2000).selectExpr("id AS i", "0L AS j", "1L AS v")
    from_hub = spark.range(2000).selectExpr("0L AS i", "id AS j", "1L AS v")
    narrow = spark.range(2000).selectExpr("id AS i", "id % 7 AS j", "2L AS v")
    last = spark.range(7).selectExpr("id AS i", "id % 2 AS j", "1L AS v")
    four = [to_hub, from_hub, narrow, last]
    order = matrix.chain_order(four)
    assert order == (0, (1, (2, 3))) or order == (0, ((1, 2), 3))
    left = matrix.product(matrix.product(matrix.product(to_hub, from_hub), narrow), last)
    assert sorted(map(tuple, matrix.chain(four).collect())) == sorted(map(tuple, left.collect()))
    # and the other way round
    turned = [matrix.transpose(m) for m in reversed(four)]
    order = matrix.chain_order(turned)
    assert order == (((0, 1), 2), 3) or order == ((0, (1, 2)), 3)
    assert matrix.chain([narrow]).count() == 2000 and matrix.chain([to_hub, from_hub.limit(0), narrow]).count() == 0


def test_second_search_reads_no_input(spark, tmp_path):
    """Files that are as they were aren't read again; new ones with the same rows are read, and what was built is found."""
    import os
    import shutil

    d = str(tmp_path)
    spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], NODES).coalesce(1).write.parquet(f"{d}/nodes")
    spark.createDataFrame([(0, 0, 2), (1, 0, 3), (1, 0, 2)], EDGES).coalesce(1).write.parquet(f"{d}/edges")
    spark.createDataFrame([(0, 0.0, 0.0), (1, STEP, 0.0)], COORDINATES).coalesce(1).write.parquet(f"{d}/at")

    def graph(folder):
        return Graph(spark.read.schema(NODES).parquet(f"{folder}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/edges"), ["item", "place"], [EdgeType("located_at", "item", "place")], {"place": spark.read.schema(COORDINATES).parquet(f"{folder}/at")})

    one = spark.createDataFrame([(0,)], "query bigint")
    first = search.Search(graph(d), Catalog(spark, f"{d}/kept")).top_k(one, 5, "located_at", "place", 1001).collect()
    assert {r["node"] for r in first} == {0, 1}
    shutil.copytree(f"{d}/nodes", f"{d}/copy/nodes")
    shutil.copytree(f"{d}/edges", f"{d}/copy/edges")
    shutil.copytree(f"{d}/at", f"{d}/copy/at")
    for folder in ("nodes", "edges", "at"):  # no longer readable, but as long and as old as before
        for name in os.listdir(f"{d}/{folder}"):
            path = f"{d}/{folder}/{name}"
            t, n = os.stat(path), os.path.getsize(path)
            with open(path, "wb") as f:
                f.write(b"x" * n)
            os.utime(path, ns=(t.st_atime_ns, t.st_mtime_ns))
    assert search.Search(graph(d), Catalog(spark, f"{d}/kept")).top_k(one, 5, "located_at", "place", 1001).collect() == first
    kept = set(os.listdir(f"{d}/kept"))
    assert search.Search(graph(f"{d}/copy"), Catalog(spark, f"{d}/kept")).top_k(one, 5, "located_at", "place", 1001).collect() == first
    assert set(os.listdir(f"{d}/kept")) == kept


def test_search_over_hexagons(spark, graph, tmp_path):
    queries = spark.createDataFrame([(0,), (1,), (2,)], "query bigint")
    s = search.Search(graph, Catalog(spark, str(tmp_path)), "initials", grid="hexagons")
    over = s.top_k(queries, 8, "IP", "place", 2001, mode="over", resolution=9).collect()
    exact = s.top_k(queries, 8, "IP", "place", 2001).collect()
    assert {(r["query"], r["node"]) for r in exact} <= {(r["query"], r["node"]) for r in over}
    with pytest.raises(ValueError):
        s.matrix("IP", "place", 2001, mode="over", resolution=3)
    with pytest.raises(ValueError):
        search.Search(graph, Catalog(spark, str(tmp_path)), grid="squares")


@pytest.mark.parametrize("low", [1, -2])
def test_top_k_of_all_by_blocks(spark, monkeypatch, low):
    """Several blocks, of which some share no column, values of both signs and columns that aren't numbers; no table has a row for a pair."""
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "TOGETHER", 3)
    r = random.Random(low)
    rows = {(i + 100 * half, r.randrange(12) + 50 * half): r.randrange(low, 4) for half in range(2) for i in range(30) for _ in range(5)}
    m = spark.createDataFrame([(i, j, v) for (i, j), v in rows.items()], "i bigint, j bigint, v bigint")
    every = m.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("d")).where("d > 0").select(F.col("i").alias("query"))
    want = sorted(map(tuple, similarity.top_k_batch(m.join(every.withColumnRenamed("query", "i"), "i"), every, 4).collect()))
    assert sorted(map(tuple, similarity.top_k_all(m, 4).collect())) == want
    wide = m.select("i", F.struct(F.col("j").alias("u"), F.lit("x").alias("v")).alias("c"), F.col("v").alias("m"))
    found = similarity.top_k_all(wide, 4)
    assert sorted(map(tuple, found.collect())) == want
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("high", [2, 60, 500])
def test_rows_side_by_side(spark, monkeypatch, high):
    """Positive whole values, small and large ones, are added up for several queries at once, some rows at a time, with what asking each row gives."""
    for name, n in (("BLOCK", 90), ("TOGETHER", 5), ("BESIDE", 4)):
        monkeypatch.setattr(similarity, name, n)
    r = random.Random(high)
    rows = {(i, r.randrange(9)): r.randint(1, high) for i in range(50) for _ in range(6)}
    m = spark.createDataFrame([(i, j, v) for (i, j), v in rows.items()], "i bigint, j bigint, v bigint")
    used = []
    table = similarity.pa.table({x: similarity.pa.array([k[n] if n < 2 else v for k, v in rows.items()], t) for n, (x, t) in enumerate((("i", similarity.pa.int64()), ("c", similarity.pa.int64()), ("m", similarity.pa.float64())))})
    block = similarity._packed_rows(table, True).append_column("block", similarity.pa.array([0], similarity.pa.int32()))
    take = similarity.np.take
    monkeypatch.setattr(similarity.np, "take", lambda a, *more, **kw: used.append(a.dtype.name) or take(a, *more, **kw))
    similarity._best_of_blocks(3)((similarity.pa.scalar(0),), block)
    assert set(used) == {"uint16" if high < 500 else "float32"}
    monkeypatch.setattr(similarity.np, "take", take)
    want = sorted(map(tuple, similarity.top_k_batch(m, m.select(F.col("i").alias("query")).distinct(), 3).collect()))
    assert sorted(map(tuple, similarity.top_k_all(m, 3).collect())) == want
