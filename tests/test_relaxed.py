"""What relaxed matrices give without being formed, against the matrices themselves."""

import random

import pytest
from pyspark.sql import functions as F

from waymesh.operators import epsilon, grid, matrix, relaxed, similarity, spatial
from waymesh.plans import queries


@pytest.fixture(scope="module")
def tables(spark):
    """Rows of several places in two towns; places 3 and 4 have a second coordinate, and one twice the same."""
    r = random.Random(3)
    at = [(j, r.choice((0.0, 179.99)) + r.random() * 0.05, 60 + r.random() * 0.05) for j in range(40)]
    at += [(3, 0.01, 60.01), (4, 0.02, 60.02), (4, 0.02, 60.02)]
    left = {(r.randrange(25), r.randrange(42)): r.randrange(1, 4) for _ in range(300)}
    return spark.createDataFrame([(i, j, v) for (i, j), v in left.items()], "i bigint, j bigint, v bigint").persist(), spark.createDataFrame(at, "id bigint, lon double, lat double").persist()


def close(rows):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, rows))]


def sums(m):
    return m.groupBy("i").agg(F.count("*").alias("entries"), F.sum("m").alias("total"), F.sum(F.col("m") * F.col("m")).alias("delta"))


@pytest.mark.parametrize("weighted", [False, True])
def test_rows_of_relaxed_matrices(tables, weighted, monkeypatch):
    monkeypatch.setattr(relaxed, "ENTRIES", 100)
    monkeypatch.setattr(relaxed, "PAIRS", 7)
    left, places = tables
    cells = grid.LatticeCells(0.01)
    for eps in (0, 2000):
        assert close(relaxed.exact_rows(left, places, eps, weighted).collect()) == close(sums(spatial.extend_exact(left, places, eps, weighted)).collect())
        assert close(relaxed.grid_rows(left, places, eps, cells, weighted).collect()) == close(sums(spatial.extend_grid(left, places, eps, cells, weighted)).collect())


@pytest.mark.parametrize("weighted", [False, True])
def test_top_k_without_the_matrix(spark, tables, weighted):
    left, places = tables
    queries = spark.createDataFrame([(1,), (2,), (17,)], "query bigint")
    cells = grid.LatticeCells(0.01)
    want = similarity.top_k_batch(spatial.extend_exact(left, places, 2000, weighted), queries, 100)
    assert close(relaxed.exact_top_k(left, places, 2000, queries, 100, weighted).select("query", "node", "score").collect()) == close(want.select("query", "node", "score").collect())
    want = similarity.top_k_batch(spatial.extend_grid(left, places, 2000, cells, weighted), queries, 100)
    assert close(relaxed.grid_top_k(left, places, 2000, cells, queries, 100, weighted).select("query", "node", "score").collect()) == close(want.select("query", "node", "score").collect())


def test_through_places(spark, tables):
    left, places = tables
    right = spark.createDataFrame([(j, j % 3, 1 + j % 2) for j in range(42)], "i bigint, j bigint, v bigint")
    want = spatial.through(spatial.extend_exact(left, places, 2000), spatial.pair_columns(places, 2000), right)
    assert close(relaxed.exact_through(left, places, 2000, right).collect()) == close(want.collect())


def test_lines_are_shuffled_once_a_key(spark, tables, tmp_path):
    """Lines go to their orders, and then to their suppliers or ends: they aren't counted before, and a path is only added up at its end."""
    d = str(tmp_path)
    spark.createDataFrame([(i, i % 3) for i in range(1, 121)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(i, i % 40) for i in range(80)] + [(5, None), (None, 5)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(i, 1 + i * k % 120) for i in range(80) for k in (1, 7, 7)] + [(7, None), (None, 7)], "l_orderkey bigint, l_suppkey bigint").write.parquet(f"{d}/lineitem.parquet")
    left = queries._left(spark, d)
    assert sorted(left.collect()) == sorted(queries._path(spark, d, "placed#supplied_by").collect())
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    right = queries._t(spark, d, "supplier").selectExpr("s_suppkey i", "cast(s_nationkey as bigint) j", "cast(1 as bigint) v")
    found = queries.exact_through(spark, d)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert close(found.collect()) == close(relaxed.exact_through(left, queries.places(spark, d), queries.EPS_M, right).collect())
    assert close(relaxed.exact_through(left.unionByName(left), queries.places(spark, d), queries.EPS_M, right).collect()) == close((i, j, 2 * v) for i, j, v in found.collect())


def test_pairs_are_not_grouped(tables):
    """Only ids of several coordinates are grouped: without these a plan has no aggregate above the join."""
    _, places = tables
    single = places.where("id NOT IN (3, 4)")
    assert "Aggregate" not in epsilon.epsilon_pairs(single, 900)._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.u, r.v): r.dist for r in epsilon.epsilon_pairs(places, 3000).collect()}
    plain = epsilon.within_distance(places, places, 3000).where("u <= v").groupBy("u", "v").agg(F.min("dist").alias("dist"))
    assert got == {(r.u, r.v): r.dist for r in plain.collect()}


def test_overflow_is_an_error(spark):
    left = spark.createDataFrame([(1, 1, 1 << 31), (1, 2, 1 << 31)], "i bigint, j bigint, v bigint")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "id bigint, lon double, lat double")
    with pytest.raises(Exception, match="beyond 64 bits"):
        relaxed.exact_rows(left, places, 10).collect()
    assert matrix.deltas(left.where("j < 0")).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_few_queries_take_one_pass(spark, tables, weighted, monkeypatch):
    """Rows' deltas and dot products with a few queries come from one pass; many queries go through the kernel, with the same result."""
    left, places = tables
    queries = spark.createDataFrame([(1,), (2,), (17,), (999,), (None,)], "query bigint")
    cells = grid.LatticeCells(0.01)
    asked = lambda: [close(f.select("query", "node", "score", "rank").collect()) for f in (relaxed.exact_top_k(left, places, 2000, queries, 4, weighted), relaxed.grid_top_k(left, places, 2000, cells, queries, 4, weighted))]
    with monkeypatch.context() as m:
        m.setattr(similarity, "SIDE_BY_SIDE", 1)
        many = asked()
    monkeypatch.setattr(similarity, "kernel_top_k", None)
    assert asked() == many and all(len(x) == 12 for x in many)


def test_rows_count_their_own_entries(spark, tables, monkeypatch):
    """The pass over rows counts what they have in *left* too, also where no place of a row has coordinates."""
    left, places = tables
    more = left.unionByName(spark.createDataFrame([(77, 900, 1), (77, 901, 2), (3, 900, 1)], "i bigint, j bigint, v bigint"))
    got = relaxed.exact_rows(more, places, 2000, direct=True)
    assert close(got.where("entries > 0").drop("direct").collect()) == close(relaxed.exact_rows(left, places, 2000).collect())
    assert close(got.select("i", "direct").collect()) == close(more.groupBy("i").count().collect())
    assert [tuple(r) for r in got.where("i = 77").select("i", "entries", "total", "delta", "direct").collect()] == [(77, 0, 0, 0, 2)]


@pytest.mark.parametrize("weighted", [False, True])
def test_several_matrices_by_one_pass(tables, weighted):
    """Rows of several relaxed matrices are those of each, though *left* is dealt out once."""
    left, places = tables
    cells = grid.LatticeCells(0.01)
    parts = [relaxed.exact_part(places, 2000, weighted), relaxed.grid_part(places, 500, cells, weighted), relaxed.exact_part(places, 300, weighted), relaxed.grid_part(places, 2000, cells, weighted)]
    got = relaxed.rows_of(left, parts, weighted)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    want = [relaxed.exact_rows(left, places, 2000, weighted), relaxed.grid_rows(left, places, 500, cells, weighted), relaxed.exact_rows(left, places, 300, weighted), relaxed.grid_rows(left, places, 2000, cells, weighted)]
    rows = got.persist()
    for k, w in enumerate(want):
        assert close(rows.where(F.col("of") == k).drop("of").collect()) == close(w.collect())


@pytest.mark.parametrize("weighted", [False, True])
def test_matrix_without_grouping_its_entries(tables, weighted):
    left, places = tables
    for eps in (0, 2000):
        got = relaxed.exact_matrix(left, places, eps, weighted)
        want = spatial.extend_exact(left, places, eps, weighted)
        flat = lambda m: close(m.select("i", "c.u", "c.v", "m").collect())
        assert flat(got) == flat(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("FlatMapGroupsInArrow")]


@pytest.mark.parametrize("weighted", [False, True])
def test_entries_travel_without_their_places(spark, tables, weighted, monkeypatch):
    """Entries are shuffled as ``i, j, v`` and meet packed places in their bucket; with more places than a bucket gets they are joined first, with the same rows."""
    left, places = tables
    left = left.unionByName(spark.createDataFrame([(77, 900, 1), (77, 901, 2), (3, 900, 1), (3, None, 1)], "i bigint, j bigint, v bigint"))
    places = places.unionByName(spark.createDataFrame([(None, 0.01, 60.01), (5, None, 60.0)], "id bigint, lon double, lat double"))
    cells = grid.LatticeCells(0.01)
    parts = [relaxed.exact_part(places, 2000, weighted), relaxed.grid_part(places, 2000, cells, weighted)]
    spread = places.select(F.col("id").alias("j")).distinct().where("j % 3 = 0").select("j", (F.col("j") % 5).alias("q0"))

    def rows():
        return [relaxed._rows(left, parts, weighted, spread), relaxed.exact_rows(left, places, 2000, weighted, direct=True), relaxed.exact_rows(left.where("i < 0"), places, 2000, weighted)]

    monkeypatch.setattr(relaxed, "ENTRIES", 30)
    monkeypatch.setattr(relaxed, "PIECE", 10)
    with monkeypatch.context() as m:
        m.setattr(relaxed, "WHOLE", 80)
        joined = rows()
    monkeypatch.setattr(relaxed, "WHOLE", 100)
    copied = rows()
    for a, b, size in zip(joined, copied, (50, 26, 0), strict=True):
        plan = b._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
        assert "FlatMapCoGroupsInArrow" not in a._jdf.queryExecution().optimizedPlan().toString()
        got = b.collect()
        assert close(tuple(-1 if x is None else x for x in r) for r in got) == close(tuple(-1 if x is None else x for x in r) for r in a.collect())
        assert len(got) == size
