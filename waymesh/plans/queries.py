"""The registered queries over the business tables, seen as a graph, with their DuckDB statements.

Customers place orders, orders hold parts and are supplied by suppliers; suppliers are places.  The tables
have no coordinates, so these are made from keys by the same arithmetic in both engines.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions import hexagons
from waymesh.functions.geo import haversine_m
from waymesh.functions.metapath import EdgeType, parse_path
from waymesh.operators import cell_radius as radius
from waymesh.operators import boxes, epsilon, grid, matrix, quality, relaxed, similarity, spatial
from waymesh.sources import etl, model
from waymesh.sources.shared import shared_folder, written

from .session import bounded

EPS_M = 5000
QUERIES = (7, 11, 42)
ONE = 7
K = 10
CELLS = grid.LatticeCells(0.02)
HEXAGONS = grid.HexCells(7)

EDGE_TYPES = [EdgeType("placed", "customer", "order"), EdgeType("contains", "order", "part"), EdgeType("supplied_by", "order", "supplier"), EdgeType("in_nation", "customer", "nation"), EdgeType("in_region", "nation", "region")]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{d}/{name}.parquet")


def _edges(spark: SparkSession, d: str, edge: str) -> DataFrame:
    """``i, j`` of each edge of a type by the tables' own keys."""
    table, i, j = {"placed": ("orders", "o_custkey", "o_orderkey"), "contains": ("lineitem", "l_orderkey", "l_partkey"), "supplied_by": ("lineitem", "l_orderkey", "l_suppkey"), "in_nation": ("customer", "c_custkey", "c_nationkey"), "in_region": ("nation", "n_nationkey", "n_regionkey")}[edge]
    return _t(spark, d, table).select(F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j")).dropna()


def _step(spark: SparkSession, d: str, edge: str) -> DataFrame:
    """``i, j, v`` of an edge type: repeated edges are counted."""
    return _edges(spark, d, edge).groupBy("i", "j").agg(F.count("*").alias("v"))


def _path(spark: SparkSession, d: str, path: str, by: str = "edge_type") -> DataFrame:
    parts = []
    for s in parse_path(path, EDGE_TYPES, by):
        m = _step(spark, d, s.edge)
        parts.append(matrix.transpose(m) if s.inverse else m)
    return matrix.chain(parts)


def places(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    lon = F.lit(-150.0) + F.lit(12.0) * F.col("s_nationkey") + F.lit(0.001) * ((F.col("s_suppkey") * 37) % 101)
    lat = F.lit(-55.0) + F.lit(5.0) * (F.col("s_nationkey") % 22) + F.lit(0.001) * ((F.col("s_suppkey") * 53) % 89)
    return s.select(F.col("s_suppkey").alias("id"), lon.alias("lon"), lat.alias("lat"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """A row for each line of each customer's orders: edges are few to an order, so they meet there without being counted first."""
    placed, supplied = (_edges(spark, d, e).withColumn("v", F.lit(1).cast("bigint")) for e in ("placed", "supplied_by"))
    return matrix.terms(placed, supplied)


def _left(spark: SparkSession, d: str) -> DataFrame:
    """The meta path ``placed#supplied_by``."""
    return matrix.added(_terms(spark, d))


def _asked(spark: SparkSession, ids: tuple[int, ...] = QUERIES) -> DataFrame:
    return spark.createDataFrame([(q,) for q in ids], "query bigint")


def _exact(spark: SparkSession, d: str, weighted: bool = False) -> DataFrame:
    return spatial.extend_exact(_left(spark, d), places(spark, d), EPS_M, weighted)


def _exact_topk(spark: SparkSession, d: str, ids: tuple[int, ...] = QUERIES, weighted: bool = False) -> DataFrame:
    return relaxed.exact_top_k(_left(spark, d), places(spark, d), EPS_M, _asked(spark, ids), K, weighted)


def _grid(spark: SparkSession, d: str, weighted: bool = False, mode: str = "under") -> DataFrame:
    return spatial.extend_grid(_left(spark, d), places(spark, d), grid.grid_epsilon(EPS_M, CELLS.radius_m, mode), CELLS, weighted)


def _cells_topk(spark: SparkSession, d: str, cells, weighted: bool = False, mode: str = "under") -> DataFrame:
    return relaxed.grid_top_k(_left(spark, d), places(spark, d), grid.grid_epsilon(EPS_M, cells.radius_m, mode), cells, _asked(spark), K, weighted)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _graph(spark: SparkSession, d: str) -> model.Graph:
    """Customers, suppliers and nations as one numbered graph with their edges to nations."""
    c = _t(spark, d, "customer").select((F.col("c_custkey") * 3).alias("node_id"), F.lit(0).alias("type_id"), "c_nationkey")
    s = _t(spark, d, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("node_id"), F.lit(1).alias("type_id"), "s_nationkey")
    n = _t(spark, d, "nation").select((F.col("n_nationkey") * 3 + 2).cast("bigint").alias("node_id"), F.lit(2).alias("type_id"))
    nodes = c.select("node_id", "type_id").unionByName(s.select("node_id", "type_id")).unionByName(n)
    edges = c.select(F.col("node_id").alias("src"), F.lit(0).alias("etype_id"), (F.col("c_nationkey") * 3 + 2).cast("bigint").alias("dst")).unionByName(s.select(F.col("node_id").alias("src"), F.lit(1).alias("etype_id"), (F.col("s_nationkey") * 3 + 2).cast("bigint").alias("dst")))
    return model.Graph(nodes, edges, ["customer", "supplier", "nation"], [EdgeType("customer_in", "customer", "nation"), EdgeType("supplier_in", "supplier", "nation")])


def _rects(spark: SparkSession, d: str) -> DataFrame:
    o = places(spark, d)
    return o.select("id", F.col("lon").alias("min0"), F.col("lat").alias("min1"), (F.col("lon") + 0.5).alias("max0"), (F.col("lat") + 0.25).alias("max1"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw check-ins: a venue for each type and tenth of a value, a few rows out of range."""
    e = _t(spark, d, "events")
    venue = F.concat_ws("-", F.col("event_type"), (F.col("event_id") % 50).cast("string"))
    return e.select(F.col("user_id").cast("string").alias("userId"), venue.alias("venueId"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("venueCategoryId"), ((F.col("event_id") % 1900) * F.lit(0.1) - 95).alias("latitude"), ((F.col("event_id") % 3700) * F.lit(0.1) - 185).alias("longitude"), F.lit("X").alias("city"), F.col("event_id").alias("n"))


# -- queries ---------------------------------------------------------------------------------------


def node_local_ids(spark, d):
    return _graph(spark, d).numbered()


def type_histogram(spark, d):
    return _graph(spark, d).histogram()


def misplaced_edges(spark, d):
    g = _graph(spark, d)
    turned = g.edges.where("src % 30 = 0").select(F.col("dst").alias("src"), "etype_id", F.col("src").alias("dst"))
    return model.Graph(g.nodes, g.edges.unionByName(turned), g.node_types, g.edge_types).misplaced_edges()


def adjacency_graph(spark, d):
    return matrix.adjacency(_graph(spark, d), "customer_in")


def adjacency_supplied_by(spark, d):
    return _step(spark, d, "supplied_by")


def transpose(spark, d):
    return matrix.transpose(_step(spark, d, "supplied_by"))


def metapath_customer_supplier(spark, d):
    return _left(spark, d)


def metapath_inverse(spark, d):
    return _path(spark, d, "contains^-1#supplied_by")


def metapath_initials(spark, d):
    return _path(spark, d, "CNR", by="initials")


def deltas_plain(spark, d):
    return matrix.deltas(_left(spark, d))


def dense_deltas(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("i"))
    return matrix.dense_deltas(matrix.deltas(_left(spark, d)), rows)


def plain_topk(spark, d):
    return similarity.top_k(_left(spark, d), ONE, K)


def topk_of_all(spark, d):
    """The ten objects most like each customer, by suppliers."""
    return similarity.top_k_all(_left(spark, d), K)


def metapath_chain(spark, d):
    """Four steps, multiplied in the order of the least terms: parts to regions of those who order them."""
    return _path(spark, d, "contains^-1#placed^-1#in_nation#in_region")


def candidates(spark, d):
    return similarity.candidates(_left(spark, d), ONE)


def haversine_pairs(spark, d):
    """The distance of every place from the first place of its nation, itself included."""
    home = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("u"))
    first = home.join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_nationkey").alias("of")), F.col("s_nationkey") == F.col("of")).select("u", "v")
    a, b = (places(spark, d).select(F.col("id").alias(x), F.col("lon").alias(f"lon_{x}"), F.col("lat").alias(f"lat_{x}")) for x in "uv")
    return _rounded(first.join(a, "u").join(b, "v").select("u", "v", haversine_m(F.col("lon_u"), F.col("lat_u"), F.col("lon_v"), F.col("lat_v")).alias("dist")), "dist", digits=5)


def epsilon_pairs(spark, d):
    return _rounded(epsilon.epsilon_pairs(places(spark, d), EPS_M), "dist", digits=5)


def range_query(spark, d):
    return _rounded(epsilon.range_query(places(spark, d), -138.0, -50.0, 20_000), "dist", digits=5)


def box_search(spark, d):
    return epsilon.box_search(_rects(spark, d), [-140.0, -52.0], [-90.0, -25.0]).select("id")


def knn(spark, d):
    return _rounded(epsilon.nearest(_rects(spark, d), [-100.0, -30.0], [-99.0, -29.0], 15), "gap", digits=9)


def knn_of_many(spark, d):
    """The three rectangles nearest to each rectangle, itself included."""
    r = _rects(spark, d)
    return _rounded(boxes.nearest_of_many(r, r.withColumnRenamed("id", "query"), 3), "gap", digits=9)


def placed_box_search(spark, d):
    """The same search among files along a curve, of which only those that the box touches are read."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/placed-{uuid.uuid4().hex}"
    return boxes.Placed.build(_rects(spark, d), path, 16).box_search((-140.0, -52.0), (-90.0, -25.0)).select("id")


def box_removal(spark, d):
    r = _rects(spark, d)
    return epsilon.removed(r, r.where("id % 2 = 0"), [-140.0, -52.0], [-90.0, -25.0]).select("id")


def exact_unweighted_matrix(spark, d):
    return relaxed.exact_matrix(written(_left(spark, d)), places(spark, d), EPS_M).select("i", "c.u", "c.v", "m")


def exact_unweighted_deltas(spark, d):
    return relaxed.exact_deltas(written(_left(spark, d)), places(spark, d), EPS_M)


def exact_unweighted_topk(spark, d):
    return _exact_topk(spark, d, (ONE,)).select("node", "score", "rank")


def exact_unweighted_topk_batch(spark, d):
    return _exact_topk(spark, d)


def exact_kernel_topk(spark, d):
    return _exact_topk(spark, d)


def exact_weighted_topk(spark, d):
    return _rounded(_exact_topk(spark, d, weighted=True), "score")


def exact_through(spark, d):
    """Customers to nations of suppliers near those that they buy from: a relaxed place inside a path."""
    right = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("bigint").alias("j"), F.lit(1).cast("bigint").alias("v"))
    return relaxed.exact_through(_terms(spark, d), places(spark, d), EPS_M, right)


def grid_cells(spark, d):
    return _rounded(CELLS.near(places(spark, d), grid.grid_epsilon(EPS_M, CELLS.radius_m)), "dist", digits=5)


def grid_home_cell(spark, d):
    return places(spark, d).select("id", CELLS.cell_of(F.col("lon"), F.col("lat")).alias("cell"))


def grid_unweighted_topk(spark, d):
    return _cells_topk(spark, d, CELLS)


def grid_weighted_topk(spark, d):
    return _rounded(_cells_topk(spark, d, CELLS, weighted=True), "score")


def grid_over_topk(spark, d):
    return _cells_topk(spark, d, CELLS, mode="over")


def hex_anchors(spark, d):
    """Anchors of hexagons near each place."""
    near = HEXAGONS.near(places(spark, d), grid.grid_epsilon(EPS_M, HEXAGONS.radius_m))
    lon, lat = HEXAGONS.centre(F.col("cell"))
    return _rounded(near.select("id", lon.alias("lon"), lat.alias("lat"), "dist"), "lon", "lat", "dist", digits=4)


def hex_unweighted_topk(spark, d):
    return _cells_topk(spark, d, HEXAGONS)


def hex_weighted_topk(spark, d):
    return _rounded(_cells_topk(spark, d, HEXAGONS, weighted=True), "score")


def hex_over_topk(spark, d):
    return _cells_topk(spark, d, HEXAGONS, mode="over")


def hex_home_radius(spark, d):
    """How far the boundaries of the hexagons that places lie in are from their anchors."""
    p = places(spark, d)
    return _rounded(radius.hex_radius(p.select(HEXAGONS.cell_of(F.col("lon"), F.col("lat")).alias("cell"))), "vertex_m", "boundary_m", digits=4)


def pair_report(spark, d):
    left, p = written(_left(spark, d)), places(spark, d)
    two = written(left.where(F.col("i").isin(7, 11)))
    own = spatial.extend_columns(two, spatial.pair_columns(p, EPS_M, of=two.select(F.col("j").alias("id"))))
    best = relaxed.exact_top_k(left, p, EPS_M, _asked(spark, (7,)), 100)
    return _rounded(similarity.pair_report(left, own, 7, 11, 100, best), "value", digits=9)


def rank_position(spark, d):
    return similarity.rank_position(similarity.ranked(similarity.scores(_left(spark, d), _asked(spark))), 7, 11)


def _compared(spark, d):
    """Measures over every customer with a row in the matrix, at all the surveyed k."""
    left, p = written(_left(spark, d)), places(spark, d)
    every = left.select(F.col("i").alias("query")).distinct()
    eps = grid.grid_epsilon(EPS_M, CELLS.radius_m)
    rows = relaxed.whole_rows(left, [relaxed.exact_part(p, EPS_M), relaxed.grid_part(p, eps, CELLS)]).withColumnsRenamed({"delta_0": "d_ref", "delta_1": "d_cand"})
    return quality.compare_kernels(left, spatial.place_kernel(p, EPS_M), spatial.cell_columns(p, eps, CELLS), every, rows=rows)


def quality_precision_recall(spark, d):
    return _rounded(_compared(spark, d).select("queries", "precision", "recall"), "precision", "recall")


def quality_mae_mse(spark, d):
    return _rounded(_compared(spark, d).select("mae", "mse"), "mae", "mse", digits=9)


def quality_overlap(spark, d):
    names = [f"overlap_{k}" for k in quality.KS]
    return _rounded(_compared(spark, d).select(*names), *names)


def quality_ndcg(spark, d):
    names = [f"ndcg_{k}" for k in quality.KS]
    return _rounded(_compared(spark, d).select(*names), *names)


def neighbor_counts(spark, d):
    rows = written(relaxed.exact_rows(written(_left(spark, d)), places(spark, d), EPS_M, direct=True))
    return matrix.neighbor_counts(rows.select("i", F.col("direct").alias("entries")), rows, _t(spark, d, "customer").select(F.col("c_custkey").alias("i")))


def row_stats(spark, d):
    return matrix.row_stats(_left(spark, d))


def etl_dedupe_first_coord(spark, d):
    return _rounded(etl.first_coordinates(etl.valid_coordinates(_events(spark, d), "longitude", "latitude"), "venueId", "longitude", "latitude").withColumnRenamed("venueId", "venue"), "lon", "lat")


def etl_checkin_graph(spark, d):
    """Edges of the graph from check-ins, by global ids."""
    return etl.build_checkin_graph(_events(spark, d)).edges


def etl_duplicate_edges(spark, d):
    e = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.lit(2).alias("etype_id"), F.col("l_suppkey").alias("dst"))
    return etl.repeated_edges(e)


def etl_edge_counts(spark, d):
    return etl.edge_counts(_graph(spark, d).edges)


def query_sample(spark, d):
    return quality.query_sample(_left(spark, d), 100)


def distinct_cells(spark, d):
    """Anchors that the places of each nation are near to, and those of all."""
    near = CELLS.near(places(spark, d), grid.grid_epsilon(EPS_M, CELLS.radius_m)).join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey"), "id")
    return grid.distinct_cells(near, "s_nationkey")


def experiment_neighbors(spark, d):
    """Neighbours through shared columns for each customer, over distances and modes in one table, by one pass over the matrix."""
    p = places(spark, d)
    configurations = [{"approach": a, "epsilon": e} for e in (2000, EPS_M) for a in ("exact", "under", "over")]
    parts = [relaxed.exact_part(p, c["epsilon"]) if c["approach"] == "exact" else relaxed.grid_part(p, grid.grid_epsilon(c["epsilon"], CELLS.radius_m, c["approach"]), CELLS) for c in configurations]
    rows = written(relaxed.rows_of(written(_left(spark, d)), parts))
    return quality.experiments(configurations, lambda **c: rows.where(F.col("of") == configurations.index(c)).select("i", "entries", "total"))


def cell_radius(spark, d):
    return radius.cell_radius(spark, CELLS)


def timing_stats(spark, d):
    t = _t(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"))
    return _rounded(quality.timing_stats(t), "mean", "deviation")


# -- the same in DuckDB -----------------------------------------------------------------------------

_R = "6371008.8"


def _dist(a: str, b: str) -> str:
    h = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"
    return f"(2 * {_R}::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


_PLACE = """place AS (SELECT s_suppkey AS id, CAST(-150.0 AS DOUBLE) + CAST(12.0 AS DOUBLE) * s_nationkey + CAST(0.001 AS DOUBLE) * ((s_suppkey * 37) % 101) AS lon,
  CAST(-55.0 AS DOUBLE) + CAST(5.0 AS DOUBLE) * (s_nationkey % 22) + CAST(0.001 AS DOUBLE) * ((s_suppkey * 53) % 89) AS lat FROM supplier)"""
_L = "l AS (SELECT o_custkey AS i, l_suppkey AS j, count(*)::BIGINT AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"
_PAIRS = f"pairs AS (SELECT a.id AS u, b.id AS v, {_dist('a', 'b')} AS dist FROM place a JOIN place b ON a.id <= b.id AND abs(a.lat - b.lat) < 0.1 WHERE {_dist('a', 'b')} <= {EPS_M})"


def _columns(weighted: bool) -> str:
    w = f"sqrt(greatest(0.0::DOUBLE, 1 - dist / {EPS_M}))" if weighted else "1::BIGINT"
    return f"w AS (SELECT u, v, {w} AS w FROM pairs), r AS (SELECT j, u AS c1, v AS c2, w FROM (SELECT u AS j, u, v, w FROM w WHERE w > 0 UNION ALL SELECT v, u, v, w FROM w WHERE u < v AND w > 0))"


def _m(weighted: bool = False) -> str:
    kind = "DOUBLE" if weighted else "BIGINT"
    return f"{_PLACE}, {_L}, {_PAIRS}, {_columns(weighted)}, m AS (SELECT i, c1, c2, sum(l.v * r.w)::{kind} AS m FROM l JOIN r USING (j) GROUP BY ALL)"


_H = repr(CELLS.height)
_BANDS = CELLS.bands


def _cells(eps: float) -> str:
    """Anchors near places, from bands and columns around each place's own."""
    reach = int(eps / CELLS.radius_m) + 2
    mid = f"((-90 + b * {_H}::DOUBLE) + least(-90 + b * {_H}::DOUBLE + {_H}::DOUBLE, 90)) / 2"
    return f"""bands AS (SELECT id, lon, lat, floor((lat + 90) / {_H}::DOUBLE)::BIGINT + unnest(range(-{reach}, {reach} + 1)) AS b FROM place),
    banded AS (SELECT *, {mid} AS c_lat, greatest(1, ceil(360 * cos(radians({mid})) / {_H}::DOUBLE))::BIGINT AS n FROM bands WHERE b BETWEEN 0 AND {_BANDS - 1}),
    cols AS (SELECT *, ((floor((lon + 180) / 360 * n)::BIGINT + unnest(range(-{reach}, {reach} + 1))) % n + n) % n AS col FROM banded),
    anchors AS (SELECT id, b * 4294967296 + col AS cell, id AS pid, lon AS plon, lat AS plat, (col + 0.5::DOUBLE) * (360.0::DOUBLE / n) - 180 AS alon, c_lat AS alat FROM cols),
    dists AS (SELECT p.id, p.cell, {_dist('x', 'y').replace('x.lat', 'plat').replace('x.lon', 'plon').replace('y.lat', 'alat').replace('y.lon', 'alon')} AS dist FROM anchors p),
    near AS (SELECT DISTINCT id, cell::BIGINT AS cell, dist FROM dists WHERE dist <= {eps!r})"""


def _gm(weighted: bool, mode: str, distance: int = EPS_M) -> str:
    eps = grid.grid_epsilon(distance, CELLS.radius_m, mode)
    w = f"greatest(0.0::DOUBLE, 1 - dist / {eps!r})" if weighted else "1::BIGINT"
    kind = "DOUBLE" if weighted else "BIGINT"
    return f"{_PLACE}, {_L}, {_cells(eps)}, r AS (SELECT id AS j, cell AS c1, 0 AS c2, {w} AS w FROM near), m AS (SELECT i, c1, c2, sum(l.v * r.w)::{kind} AS m FROM l JOIN r USING (j) WHERE r.w > 0 GROUP BY ALL)"


def _hexagons(eps: float) -> str:
    """Anchors near places: places of each face's plane within six steps of a place's own, back on the sphere."""
    centre, axes = hexagons._frames()
    rows = ", ".join(f"({', '.join(repr(float(x)) + '::DOUBLE' for x in (*c, *a, *b))})" for c, (a, b) in zip(centre, axes, strict=True))
    scale = hexagons._scale(HEXAGONS.resolution)[1]
    mr, mi, size, u, h = (f"{float(x)!r}::DOUBLE" for x in (scale.real, scale.imag, abs(scale) ** 2, hexagons.UNIT, math.sqrt(0.75)))
    sides = " AND ".join(f"x * {math.cos(t)!r}::DOUBLE + y * {math.sin(t)!r}::DOUBLE <= 1.000000001" for t in (math.pi / 3, math.pi, 5 * math.pi / 3))
    return f"""face AS (SELECT * FROM (VALUES {rows}) AS t(cx, cy, cz, ax, ay, az, bx, b_y, bz)),
    pt AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM place),
    pf AS (SELECT *, (px * ax + py * ay + pz * az) / (px * cx + py * cy + pz * cz) / {u} AS qx, (px * bx + py * b_y + pz * bz) / (px * cx + py * cy + pz * cz) / {u} AS qy FROM pt, face WHERE px * cx + py * cy + pz * cz > 0.7),
    own AS (SELECT *, round((qx * {mi} + qy * {mr}) / {h}) AS b0, round(qx * {mr} - qy * {mi} - (qx * {mi} + qy * {mr}) / {h} / 2) AS a0 FROM pf),
    step AS (SELECT *, a0 + da.range AS a, b0 + db.range AS b FROM own, range(-6, 7) da, range(-6, 7) db),
    flat AS (SELECT *, ((a + b / 2) * {mr} + b * {h} * {mi}) / {size} AS x, (b * {h} * {mr} - (a + b / 2) * {mi}) / {size} AS y FROM step),
    ball AS (SELECT *, cx + {u} * (x * ax + y * bx) AS vx, cy + {u} * (x * ay + y * b_y) AS vy, cz + {u} * (x * az + y * bz) AS vz FROM flat WHERE {sides}),
    anchor AS (SELECT id, lon AS plon, lat AS plat, degrees(atan2(vy, vx)) AS alon, degrees(atan2(vz, sqrt(vx * vx + vy * vy))) AS alat FROM ball),
    dists AS (SELECT *, {_dist('x', 'y').replace('x.lat', 'plat').replace('x.lon', 'plon').replace('y.lat', 'alat').replace('y.lon', 'alon')} AS dist FROM anchor),
    near AS (SELECT id, round(alon, 6) AS lon6, round(alat, 6) AS lat6, min(alon) AS lon, min(alat) AS lat, min(dist) AS dist FROM dists WHERE dist <= {eps!r} GROUP BY 1, 2, 3)"""


def _hm(weighted: bool, mode: str) -> str:
    eps = grid.grid_epsilon(EPS_M, HEXAGONS.radius_m, mode)
    w = f"greatest(0.0::DOUBLE, 1 - dist / {eps!r})" if weighted else "1::BIGINT"
    kind = "DOUBLE" if weighted else "BIGINT"
    return f"{_PLACE}, {_L}, {_hexagons(eps)}, r AS (SELECT id AS j, lon6 AS c1, lat6 AS c2, {w} AS w FROM near), m AS (SELECT i, c1, c2, sum(l.v * r.w)::{kind} AS m FROM l JOIN r USING (j) WHERE r.w > 0 GROUP BY ALL)"


_PLAIN = f"{_L}, m AS (SELECT i, j AS c1, 0 AS c2, v AS m FROM l)"


def _eps(eps: int, approach: str) -> str:
    """The matrix of an experiment."""
    if approach == "exact":
        return _m().replace(f"<= {EPS_M})", f"<= {eps})")
    return _gm(False, approach, eps)


def _scores(name: str = "", ids: str = "7, 11, 42") -> str:
    """Scores from a matrix ``m``, under names with a suffix."""
    return f"d{name} AS (SELECT i, sum(m * m) AS delta FROM m{name} GROUP BY i), dot{name} AS (SELECT a.i AS query, b.i AS node, sum(a.m * b.m) AS dot FROM m{name} a JOIN m{name} b ON a.c1 = b.c1 AND a.c2 = b.c2 WHERE a.i IN ({ids}) GROUP BY ALL), s{name} AS (SELECT query, node, CAST(2.0 AS DOUBLE) * dot::DOUBLE / (x.delta + y.delta)::DOUBLE AS score FROM dot{name} JOIN d{name} x ON x.i = query JOIN d{name} y ON y.i = node)"


_RANKED = "row_number() OVER (PARTITION BY query ORDER BY score DESC, node DESC)::BIGINT AS rank"


def _top(m: str, digits: int | None = None) -> str:
    score = "score" if digits is None else f"round(score, {digits})"
    return f"WITH {m}, {_scores()}, k AS (SELECT query, node, score, {_RANKED} FROM s) SELECT query, node, {score} AS score, rank FROM k WHERE rank <= {K}"


def _top_one(m: str) -> str:
    return f"WITH {m}, {_scores(ids=str(ONE))}, k AS (SELECT node, score, {_RANKED} FROM s) SELECT * FROM k WHERE rank <= {K}"


def _quality() -> str:
    ids = "SELECT i FROM l"
    exact = _m().replace("m AS (SELECT", "m_e AS (SELECT")
    gm = _gm(False, "under").split(_L + ", ")[1].replace("r AS (SELECT id", "r_g AS (SELECT id").replace("m AS (SELECT", "m_g AS (SELECT").replace("JOIN r USING (j) WHERE r.w", "JOIN r_g AS r USING (j) WHERE r.w")
    ranks = ", ".join(f"k{x} AS (SELECT query, node, score, {_RANKED} FROM s{x} WHERE node <> query AND score > 0)" for x in ("_e", "_g"))
    per_k = ", ".join(
        f"count(*) FILTER (e.rank <= {k} AND g.rank <= {k}) AS same_{k}, coalesce(sum((pow(2.0::DOUBLE, coalesce(e.score, 0)) - 1) / log2(g.rank + 1)) FILTER (g.rank <= {k}), 0) AS dcg_{k}, coalesce(sum((pow(2.0::DOUBLE, e.score) - 1) / log2(e.rank + 1)) FILTER (e.rank <= {k}), 0) AS best_{k}"
        for k in quality.KS
    )
    return f"""WITH {exact}, {gm}, {_scores('_e', ids)}, {_scores('_g', ids)}, {ranks},
    j AS (SELECT coalesce(e.query, g.query) AS query, count(e.rank) AS n_ref, count(g.rank) AS n_cand, count(*) FILTER (e.rank IS NOT NULL AND g.rank IS NOT NULL) AS hits, count(*) AS n,
      sum(abs(coalesce(e.score, 0) - coalesce(g.score, 0))) AS abs_, sum(pow(coalesce(e.score, 0) - coalesce(g.score, 0), 2)) AS sq, {per_k} FROM k_e e FULL JOIN k_g g ON e.query = g.query AND e.node = g.node GROUP BY 1),
    every AS (SELECT q.query, coalesce(n_ref, 0) AS n_ref, coalesce(n_cand, 0) AS n_cand, coalesce(n, 0) AS n, * EXCLUDE (query, n_ref, n_cand, n) FROM (SELECT DISTINCT i AS query FROM l) q LEFT JOIN j ON j.query = q.query)"""


def _at(name: str, expression: str) -> str:
    return ", ".join(f"round(coalesce(avg({expression.format(k=k)}) FILTER (n_ref >= {k}), 0), 6) AS {name}_{k}" for k in quality.KS)


_GRAPH = "nodes AS (SELECT c_custkey * 3 AS node_id, 0 AS type_id FROM customer UNION ALL SELECT s_suppkey * 3 + 1, 1 FROM supplier UNION ALL SELECT n_nationkey::BIGINT * 3 + 2, 2 FROM nation), edges AS (SELECT c_custkey * 3 AS src, 0 AS etype_id, c_nationkey::BIGINT * 3 + 2 AS dst FROM customer UNION ALL SELECT s_suppkey * 3 + 1, 1, s_nationkey::BIGINT * 3 + 2 FROM supplier)"
_RECTS = f"{_PLACE}, rects AS (SELECT id, lon AS min0, lat AS min1, lon + 0.5::DOUBLE AS max0, lat + 0.25::DOUBLE AS max1 FROM place)"
_BOX = "min0 <= -90 AND max0 >= -140 AND min1 <= -25 AND max1 >= -52"
_EVENTS = "ev AS (SELECT 'X:' || user_id AS usr, event_type || '-' || (event_id % 50) AS venue, CASE WHEN event_id % 7 <> 0 THEN event_type END AS cat, (event_id % 1900) * 0.1::DOUBLE - 95 AS lat, (event_id % 3700) * 0.1::DOUBLE - 185 AS lon, event_id AS n FROM events), ok AS (SELECT * FROM ev WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND usr IS NOT NULL)"


def _report(name: str) -> str:
    """Values of two objects in ``m_<name>``, and the second one's place in the first one's results."""
    return f"""v_{name} AS (SELECT sum(x * y) AS dot, sum(x * x) AS delta_a, sum(y * y) AS delta_b FROM (SELECT coalesce(sum(m) FILTER (i = 7), 0)::DOUBLE AS x, coalesce(sum(m) FILTER (i = 11), 0)::DOUBLE AS y FROM m_{name} WHERE i IN (7, 11) GROUP BY c1, c2)),
    {_scores('_' + name, '7')}, k_{name} AS (SELECT node, {_RANKED} FROM s_{name}),
    t_{name} AS (SELECT '{name}_dot' AS measure, coalesce(dot, 0) AS value FROM v_{name} UNION ALL SELECT '{name}_delta_a', coalesce(delta_a, 0) FROM v_{name} UNION ALL SELECT '{name}_delta_b', coalesce(delta_b, 0) FROM v_{name}
      UNION ALL SELECT '{name}_score', CASE WHEN coalesce(delta_a + delta_b, 0) = 0 THEN 0 ELSE 2 * dot / (delta_a + delta_b) END FROM v_{name} UNION ALL SELECT '{name}_rank', coalesce((SELECT max(rank) FROM k_{name} WHERE node = 11 AND rank <= 100), -1)::DOUBLE)"""


ORACLE: dict[str, str] = {
    "node_local_ids": f"WITH {_GRAPH} SELECT node_id, type_id, row_number() OVER (PARTITION BY type_id ORDER BY node_id)::BIGINT - 1 AS local_id FROM nodes",
    "type_histogram": f"WITH {_GRAPH} SELECT type_id, count(*)::BIGINT AS n FROM nodes GROUP BY type_id",
    "misplaced_edges": f"WITH {_GRAPH} SELECT dst AS src, etype_id, src AS dst FROM edges WHERE src % 30 = 0",
    "adjacency_graph": "SELECT row_number() OVER (ORDER BY c_custkey)::BIGINT - 1 AS i, rank::BIGINT AS j, 1::BIGINT AS v FROM customer JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS rank FROM nation) ON n_nationkey = c_nationkey",
    "adjacency_supplied_by": "SELECT l_orderkey AS i, l_suppkey AS j, count(*)::BIGINT AS v FROM lineitem GROUP BY ALL",
    "transpose": "SELECT l_suppkey AS i, l_orderkey AS j, count(*)::BIGINT AS v FROM lineitem GROUP BY ALL",
    "metapath_customer_supplier": f"WITH {_L} SELECT i, j, v FROM l",
    "metapath_inverse": "SELECT a.l_partkey AS i, b.l_suppkey AS j, count(*)::BIGINT AS v FROM lineitem a JOIN lineitem b USING (l_orderkey) GROUP BY ALL",
    "metapath_initials": "SELECT c_custkey AS i, n_regionkey::BIGINT AS j, count(*)::BIGINT AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL",
    "deltas_plain": f"WITH {_L} SELECT i, sum(v * v)::BIGINT AS delta FROM l GROUP BY i",
    "dense_deltas": f"WITH {_L} SELECT c_custkey AS i, coalesce(sum(v * v), 0)::BIGINT AS delta FROM customer LEFT JOIN l ON i = c_custkey GROUP BY c_custkey",
    "plain_topk": _top_one(_PLAIN),
    "topk_of_all": f"WITH {_PLAIN}, {_scores(ids='SELECT i FROM l')}, k AS (SELECT query, node, score, {_RANKED} FROM s) SELECT * FROM k WHERE rank <= {K}",
    "metapath_chain": "SELECT l_partkey AS i, n_regionkey::BIGINT AS j, count(*)::BIGINT AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL",
    "candidates": f"WITH {_L} SELECT DISTINCT b.i FROM l a JOIN l b USING (j) WHERE a.i = {ONE}",
    "haversine_pairs": f"WITH {_PLACE}, home AS (SELECT s_nationkey, min(s_suppkey) AS u FROM supplier GROUP BY s_nationkey) SELECT a.id AS u, b.id AS v, round({_dist('a', 'b')}, 5) AS dist FROM home JOIN supplier USING (s_nationkey) JOIN place a ON a.id = u JOIN place b ON b.id = s_suppkey",
    "epsilon_pairs": f"WITH {_PLACE}, {_PAIRS} SELECT u, v, round(dist, 5) AS dist FROM pairs",
    "range_query": f"WITH {_PLACE}, q AS (SELECT CAST(-138.0 AS DOUBLE) AS lon, CAST(-50.0 AS DOUBLE) AS lat) SELECT id, round({_dist('q', 'place')}, 5) AS dist FROM place, q WHERE {_dist('q', 'place')} <= 20000",
    "box_search": f"WITH {_RECTS} SELECT id FROM rects WHERE {_BOX}",
    "knn": f"WITH {_RECTS} SELECT id, round(pow(greatest(0, -100 - max0, min0 + 99), 2) + pow(greatest(0, -30 - max1, min1 + 29), 2), 9) AS gap FROM rects ORDER BY pow(greatest(0, -100 - max0, min0 + 99), 2) + pow(greatest(0, -30 - max1, min1 + 29), 2), id LIMIT 15",
    "knn_of_many": f"WITH {_RECTS}, g AS (SELECT a.id AS query, b.id, pow(greatest(0, a.min0 - b.max0, b.min0 - a.max0), 2) + pow(greatest(0, a.min1 - b.max1, b.min1 - a.max1), 2) AS gap FROM rects a, rects b), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gap, id) AS k FROM g) SELECT query, id, round(gap, 9) AS gap FROM k WHERE k <= 3",
    "placed_box_search": f"WITH {_RECTS} SELECT id FROM rects WHERE {_BOX}",
    "box_removal": f"WITH {_RECTS} SELECT id FROM rects WHERE NOT (id % 2 = 0 AND {_BOX})",
    "exact_unweighted_matrix": f"WITH {_m()} SELECT i, c1 AS u, c2 AS v, m FROM m",
    "exact_unweighted_deltas": f"WITH {_m()} SELECT i, sum(m * m)::BIGINT AS delta FROM m GROUP BY i",
    "exact_unweighted_topk": _top_one(_m()),
    "exact_unweighted_topk_batch": _top(_m()),
    "exact_kernel_topk": _top(_m()),
    "exact_weighted_topk": _top(_m(True), 6),
    "exact_through": f"WITH {_m()} SELECT i, s_nationkey::BIGINT AS j, sum(m.m * r.w)::BIGINT AS v FROM m JOIN r ON m.c1 = r.c1 AND m.c2 = r.c2 JOIN supplier ON s_suppkey = r.j GROUP BY ALL",
    "grid_cells": f"WITH {_PLACE}, {_cells(grid.grid_epsilon(EPS_M, CELLS.radius_m))} SELECT id, cell, round(dist, 5) AS dist FROM near",
    "grid_home_cell": f"WITH {_PLACE}, b AS (SELECT *, floor((lat + 90) / {_H}::DOUBLE)::BIGINT AS b FROM place), n AS (SELECT *, ceil(360 * cos(radians(((-90 + b * {_H}::DOUBLE) + least(-90 + b * {_H}::DOUBLE + {_H}::DOUBLE, 90)) / 2)) / {_H}::DOUBLE)::BIGINT AS n FROM b) SELECT id, b * 4294967296 + floor((lon + 180) / 360 * n)::BIGINT AS cell FROM n",
    "grid_unweighted_topk": _top(_gm(False, "under")),
    "grid_weighted_topk": _top(_gm(True, "under"), 6),
    "grid_over_topk": _top(_gm(False, "over")),
    "hex_anchors": f"WITH {_PLACE}, {_hexagons(grid.grid_epsilon(EPS_M, HEXAGONS.radius_m))} SELECT id, round(lon, 4) AS lon, round(lat, 4) AS lat, round(dist, 4) AS dist FROM near",
    "hex_unweighted_topk": _top(_hm(False, "under")),
    "hex_weighted_topk": _top(_hm(True, "under"), 6),
    "hex_over_topk": _top(_hm(False, "over")),
    "pair_report": f"WITH {_m().replace('m AS (SELECT', 'm_spatial AS (SELECT')}, m_plain AS (SELECT i, j AS c1, 0 AS c2, v AS m FROM l), {_report('plain')}, {_report('spatial')} SELECT measure, round(value, 9) AS value FROM (SELECT * FROM t_plain UNION ALL SELECT * FROM t_spatial)",
    "rank_position": f"WITH {_PLAIN}, {_scores(ids='7')}, k AS (SELECT node, {_RANKED} FROM s) SELECT 7::BIGINT AS query, 11::BIGINT AS node, coalesce((SELECT rank FROM k WHERE node = 11), -1)::BIGINT AS rank",
    "quality_precision_recall": f"{_quality()} SELECT count(*)::BIGINT AS queries, round(coalesce(avg(hits / n_cand) FILTER (n_cand > 0), 0), 6) AS precision, round(coalesce(avg(hits / n_ref) FILTER (n_ref > 0), 0), 6) AS recall FROM every",
    "quality_mae_mse": f"{_quality()} SELECT round(coalesce(avg(abs_ / n) FILTER (n > 0), 0), 9) AS mae, round(coalesce(avg(sq / n) FILTER (n > 0), 0), 9) AS mse FROM every",
    "quality_overlap": f"{_quality()} SELECT {_at('overlap', 'same_{k} / {k}.0::DOUBLE')} FROM every",
    "quality_ndcg": f"{_quality()} SELECT {_at('ndcg', 'CASE WHEN best_{k} > 0 THEN dcg_{k} / best_{k} ELSE 0 END')} FROM every",
    "neighbor_counts": f"WITH {_m()} SELECT c_custkey AS i, coalesce(a.n, 0)::BIGINT AS direct, coalesce(b.n, 0)::BIGINT AS spatial FROM customer LEFT JOIN (SELECT i, count(*) AS n FROM l GROUP BY i) a ON a.i = c_custkey LEFT JOIN (SELECT i, count(*) AS n FROM m GROUP BY i) b ON b.i = c_custkey",
    "row_stats": f"WITH {_L} SELECT i, count(*)::BIGINT AS entries, sum(v)::BIGINT AS total FROM l GROUP BY i",
    "etl_dedupe_first_coord": f"WITH {_EVENTS} SELECT venue, round(arg_min(lon, n), 6) AS lon, round(arg_min(lat, n), 6) AS lat FROM ok GROUP BY venue",
    "etl_checkin_graph": f"WITH {_EVENTS}, u AS (SELECT usr, row_number() OVER (ORDER BY usr COLLATE \"C\") - 1 AS id FROM (SELECT DISTINCT usr FROM ok)), p AS (SELECT venue, row_number() OVER (ORDER BY venue COLLATE \"C\") - 1 + (SELECT count(*) FROM u) AS id FROM (SELECT DISTINCT venue FROM ok)), c AS (SELECT cat, row_number() OVER (ORDER BY cat COLLATE \"C\") - 1 + (SELECT count(*) FROM u) + (SELECT count(*) FROM p) AS id FROM (SELECT DISTINCT cat FROM ok WHERE cat IS NOT NULL)) SELECT DISTINCT u.id::BIGINT AS src, 0 AS etype_id, p.id::BIGINT AS dst FROM ok JOIN u USING (usr) JOIN p USING (venue) UNION ALL SELECT DISTINCT p.id::BIGINT, 1, c.id::BIGINT FROM ok JOIN p USING (venue) JOIN c USING (cat)",
    "etl_duplicate_edges": "SELECT l_orderkey AS src, 2 AS etype_id, l_suppkey AS dst, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1",
    "etl_edge_counts": f"WITH {_GRAPH} SELECT etype_id, count(*)::BIGINT AS n FROM edges GROUP BY etype_id",
    "query_sample": f"WITH {_L} SELECT i AS query FROM (SELECT DISTINCT i, md5('42:' || i) AS h FROM l) ORDER BY h, i LIMIT 100",
    "distinct_cells": f"WITH {_PLACE}, {_cells(grid.grid_epsilon(EPS_M, CELLS.radius_m))}, o AS (SELECT s_nationkey, cell FROM near JOIN supplier ON s_suppkey = id) SELECT s_nationkey, count(DISTINCT cell)::BIGINT AS cells FROM o GROUP BY s_nationkey UNION ALL SELECT NULL, count(DISTINCT cell)::BIGINT FROM o",
    "experiment_neighbors": " UNION ALL ".join(f"SELECT '{a}' AS approach, {e}::INTEGER AS epsilon, i, entries, total FROM (WITH {_eps(e, a)} SELECT i, count(*)::BIGINT AS entries, sum(m)::BIGINT AS total FROM m GROUP BY i)" for e in (2000, EPS_M) for a in ("exact", "under", "over")),
    "timing_stats": "SELECT event_type AS name, count(*)::BIGINT AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY event_type",
}

#: Hashes and geometry that SQL can't say alike.
_ROWS_ONLY = ["cell_radius", "hex_home_radius"]


def queries() -> dict:
    return {name: globals()[name] for name in [*ORACLE, *_ROWS_ONLY]}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
