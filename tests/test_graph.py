import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.functions import geo, metapath, text
from waymesh.functions.metapath import EdgeType, Step
from waymesh.operators import cell_radius, grid, matrix, quality
from waymesh.plans.catalog import Catalog
from waymesh.sources import etl, files, model, sinks

EDGES = [EdgeType("wrote", "author", "publication"), EdgeType("published_in", "publication", "venue"), EdgeType("works_at", "author", "affiliation")]


def test_paths():
    assert metapath.parse_path("published_in^-1#wrote^-1", EDGES) == [Step("published_in", True), Step("wrote", True)]
    assert metapath.parse_path("APV", EDGES[:2], by="initials") == [Step("wrote"), Step("published_in")]
    assert metapath.parse_path("VPA", EDGES[:2], by="initials") == [Step("published_in", True), Step("wrote", True)]
    for bad in ("nothing", "wrote#wrote"):
        with pytest.raises(ValueError):
            metapath.parse_path(bad, EDGES)
    with pytest.raises(ValueError):  # two types begin alike
        metapath.parse_path("AP", [*EDGES, EdgeType("cites", "affiliation", "publication")], by="initials")
    steps = metapath.parse_path("wrote#published_in", EDGES)
    assert metapath.inverted(metapath.inverted(steps)) == steps


def test_names():
    assert metapath.inverse_name("a#b^-1") == "b#a^-1"
    assert metapath.inverse_name("(a#b)^-1") == "a#b"
    assert metapath.mirrored_name("APV", "initials") == "APVPA"
    assert metapath.mirrored_name("a") == "a#(a)^-1"
    assert metapath.artefact_name("p", "venue", "grid", 500, True, 7) == "p|venue|grid|weighted|500m|res7"


def test_vectors(spark):
    df = spark.createDataFrame([("1.5,2",), ("",)], "s string")
    assert [r[0] for r in df.select(text.deserialized(F.col("s"))).collect()] == [[1.5, 2.0], []]
    assert df.limit(1).select(text.serialized(text.deserialized(F.col("s")))).first()[0] == "1.5,2.0"


@pytest.fixture
def folder(tmp_path):
    for name, body in {"node_types.csv": "item\r\nplace\r\n", "edge_types.csv": "located_at\r\n", "schema.csv": "0,1\r\n", "nodes.csv": "0\r\n1\r\n0\r\n1\r\n", "edges.csv": "0,0,1\n2,0,3\n2,0,3\n", "placesWGS84.csv": "id,lon,lat\n0,10.5,50\r\n1,11,51\n2,1\n3,x,4\n4,1,2,3\n5,,2\n"}.items():
        (tmp_path / name).write_bytes(body.encode())
    return str(tmp_path)


def test_files(spark, folder):
    g = files.load_graph(spark, folder, {"place": "placesWGS84.csv"})
    assert g.node_types == ["item", "place"]
    assert sorted(map(tuple, matrix.adjacency(g, "located_at").collect())) == [(0, 0, 1), (1, 1, 2)]
    assert sorted(map(tuple, g.coordinates["place"].collect())) == [(0, 10.5, 50.0), (1, 11.0, 51.0)]
    assert {r["type_id"]: r["n"] for r in g.histogram().collect()} == {0: 2, 1: 2}
    assert (g.type_of(3), g.local_id(3), g.count_of("place")) == ("place", 1, 2)
    with pytest.raises(ValueError):
        g.local_id(3, "item")
    with pytest.raises(ValueError):
        g.type_of(99)


def test_missing_file_and_bad_edge(spark, folder):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        files.load_graph(spark, folder, {"place": "nowhere.csv"})
    with open(f"{folder}/edges.csv", "a") as f:
        f.write("1,0,0\n")
    with pytest.raises(ValueError, match="schema"):
        files.load_graph(spark, folder)


def test_matrix_files(spark, tmp_path):
    m = spark.createDataFrame([(0, 2, 3), (1, 0, 1)], "i bigint, j bigint, v bigint")
    sinks.write_matrix_market(m, f"{tmp_path}/m", 2, 3)
    back, shape = files.read_matrix_market(spark, f"{tmp_path}/m")
    assert shape == (2, 3, 2) and sorted(map(tuple, back.collect())) == [(0, 2, 3.0), (1, 0, 1.0)]
    sinks.write_deltas(matrix.deltas(m), f"{tmp_path}/d", f"{tmp_path}/t", 3)
    assert sorted(map(tuple, files.read_deltas_text(spark, f"{tmp_path}/t").collect())) == [(0, 9.0), (1, 1.0), (2, 0.0)]
    sinks.write_matrix(m, f"{tmp_path}/p", 2, 3)
    assert spark.read.parquet(f"{tmp_path}/p/entries").count() == 2
    sinks.write_delimited(spark.createDataFrame([(1, 0.5)], "n int, x double"), f"{tmp_path}/c")
    assert spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/c").first()["x"] == "0.50000000"
    sinks.write_report(spark.createDataFrame([("a", 1.0)], "key string, value double"), f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").first()[0] == "a: 1.000000000000"


@pytest.mark.parametrize(
    "text,entries",
    [
        ("%%MatrixMarket matrix coordinate integer general\n% a comment\n2 3 2\n2 3 2\n1 1 7\n", [(0, 0, 7.0), (1, 2, 2.0)]),  # an entry like the size line
        ("%%MatrixMarket matrix coordinate real general\r\n2 2 0\r\n", []),
        ("%%MatrixMarket matrix coordinate real general\n2 3 3\n2 3 2\n1 1 7\n", None),  # fewer entries than told
        ("%%MatrixMarket matrix coordinate real general\n2 3 1\n2 3 2\n1 1 7\n", None),
        ("%%MatrixMarket matrix coordinate real general\n2 3 1\n2 4 2\n", None),  # out of range
        ("%%MatrixMarket matrix coordinate real general\n2 3 1\n2 x 2\n", None),
        ("%%MatrixMarket matrix coordinate real general\n2 3\n", None),
        ("%%MatrixMarket matrix array real general\n2 3 1\n1 1 1\n", None),
        ("2 3 1\n1 1 1\n", None),
        ("", None),
    ],
)
def test_matrix_market_headers(spark, tmp_path, text, entries):
    (tmp_path / "m.mtx").write_text(text, newline="")
    found = files.read_matrix_market(spark, f"{tmp_path}/m.mtx")
    assert (found is None) == (entries is None)
    assert found is None or sorted(map(tuple, found[0].collect())) == entries
    assert files.read_matrix_market(spark, f"{tmp_path}/nowhere.mtx") is None


def test_lines_are_numbered_in_the_jvm(spark, tmp_path):
    (tmp_path / "part-1").write_text("".join(f"b{k}\n" for k in range(700)))
    (tmp_path / "part-0").write_text("".join(f"a{k}  \r\n" for k in range(1000)), newline="")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        found = files.lines(spark, str(tmp_path))
        assert [(r["n"], r["line"]) for r in found.orderBy("n").collect()] == list(enumerate([*(f"a{k}" for k in range(1000)), *(f"b{k}" for k in range(700))]))
        assert "Python" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_local_ids_of_outlying_nodes(spark):
    rows = [*((i, i % 3) for i in range(0, 3000, 2)), (10**15, 1), (-5, 2)]
    got = {r["node_id"]: r["local_id"] for r in model.local_ids(spark.createDataFrame(rows, model.NODES)).collect()}
    for t in range(3):
        assert [got[i] for i in sorted(i for i, k in rows if k == t)] == list(range(sum(k == t for _, k in rows)))
    assert model.local_ids(spark.createDataFrame([], model.NODES)).collect() == []
    # places and counts come from one and the same split into ranges: it is written, and no part of the plan any more
    found = model.local_ids(spark.createDataFrame(rows, model.NODES))
    found.collect()
    assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_layouts(spark, tmp_path):
    t = spark.createDataFrame([("exact", True, 500, 0, 7, 10, 3, 4.5, 2, 1500.0, 0.0)], "approach string, weighted boolean, epsilon int, grid_resolution int, query bigint, k int, row_nonzeros bigint, row_value_sum double, result_size int, mean_ns double, stddev_ns double")
    sinks.write_runtimes(t, f"{tmp_path}/r")
    read = spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/r")
    assert read.columns[-6:] == ["mean_ns", "mean_us", "mean_ms", "stddev_ns", "stddev_us", "stddev_ms"] and read.first()["mean_us"] == "1.500000"
    counts = matrix.neighbor_counts(spark.createDataFrame([(1, 2, 1)], "i bigint, j bigint, v bigint"), spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "i bigint, j bigint, v bigint"), spark.createDataFrame([(1,)], "i bigint"))
    sinks.write_neighbor_counts(counts.selectExpr("'grid' AS approach", "4000 AS epsilon", "2 AS grid_resolution", "*"), f"{tmp_path}/n")
    assert tuple(spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/n").first()) == ("grid", "4000", "2", "1", "1", "2")
    sinks.write_radius(cell_radius.cell_radius(spark, grid.LatticeCells(30.0)).selectExpr("7 AS resolution", "*"), f"{tmp_path}/c")
    r = spark.read.option("header", True).csv(f"{tmp_path}/c").first()
    assert int(r["max_boundary_cell"], 16) >= 0 and float(r["max_center_to_vertex_m"]) <= float(r["rounded_upper_bound_m"])


def test_photo_files(spark, tmp_path):
    """Shards of JSON lines, also compressed; the first coordinates are those of the first file by name."""
    import gzip

    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"photoid": "p1", "uid": "u1", "longitude": "1", "latitude": "2", "title": "x"}\n')
    (tmp_path / "b.json").write_text('{"photoid": "p1", "uid": "u1", "longitude": "9", "latitude": "9"}\n' * 400 + '{"photoid": "p2", "uid": "u2", "longitude": "3", "latitude": null}\n{"photoid": "p3", "uid": "u1", "longitude": "4", "latitude": "5"}\n')
    g = etl.build_photo_graph(etl.read_photos(spark, f"{tmp_path}/b.json", f"{tmp_path}/a.json.gz"))
    assert sorted(map(tuple, g.coordinates["photo"].collect())) == [(0, 1.0, 2.0), (1, 4.0, 5.0)]
    assert sorted(map(tuple, g.edges.collect())) == [(0, 0, 1), (0, 0, 2)]
    sinks.write_graph(g, f"{tmp_path}/out")
    sinks.merged(spark, f"{tmp_path}/out/mapping/photo_mapping.csv", f"{tmp_path}/photo.csv")
    assert (tmp_path / "photo.csv").read_text().splitlines() == ["0,1,p1", "1,2,p3"]


def test_row_dimensions(spark):
    m = spark.createDataFrame([(0, 2, 3), (1, 0, 1)], "i bigint, j bigint, v bigint")
    quality.same_rows(m, m)
    with pytest.raises(ValueError, match="rows differ"):
        quality.same_rows(m, m.where("i = 0"))


def test_experiments(spark):
    got = quality.experiments([{"a": "x", "n": 1}, {"a": "y", "n": 2}], lambda a, n: spark.range(n).withColumnRenamed("id", "i"))
    assert sorted(map(tuple, got.collect())) == [("x", 1, 0), ("y", 2, 0), ("y", 2, 1)] and got.columns == ["a", "n", "i"]


def test_cells_in_hexadecimal(spark):
    assert spark.range(1).select(geo.cell_hex(F.lit(0x8A2A1072B59FFFF))).first()[0] == "8a2a1072b59ffff"


def test_catalog(spark, tmp_path):
    c, calls = Catalog(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(3)

    a = spark.range(5)
    for table in (a, a, spark.range(6)):
        assert c.get_or_build("x", [table], build).count() == 3
    assert len(calls) == 2  # a changed input is built anew


def test_checkins(spark, tmp_path):
    head = "userId,venueId,venueCategoryId,latitude,longitude\n"
    (tmp_path / "a_NYC.csv").write_text(head + "1,v1,c1,40,-74\n1,v1,c1,40,-74\n1,v1,c1,41,-73\n2,v2,,40.5,-74\n3,v3,c2,91,0\n4,v4,c2,1,east\n")
    (tmp_path / "a_TKY.csv").write_text(head + "1,v5,c1,35,139\n")
    g = etl.build_checkin_graph(etl.read_checkins(spark, f"{tmp_path}/a_NYC.csv", f"{tmp_path}/a_TKY.csv"))
    # users NYC:1, NYC:2, TKY:1; venues v1, v2, v5; category c1
    assert {r["type_id"]: r["n"] for r in g.histogram().collect()} == {0: 3, 1: 3, 2: 1}
    assert sorted(map(tuple, g.edges.collect())) == [(0, 0, 3), (1, 0, 4), (2, 0, 5), (3, 1, 6), (5, 1, 6)]
    assert sorted(map(tuple, g.coordinates["venue"].collect())) == [(0, -74.0, 40.0), (1, -74.0, 40.5), (2, 139.0, 35.0)]
    assert etl.repeated_edges(g.edges).count() == 0
    assert g.misplaced_edges().count() == 0
    sinks.write_graph(g, f"{tmp_path}/out")
    back = files.load_graph(spark, f"{tmp_path}/out", {"venue": "venueWGS84.csv"})
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect()))


def test_photos(spark):
    rows = [("p1", "u1", "1.0", "2.0", 0), ("p2", "u1", None, "2.0", 1), ("p3", "u2", "500", "2", 2)]
    g = etl.build_photo_graph(spark.createDataFrame(rows, "photoid string, uid string, longitude string, latitude string, n bigint"))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 0, 2), (1, 0, 3)]


def test_quality(spark):
    kind = "query bigint, node bigint, score double, rank bigint"
    ref = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.5, 2)], kind)
    cand = spark.createDataFrame([(1, 3, 0.5, 1), (1, 4, 0.25, 2)], kind)
    asked = spark.createDataFrame([(1,), (8,)], "query bigint")
    r = quality.compare_rankings(ref, cand, asked, (1, 2, 5)).first()
    assert (r["queries"], r["precision"], r["recall"]) == (2, 0.5, 0.5)
    assert r["mae"] == pytest.approx((0.9 + 0 + 0.25) / 3) and r["mse"] == pytest.approx((0.81 + 0.0625) / 3)
    assert (r["overlap_1"], r["overlap_2"], r["overlap_5"]) == (0, 0.5, 0)  # too short a reference doesn't count
    assert r["ndcg_1"] == pytest.approx((2**0.5 - 1) / (2**0.9 - 1))


def test_radius(spark):
    r = cell_radius.cell_radius(spark, grid.LatticeCells(5.0)).first()
    cells = grid.LatticeCells(5.0)
    assert r["cells"] == cells.all_cells(spark).count()
    assert r["vertex_m"] <= r["boundary_m"] + 1e-6 and r["rho_m"] <= cells.radius_m + 1


def test_farthest_on_arcs():
    """Against the arcs' points, one by one."""
    rng = np.random.default_rng(6)
    at = lambda n: cell_radius.unit_vectors(rng.uniform(-180, 180, n), rng.uniform(-90, 90, n))
    centre, start, end = at(300), at(300), at(300)
    end[:100] = start[:100] + 0.01 * end[:100]  # short arcs, and some around the centre
    end /= np.linalg.norm(end, axis=1, keepdims=True)
    centre[100:150] = -(start + end)[100:150] / np.linalg.norm((start + end)[100:150], axis=1, keepdims=True)
    angle = cell_radius.central_angle(start, end)[:, None]
    t = np.linspace(0, 1, 4001)
    points = (np.sin((1 - t) * angle)[..., None] * start[:, None] + np.sin(t * angle)[..., None] * end[:, None]) / np.sin(angle)[..., None]
    want = cell_radius.central_angle(centre[:, None], points).max(1)
    assert np.allclose(cell_radius.farthest_on_arc(centre, start, end), want, atol=1e-5)
    same = cell_radius.farthest_on_arc(centre[:1], start[:1], start[:1])  # an arc of no length
    assert np.allclose(same, cell_radius.central_angle(centre[:1], start[:1]))


def test_lattice_of_resolutions(spark):
    for resolution, radius in grid.COVER_M.items():
        assert grid.LatticeCells.of_resolution(resolution).radius_m == pytest.approx(radius)
    assert grid.LatticeCells.of_resolution(4).radius_m == pytest.approx(10838 * 7**0.5)
    with pytest.raises(ValueError):
        grid.LatticeCells.of_resolution(16)
    places = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, -170.0, 60.0)], "id bigint, lon double, lat double")
    cells = grid.LatticeCells(1.0)
    near = cells.near(places, 0.0 + cells.radius_m).withColumn("g", F.col("id") % 2)
    got = {r["g"]: r["cells"] for r in grid.distinct_cells(near, "g").collect()}
    each = {k: {r["cell"] for r in near.where(F.col("g") == k).collect()} for k in (0, 1)}
    assert got == {0: len(each[0]), 1: len(each[1]), None: len(each[0] | each[1])}


def test_stream(spark, tmp_path):
    from waymesh.streaming.edges import adjacency_stream, merged

    for n, rows in enumerate([[(1, 2), (1, 2)], [(1, 2), (3, 4)]]):
        spark.createDataFrame(rows, "i bigint, j bigint").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    edges = spark.readStream.schema("i bigint, j bigint").parquet(f"{tmp_path}/in/*")
    q = adjacency_stream(edges).writeStream.outputMode("complete").format("memory").queryName("adjacency").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("adjacency").collect())) == [(1, 2, 3), (3, 4, 1)]
    parts = spark.createDataFrame([(1, 2, 1), (1, 2, 4)], "i bigint, j bigint, v bigint")
    assert [tuple(r) for r in merged(parts).collect()] == [(1, 2, 5)]


def test_sample(spark):
    rows = spark.range(1000).withColumnRenamed("id", "i")
    a = [r["query"] for r in quality.query_sample(rows, 50).collect()]
    assert len(a) == 50 and a == sorted(a) and a == [r["query"] for r in quality.query_sample(rows, 50).collect()]

def test_numbers_without_reused_exchanges(spark):
    """Two million ids and names are numbered without gaps, however the plan is made."""
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        n = 1_000_000
        nodes = spark.range(2 * n).select((F.xxhash64("id")).alias("node_id"), (F.col("id") % 2).cast("int").alias("type_id"))
        found = model.local_ids(nodes).groupBy("type_id").agg(F.count("*").alias("n"), F.countDistinct("local_id").alias("d"), F.min("local_id").alias("low"), F.max("local_id").alias("high"))
        assert sorted(map(tuple, found.collect())) == [(t, n, n, 0, n - 1) for t in (0, 1)]
        names = etl._dictionary(spark.range(2 * n).select(F.sha2(F.col("id").cast("string"), 256).alias("name")), 5)
        assert tuple(names.agg(F.count("*"), F.countDistinct("local"), F.min("local"), F.max("local"), F.max("global")).first()) == (2 * n, 2 * n, 0, 2 * n - 1, 2 * n + 4)
        # in order, too
        assert model.local_ids(nodes).where("type_id = 0").selectExpr("local_id - row_number() over (order by node_id) AS gap").distinct().collect() == [(-1,)]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
