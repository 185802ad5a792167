"""Graphs from raw check-ins and photo metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions.metapath import EdgeType

from .model import Graph, numbered

CHECKIN_TYPES = ["user", "venue", "venue_category"]
CHECKIN_EDGES = [EdgeType("checked_in_at", "user", "venue"), EdgeType("has_category", "venue", "venue_category")]
PHOTO_TYPES = ["user", "photo"]
PHOTO_EDGES = [EdgeType("posted", "user", "photo")]


def _place() -> Column:
    """Where a row stands in its input, however files are cut and dealt: file, block and place in the block, which compare in that order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("n")


def read_checkins(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of check-in files with a header; ``city`` comes from the file's name, ``n`` is the input order (by file name, then place)."""
    raw = spark.read.csv(list(paths), header=True).select("*", _place())
    return raw.withColumn("city", city_of(F.col("n.file")))


def city_of(file: Column) -> Column:
    """A city's code from a file name, so that user ids of different cities don't meet."""
    name = F.lower(F.element_at(F.split(file, "/"), -1))
    return F.when(name.contains("nyc"), F.lit("NYC")).when(name.contains("tky"), F.lit("TKY")).otherwise(F.regexp_replace(name, r"\.csv$", ""))


def read_photos(spark: SparkSession, *paths: str) -> DataFrame:
    """Photo metadata from JSON lines (also gzipped)."""
    schema = "photoid string, uid string, longitude string, latitude string"
    return spark.read.schema(schema).json(list(paths)).select("*", _place())


def valid_coordinates(df: DataFrame, lon: str, lat: str, in_range: bool = True) -> DataFrame:
    """Rows with numeric (and, if asked for, possible) coordinates, as doubles."""
    typed = df.withColumns({lon: F.trim(F.col(lon).cast("string")).try_cast("double"), lat: F.trim(F.col(lat).cast("string")).try_cast("double")}).where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    return typed.where(F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)) if in_range else typed


def first_coordinates(df: DataFrame, key: str, lon: str, lat: str, order: str = "n") -> DataFrame:
    """The first coordinates of each key in input order."""
    first = df.groupBy(key).agg(F.min_by(F.struct(lon, lat), order).alias("at"))
    return first.select(key, F.col(f"at.{lon}").alias("lon"), F.col(f"at.{lat}").alias("lat"))


def _dictionary(names: DataFrame, start: int) -> DataFrame:
    """``name, local, global``: names in sorted order, numbered from 0 and from *start*."""
    return numbered(names.distinct(), ["name"], name="local").select("name", "local", (F.col("local") + start).alias("global"))


def _build(node_names: list[DataFrame], types: list[str], edges: list[tuple[int, DataFrame, int, int]], edge_types: list[EdgeType], coordinates: tuple[int, str, DataFrame]) -> Graph:
    dictionaries, start = [], 0
    for names in node_names:
        d = _dictionary(names, start)
        start += d.count()
        dictionaries.append(d)
    nodes = None
    for n, d in enumerate(dictionaries):
        part = d.select(F.col("global").alias("node_id"), F.lit(n).alias("type_id"))
        nodes = part if nodes is None else nodes.unionByName(part)
    every = None
    for etype, pairs, a, b in edges:
        x, y = (dictionaries[k].select(F.col("name").alias(c), F.col("global").alias(g)) for k, c, g in ((a, "a", "src"), (b, "b", "dst")))
        part = pairs.distinct().join(x, "a").join(y, "b").select("src", F.lit(etype).alias("etype_id"), "dst")
        every = part if every is None else every.unionByName(part)
    number, name, found = coordinates
    places = found.join(dictionaries[number], F.col("key") == F.col("name")).select(F.col("local").alias("id"), "lon", "lat")
    return Graph(nodes, every, types, edge_types, {name: places}, dict(zip(types, dictionaries, strict=True)))


def build_checkin_graph(checkins: DataFrame) -> Graph:
    """From ``userId, venueId, venueCategoryId, latitude, longitude, city, n``: users, venues and categories.

    Rows without a user, a venue or possible coordinates don't count; a missing category leaves the venue
    without one.  Users are named by city.  Repeated check-ins are one edge; a venue's first coordinates hold.
    """
    rows = valid_coordinates(checkins, "longitude", "latitude").where("userId IS NOT NULL AND venueId IS NOT NULL").withColumn("user", F.concat_ws(":", "city", "userId"))
    category = rows.where("venueCategoryId IS NOT NULL")
    names = [rows.select(F.col("user").alias("name")), rows.select(F.col("venueId").alias("name")), category.select(F.col("venueCategoryId").alias("name"))]
    edges = [(0, rows.select(F.col("user").alias("a"), F.col("venueId").alias("b")), 0, 1), (1, category.select(F.col("venueId").alias("a"), F.col("venueCategoryId").alias("b")), 1, 2)]
    at = first_coordinates(rows, "venueId", "longitude", "latitude").withColumnRenamed("venueId", "key")
    return _build(names, CHECKIN_TYPES, edges, CHECKIN_EDGES, (1, "venue", at))


def build_photo_graph(photos: DataFrame) -> Graph:
    """From ``photoid, uid, longitude, latitude, n``: users and photos. Coordinates need only be numbers."""
    rows = valid_coordinates(photos, "longitude", "latitude", in_range=False).where("uid IS NOT NULL AND photoid IS NOT NULL")
    names = [rows.select(F.col("uid").alias("name")), rows.select(F.col("photoid").alias("name"))]
    at = first_coordinates(rows, "photoid", "longitude", "latitude").withColumnRenamed("photoid", "key")
    return _build(names, PHOTO_TYPES, [(0, rows.select(F.col("uid").alias("a"), F.col("photoid").alias("b")), 0, 1)], PHOTO_EDGES, (1, "photo", at))


def edge_counts(edges: DataFrame) -> DataFrame:
    """``etype_id, n`` of a graph's edges."""
    return edges.groupBy("etype_id").agg(F.count("*").alias("n"))


def repeated_edges(edges: DataFrame) -> DataFrame:
    """Edges that occur more than once, with their number."""
    return edges.groupBy("src", "etype_id", "dst").agg(F.count("*").alias("n")).where("n > 1")
