"""Graph files without headers, coordinates, and matrices in text and Parquet form."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.functions.metapath import EdgeType
from waymesh.functions.text import deserialized

from . import model

FILES = ("node_types.csv", "edge_types.csv", "schema.csv", "nodes.csv", "edges.csv")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``n, line``: the lines of a file, or of a folder's files by their names, numbered from 0, without a trailing carriage return or blanks.

    Lines are numbered within the blocks that the scan cuts files into, and shifted by the blocks before; only
    the blocks' sizes meet in one place.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("k"), F.min("m").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("file", "block", "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("shift"))
    numbered = raw.join(shift, ["file", "block"]).select((F.col("m") - F.col("first") + F.col("shift")).alias("n"), "value")
    return numbered.select("n", F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"))


def load_graph(spark: SparkSession, path: str, coordinates: dict[str, str] | None = None, delimiter: str = ",", validate: bool = True) -> model.Graph:
    """A graph from its five files; *coordinates* names a file for each place type.

    A missing file is an error before anything is read.  With *validate*, an edge whose ends don't fit the
    schema is one too.
    """
    coordinates = coordinates or {}
    for name in (*FILES, *coordinates.values()):
        if not _exists(spark, f"{path}/{name}"):
            raise FileNotFoundError(f"{path}/{name}")
    # the dictionaries have a row for each type
    names = [[r["line"] for r in lines(spark, f"{path}/{f}").orderBy("n").collect()] for f in FILES[:3]]
    node_types = names[0]
    ends = [tuple(int(x) for x in line.split(",")) for line in names[2]]
    if len(ends) != len(names[1]):
        raise ValueError("schema.csv and edge_types.csv differ in length")
    edge_types = [EdgeType(e, node_types[a], node_types[b]) for e, (a, b) in zip(names[1], ends, strict=True)]
    nodes = lines(spark, f"{path}/nodes.csv").select(F.col("n").alias("node_id"), F.col("line").cast("int").alias("type_id"))
    edges = spark.read.csv(f"{path}/edges.csv", schema=model.EDGES, mode="FAILFAST")
    graph = model.Graph(nodes, edges, node_types, edge_types, {t: read_coordinates(spark, f"{path}/{f}", delimiter) for t, f in coordinates.items()})
    if validate and (bad := graph.misplaced_edges().first()):
        raise ValueError(f"edge {tuple(bad)} doesn't fit the schema")
    return graph


def read_coordinates(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``id, lon, lat``; rows without exactly three fields, or with a field that isn't a number, are left out."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    part = F.split(F.regexp_replace("value", "\r$", ""), f"[{delimiter}]" if delimiter not in "^\\]" else f"\\{delimiter}", -1)
    fields = spark.read.text(path).select(part.alias("p")).where(F.size("p") == 3)
    typed = fields.select(*(F.trim(F.col("p")[i]).try_cast(t).alias(c) for i, (c, t) in enumerate((("id", "bigint"), ("lon", "double"), ("lat", "double")))))
    return typed.dropna()


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]] | None:
    """``i, j, v`` (from 0) and rows, columns and entries of a coordinate MatrixMarket file.

    None, as for a file that isn't there, if the header isn't that of a general coordinate matrix of numbers,
    the size line isn't three numbers, or the entries don't fit it in number or place.
    """
    if not _exists(spark, path):
        return None
    text = lines(spark, path)
    head = text.where(~F.col("line").startswith("%") & (F.length("line") > 0)).orderBy("n").first()
    banner = text.where("n = 0").first()
    kind = re.fullmatch(r"%%MatrixMarket\s+matrix\s+coordinate\s+(integer|real)\s+general", banner["line"] if banner else "", re.I)
    size = re.fullmatch(r"\s*(\d+)\s+(\d+)\s+(\d+)", head["line"] if head else "")
    if not kind or not size:
        return None
    rows, columns, entries = (int(x) for x in size.groups())
    part = F.split(F.trim("line"), r"\s+")
    body = text.where((F.col("n") > head["n"]) & (F.length("line") > 0) & ~F.col("line").startswith("%")).select(part.alias("p"))
    matrix = body.select((F.get("p", F.lit(0)).try_cast("bigint") - 1).alias("i"), (F.get("p", F.lit(1)).try_cast("bigint") - 1).alias("j"), F.get("p", F.lit(2)).try_cast("double").alias("v"), (F.size("p") == 3).alias("three"))
    good = F.col("three") & F.col("i").between(0, rows - 1) & F.col("j").between(0, columns - 1) & F.col("v").isNotNull()
    found = matrix.agg(F.count("*").alias("n"), F.count_if(F.coalesce(good, F.lit(False))).alias("good")).first()
    if (found["n"], found["good"]) != (entries, entries):
        return None
    return matrix.drop("three"), (rows, columns, entries)


def read_deltas_text(spark: SparkSession, path: str) -> DataFrame:
    """``i, delta`` from comma-separated numbers, of one line or of lines that go on from each other."""
    text = lines(spark, path).where(F.length(F.trim("line")) > 0).select("n", deserialized(F.col("line")).alias("d"))
    sizes = text.select("n", F.size("d").alias("k"))
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("n").alias("of"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("shift"))
    return text.join(shift, F.col("n") == F.col("of")).select("shift", F.posexplode("d").alias("at", "delta")).select((F.col("shift") + F.col("at")).cast("bigint").alias("i"), "delta")
