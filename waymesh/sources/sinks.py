"""Writers: Parquet inside, text where people or other tools read it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions.geo import cell_hex
from waymesh.functions.text import serialized


def _text_file(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_matrix(matrix: DataFrame, path: str, rows: int | None = None, columns: int | None = None) -> None:
    """Parquet, and beside it the dimensions as JSON."""
    matrix.write.mode("overwrite").parquet(f"{path}/entries")
    spark = matrix.sparkSession
    _text_file(spark.createDataFrame([(json.dumps({"rows": rows, "columns": columns, "types": dict(matrix.dtypes)}),)], "value string"), f"{path}/about")


def write_matrix_market(matrix: DataFrame, path: str, rows: int, columns: int) -> None:
    """Coordinate text, numbers from 1, in row order, as a folder of parts by name; *matrix* has ``i, j`` and a value.

    :func:`merged` makes one file of it.
    """
    value = next(c for c in matrix.columns if c not in ("i", "j"))
    kind = "integer" if dict(matrix.dtypes)[value] == "bigint" else "real"
    spark = matrix.sparkSession
    body = matrix.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col(value)).alias("value"))
    head = spark.createDataFrame([(0, 0, f"%%MatrixMarket matrix coordinate {kind} general"), (0, 1, f"{rows} {columns} {matrix.count()}")], "i bigint, j bigint, value string")
    _text_file(head.unionByName(body).orderBy("i", "j").select("value"), path)


def merged(spark: SparkSession, folder: str, path: str) -> None:
    """One file from a folder's parts, by name; bytes are copied as a stream, nothing is held."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = fs_path(folder), fs_path(path)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for status in sorted(fs.listStatus(source), key=lambda x: x.getPath().getName()):
            if status.isFile() and not status.getPath().getName().startswith(("_", ".")):
                part = fs.open(status.getPath())
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()


def write_deltas(deltas: DataFrame, path: str, text_path: str | None = None, rows: int | None = None) -> None:
    """Parquet; with *text_path* also a dense line of *rows* numbers, cut into parts by name at 4096 numbers each."""
    deltas.write.mode("overwrite").parquet(path)
    if text_path:
        spark = deltas.sparkSession
        dense = spark.range(rows).withColumnRenamed("id", "i").join(deltas, "i", "left").select("i", F.coalesce("delta", F.lit(0)).alias("delta"))
        of_part = dense.groupBy(F.floor(F.col("i") / 4096).alias("part")).agg(F.sort_array(F.collect_list(F.struct("i", "delta"))).alias("d"))
        _text_file(of_part.orderBy("part").select(serialized(F.col("d.delta")).alias("value")), text_path)


def write_delimited(df: DataFrame, path: str, delimiter: str = ";", decimals: int = 8) -> None:
    """A small result as delimited text with a header and fixed decimals."""
    fixed = [F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*fixed).coalesce(1).write.mode("overwrite").option("sep", delimiter).option("header", True).csv(path)


def write_report(report: DataFrame, path: str, decimals: int = 12) -> None:
    """``key, value`` rows as ``key: value`` lines."""
    value = F.format_string(f"%.{decimals}f", F.col("value")) if dict(report.dtypes)["value"] == "double" else F.col("value").cast("string")
    _text_file(report.select(F.concat_ws(": ", "key", value).alias("value")).coalesce(1), path)


def write_runtimes(timings: DataFrame, path: str) -> None:
    """Runtime rows: ``approach, weighted, epsilon, grid_resolution, query, k, row_nonzeros, row_value_sum, result_size, mean_ns, stddev_ns`` with the times in three units."""
    units = [(F.col(f"{x}_ns") / F.lit(by)).alias(f"{x}_{unit}") for x in ("mean", "stddev") for unit, by in (("ns", 1.0), ("us", 1e3), ("ms", 1e6))]
    write_delimited(timings.select("approach", "weighted", "epsilon", "grid_resolution", "query", "k", "row_nonzeros", "row_value_sum", "result_size", *units), path, decimals=6)


def write_neighbor_counts(counts: DataFrame, path: str) -> None:
    """``approach, epsilon, grid_resolution, query, direct_neighbors, spatial_neighbors``."""
    write_delimited(counts.select("approach", "epsilon", "grid_resolution", F.col("i").alias("query"), F.col("direct").alias("direct_neighbors"), F.col("spatial").alias("spatial_neighbors")), path)


def write_radius(radius: DataFrame, path: str) -> None:
    """``resolution, cells_checked, max_center_to_vertex_m, max_center_to_boundary_m, rounded_upper_bound_m, max_boundary_cell`` (the cell in hexadecimal)."""
    write_delimited(radius.select("resolution", F.col("cells").alias("cells_checked"), F.col("vertex_m").alias("max_center_to_vertex_m"), F.col("boundary_m").alias("max_center_to_boundary_m"), F.col("rho_m").alias("rounded_upper_bound_m"), cell_hex(F.col("farthest_cell")).alias("max_boundary_cell")), path, ",", 6)


def write_graph(graph, path: str) -> None:
    """The five header-less files, one for each place type's coordinates, and, where nodes have names, ``mapping/<type>_mapping.csv`` (local id, global id, name).

    All but the three small ones are folders of parts in order; :func:`merged` makes files of them.
    """
    spark = graph.nodes.sparkSession
    for name, rows in (("node_types.csv", graph.node_types), ("edge_types.csv", [e.name for e in graph.edge_types]), ("schema.csv", [f"{graph.type_id(e.source)},{graph.type_id(e.target)}" for e in graph.edge_types])):
        _text_file(spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1), f"{path}/{name}")
    _text_file(graph.nodes.orderBy("node_id").select(F.col("type_id").cast("string")), f"{path}/nodes.csv")
    graph.edges.orderBy("src", "etype_id", "dst").write.mode("overwrite").csv(f"{path}/edges.csv")
    for kind, df in graph.coordinates.items():
        df.orderBy("id").write.mode("overwrite").csv(f"{path}/{kind}WGS84.csv")
    for kind, df in graph.names.items():
        df.select("local", "global", "name").orderBy("global").write.mode("overwrite").csv(f"{path}/mapping/{kind}_mapping.csv")
