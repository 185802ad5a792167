"""Boxes and places kept in files along a space-filling curve, and the nearest boxes of many queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.functions.geo import RADIUS_M
from waymesh.sources.shared import written

from .epsilon import box_search, range_query

#: The columns of a box.
SIDES = ("min0", "min1", "max0", "max1")
#: Pairs of a query and a box that are measured at once.
PAIRS = 1 << 20
#: Bits of either coordinate in a place on the curve.
BITS = 16


def _curve(x: Column, y: Column, ends: tuple[float, float, float, float]) -> Column:
    """A place on the curve that alternates the bits of both coordinates (Morton's)."""
    low_x, high_x, low_y, high_y = ends

    def spread(v: Column, low: float, high: float) -> Column:
        n = F.least(F.greatest(F.floor((v - low) / max(high - low, 1e-300) * ((1 << BITS) - 1)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return n

    return spread(x, low_x, high_x).bitwiseOR(F.shiftleft(spread(y, low_y, high_y), 1))


class Placed:
    """A table of boxes (``min0, min1, max0, max1``) or places (``lon, lat``) whose files hold what lies together.

    ``rows`` has the rows, sorted along the curve, and ``bounds`` a row for each file.  A search asks the
    bounds first and reads only files that it may find something in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.bounds = spark.read.parquet(f"{self.path}/bounds")
        self.schema = spark.read.parquet(f"{self.path}/rows").schema

    @classmethod
    def build(cls, rows: DataFrame, path: str, files: int) -> "Placed":
        """Writes *rows* to about *files* files; rows with a null coordinate are in no search and left out."""
        spark, path = rows.sparkSession, path.rstrip("/")
        sides = cls._sides(rows.columns)
        rows = rows.dropna(subset=list(dict.fromkeys(sides)))
        x, y = ((F.col(sides[k]) + F.col(sides[k + 2])) / 2 for k in (0, 1))
        ends = rows.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
        key = _curve(x, y, tuple(0.0 if e is None else float(e) for e in ends))
        rows.withColumn("_key", key).repartitionByRange(files, "_key").sortWithinPartitions("_key").drop("_key").write.parquet(f"{path}/rows")
        found = spark.read.parquet(f"{path}/rows").select("*", F.col("_metadata.file_name").alias("_file"))
        low = [F.min(sides[k]).alias(f"low{k}") for k in (0, 1)]
        high = [F.max(sides[k + 2]).alias(f"high{k}") for k in (0, 1)]
        found.groupBy("_file").agg(*low, *high, F.count("*").alias("n")).write.parquet(f"{path}/bounds")
        return cls(spark, path)

    @staticmethod
    def _sides(columns: list[str]) -> list[str]:
        return ["lon", "lat", "lon", "lat"] if "lon" in columns else ["min0", "min1", "max0", "max1"]

    def files(self, low: tuple[float, float], high: tuple[float, float]) -> list[str]:
        """Files whose rows may touch a box."""
        hit = F.lit(True)
        for k in (0, 1):
            hit = hit & (F.col(f"low{k}") <= F.lit(float(high[k]))) & (F.col(f"high{k}") >= F.lit(float(low[k])))
        return sorted(f"{self.path}/rows/{r['_file']}" for r in self.bounds.where(hit).select("_file").collect())

    def rows(self, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
        """All rows of these files."""
        files = self.files(low, high)
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def box_search(self, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
        """:func:`epsilon.box_search` of a table of boxes."""
        return box_search(self.rows(low, high), list(low), list(high))

    def range_query(self, lon: float, lat: float, eps_m: float) -> DataFrame:
        """:func:`epsilon.range_query` of a table of places."""
        angle = math.degrees(eps_m / RADIUS_M) * (1 + 1e-9) + 1e-9
        top = max(abs(lat - angle), abs(lat + angle))
        sine = math.sin(min(math.radians(angle), math.pi / 2)) / max(math.cos(math.radians(min(top, 90.0))), 1e-12)
        half = math.degrees(math.asin(sine)) + 1e-9 if sine < 1 and top < 90 else 360.0
        west, east = (lon - half, lon + half) if -180 <= lon - half and lon + half <= 180 else (-360.0, 360.0)
        return range_query(self.rows((west, lat - angle), (east, lat + angle)), lon, lat, eps_m)


def nearest_of_many(rects: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """``query, id, gap``: for each box of *queries* (``query, min0, min1, max0, max1``) what :func:`epsilon.nearest` finds among *rects* (``id, min0, ...``).

    Boxes are kept in cells of powers of two that are as wide as they are, at least.  A round looks for
    boxes up to a distance, in cells no smaller than that, so a query looks into few cells of each size; it is done when
    it has *n* boxes within the distance, else the distance doubles.  A cell hands on the best *n* for each query.  Boxes with a null or an upside-down side are left out.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    spark = rects.sparkSession
    sides = SIDES
    whole = F.expr(" AND ".join(f"{s} IS NOT NULL AND NOT isnan({s})" for s in sides) + " AND min0 <= max0 AND min1 <= max1")
    boxes = rects.where(whole).select("id", *(F.col(s).cast("double").alias(s) for s in sides))
    asked = queries.where(whole).select("query", *(F.col(s).cast("double").alias(f"q_{s}") for s in sides))
    out = spark.createDataFrame([], "query bigint, id bigint, gap double").select(F.col("query").cast(asked.schema["query"].dataType), F.col("id").cast(boxes.schema["id"].dataType), "gap")
    ends = boxes.agg(*(F.min(s).alias(f"low_{s}") for s in sides), *(F.max(s).alias(f"high_{s}") for s in sides), F.count("*").alias("n")).first()
    around = asked.agg(*(f(f"q_{s}").alias(f"{k}_{s}") for s in sides for k, f in (("low", F.min), ("high", F.max)))).first()
    if not ends["n"] or around["low_min0"] is None:
        return out
    span = max(max(ends[f"high_max{k}"], around[f"high_max{k}"]) - min(ends[f"low_min{k}"], around[f"low_min{k}"]) for k in (0, 1))
    # the first distance: where as many boxes as asked for would be, if they lay evenly
    level = math.floor(math.log2(max(span * math.sqrt(n / ends["n"]), span * 2.0**-30, 1e-12)))
    last = math.ceil(math.log2(max(span, 1e-12))) + 1
    wide = F.greatest(F.col("max0") - F.col("min0"), F.col("max1") - F.col("min1"))
    sized = written(boxes.withColumn("own", F.when(wide > 0, F.ceil(F.log2(wide))).otherwise(-1100).cast("int")))
    extent = F.greatest(F.col("q_max0") - F.col("q_min0"), F.col("q_max1") - F.col("q_min1"))
    left = written(asked.withColumn("from", F.when(extent > 0, F.ceil(F.log2(extent))).otherwise(-1100).cast("int")))
    while True:
        reach = 2.0**level
        kept = sized.withColumn("size", F.greatest(F.col("own"), F.lit(level)))
        sizes = [r["size"] for r in kept.select("size").distinct().collect()]  # powers of two, a few tens
        kept = kept.withColumns({f"c{k}": F.floor(F.col(f"min{k}") / F.pow(F.lit(2.0), "size")).cast("bigint") for k in (0, 1)})
        # a box of a cell begins in it, and ends at most one cell on; long queries wait until cells are as long
        now = left.where(F.col("from") <= level) if level < last else left
        cells = now.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes))))
        for k in (0, 1):
            unit = F.pow(F.lit(2.0), "size")
            cells = cells.withColumn(f"c{k}", F.explode(F.sequence(F.floor((F.col(f"q_min{k}") - reach) / unit).cast("bigint") - 1, F.floor((F.col(f"q_max{k}") + reach) / unit).cast("bigint"))))
        key = ["size", "c0", "c1"]
        met = cells.groupBy(*key).cogroup(kept.groupBy(*key)).applyInArrow(_nearest_of_cell(n, reach if level < last else math.inf), out.schema)
        order = Window.partitionBy("query").orderBy("gap", "id")
        best = written(met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n))
        # who has as many as asked for has them all within the distance
        done = best.select("query").distinct() if level >= last else best.where(F.col("k") == n).select("query")
        out = out.unionByName(best.join(done, "query", "left_semi").select("query", "id", "gap"))
        left = written(left.join(done, "query", "left_anti"))
        if level >= last or left.isEmpty():
            return out
        level += 1


def _nearest_of_cell(n: int, reach: float):
    """The best *n* boxes of a cell for each of the queries that look into it, so that pairs of a dense cell aren't rows of a table."""

    def run(asked: pa.Table, boxes: pa.Table) -> pa.Table:
        boxes = boxes.sort_by("id")
        mine = {f"q_{s}": asked.column(f"q_{s}").to_numpy() for s in SIDES} if len(asked) else {}
        theirs = {s: boxes.column(s).to_numpy() for s in SIDES} if len(boxes) else {}
        rows, columns, gaps = [], [], []
        step, most = max(1, PAIRS // max(1, len(boxes))), min(n, len(boxes))
        for lo in range(0, len(asked) if theirs else 0, step):
            gap = np.zeros((min(step, len(asked) - lo), len(boxes)))
            for k in "01":
                low, high = (mine[f"q_{m}{k}"][lo : lo + step, None] for m in ("min", "max"))
                side = np.maximum(np.maximum(low - theirs[f"max{k}"], theirs[f"min{k}"] - high), 0.0)
                gap += side * side
            last = np.partition(gap, most - 1, axis=1)[:, most - 1, None]
            less, tied = gap < last, gap == last
            # of those that tie with the last, the smallest ids
            keep = (less | (tied & (np.cumsum(tied, axis=1) <= most - less.sum(1)[:, None]))) & (gap <= reach * reach)
            row, column = np.nonzero(keep)
            rows.append(row + lo)
            columns.append(column)
            gaps.append(gap[row, column])
        if not rows:
            return pa.table({"query": pa.nulls(0, asked.schema.field("query").type), "id": pa.nulls(0, boxes.schema.field("id").type), "gap": pa.nulls(0, pa.float64())})
        return pa.table({"query": asked.column("query").take(np.concatenate(rows)), "id": boxes.column("id").take(np.concatenate(columns)), "gap": np.concatenate(gaps)})

    return run
