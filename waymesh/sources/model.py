"""The graph: typed nodes, typed edges, and places with coordinates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.metapath import EdgeType

from .shared import written

NODES = "node_id bigint, type_id int"
EDGES = "src bigint, etype_id int, dst bigint"
COORDINATES = "id bigint, lon double, lat double"


def numbered(rows: DataFrame, order: list[str], group: list[str] | None = None, name: str = "number") -> DataFrame:
    """*rows* and their places from 0 by *order*, within each *group*.

    Rows are sorted in ranges of about equal counts, numbered within and shifted by the counts of the ranges
    before, so no task gets a whole group.  The ranges' bounds come from a sample, so they are dealt once and
    written: evaluated twice, a row could be counted in one range and numbered in another.
    """
    group = group or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select(*group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(shift, [*group, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def local_ids(nodes: DataFrame) -> DataFrame:
    """``node_id, type_id, local_id``: nodes of a type numbered from 0 in the order of their ids."""
    return numbered(nodes.select("node_id", "type_id"), ["node_id"], ["type_id"], "local_id")


@dataclass
class Graph:
    """``nodes`` (node_id, type_id), ``edges`` (src, etype_id, dst: global ids), names in the order of their ids, and coordinates (local ids) by place type."""

    nodes: DataFrame
    edges: DataFrame
    node_types: list[str]
    edge_types: list[EdgeType]
    coordinates: dict[str, DataFrame] = field(default_factory=dict)
    #: ``name, local, global`` of each node type, where nodes were made from names.
    names: dict[str, DataFrame] = field(default_factory=dict)
    _numbered: DataFrame | None = field(default=None, init=False, repr=False, compare=False)

    def type_id(self, name: str) -> int:
        return self.node_types.index(name)

    def edge(self, name: str) -> tuple[int, EdgeType]:
        for n, e in enumerate(self.edge_types):
            if e.name == name:
                return n, e
        raise ValueError(f"unknown edge type {name!r}")

    def numbered(self) -> DataFrame:
        """:func:`local_ids` of the nodes, written once for all who ask."""
        if self._numbered is None:
            self._numbered = local_ids(self.nodes)
        return self._numbered

    def count_of(self, name: str) -> int:
        return self.nodes.where(F.col("type_id") == self.type_id(name)).count()

    def histogram(self) -> DataFrame:
        """``type_id, n``."""
        return self.nodes.groupBy("type_id").agg(F.count("*").alias("n"))

    def type_of(self, node_id: int) -> str:
        found = self.nodes.where(F.col("node_id") == node_id).first()
        if found is None:
            raise ValueError(f"no node {node_id}")
        return self.node_types[found["type_id"]]

    def local_id(self, node_id: int, expected: str | None = None) -> int:
        """A node's number within its type; an error if it isn't of the *expected* type."""
        kind = self.type_of(node_id)
        if expected is not None and kind != expected:
            raise ValueError(f"node {node_id} is a {kind}, not a {expected}")
        return self.nodes.where((F.col("type_id") == self.type_id(kind)) & (F.col("node_id") < node_id)).count()

    def misplaced_edges(self) -> DataFrame:
        """Edges whose ends aren't of the types that the schema names, or don't exist."""
        ends = [(n, self.type_id(e.source), self.type_id(e.target)) for n, e in enumerate(self.edge_types)]
        schema = self.nodes.sparkSession.createDataFrame(ends, "etype_id int, want_src int, want_dst int")
        kinds = [self.nodes.select(F.col("node_id").alias(x), F.col("type_id").alias(f"{x}_type")) for x in ("src", "dst")]
        typed = self.edges.join(schema, "etype_id", "left").join(kinds[0], "src", "left").join(kinds[1], "dst", "left")
        wrong = ~(F.col("src_type").eqNullSafe(F.col("want_src")) & F.col("dst_type").eqNullSafe(F.col("want_dst")))
        return typed.where(wrong | F.col("want_src").isNull()).select("src", "etype_id", "dst")
