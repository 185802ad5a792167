"""Sparse matrices as long tables ``i, j, v``: counts along edges and paths, their row sums of squares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.metapath import Step, parse_path
from waymesh.sources.model import Graph
from waymesh.sources.shared import written


def adjacency(graph: Graph, edge_type: str, inverse: bool = False) -> DataFrame:
    """``i, j, v`` over local ids: the number of edges of a type between two nodes; repeated edges add."""
    number, kind = graph.edge(edge_type)
    ids = graph.numbered()
    ends = [ids.where(F.col("type_id") == graph.type_id(t)).select(F.col("node_id").alias(n), F.col("local_id").alias(c)) for t, n, c in ((kind.source, "src", "i"), (kind.target, "dst", "j"))]
    # repeated edges are counted before ids are looked up
    counted = graph.edges.where(F.col("etype_id") == number).groupBy("src", "dst").agg(F.count("*").alias("v"))
    found = counted.join(ends[0], "src").join(ends[1], "dst").select("i", "j", "v")
    return transpose(found) if inverse else found


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def terms(left: DataFrame, right: DataFrame) -> DataFrame:
    """``i, j, v`` of each path of two entries: the matrix product before terms of the same ends are added."""
    right = right.select(F.col("i").alias("k"), F.col("j").alias("to"), F.col("v").alias("by"))
    return left.join(right, left["j"] == right["k"]).select("i", F.col("to").alias("j"), (F.col("v") * F.col("by")).alias("v"))


def added(terms: DataFrame) -> DataFrame:
    """Terms of the same ends as one entry; integer overflow is an error."""
    return terms.groupBy("i", "j").agg(F.sum("v").alias("v"))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """``i, j, v`` of the matrix product; integer overflow is an error."""
    return added(terms(left, right))


#: Logarithm of the registers of a sketch: estimates are within about a tenth.
SKETCH = 7


def _reaches(matrices: list[DataFrame]) -> list[DataFrame]:
    """For the first matrix, the first two and so on: ``at, n``, about how many ends each row of their product has."""
    out = []
    for last in range(len(matrices)):
        sketch = matrices[last].groupBy(F.col("i").alias("at")).agg(F.hll_sketch_agg("j", SKETCH).alias("s"))
        for m in reversed(matrices[:last]):
            through = m.select("i", F.col("j").alias("by")).join(sketch, F.col("by") == F.col("at"))
            sketch = through.groupBy(F.col("i").alias("of")).agg(F.hll_union_agg("s").alias("s")).withColumnRenamed("of", "at")
        out.append(sketch.select("at", F.hll_sketch_estimate("s").alias("n")))
    return out


def chain_order(matrices: list[DataFrame]) -> tuple:
    """How to multiply a chain with the least terms: nested pairs of numbers of *matrices*.

    A product has a term for each path of two entries through a node between them.  How many entries the
    runs before and after a node have there is known from sketches of the ends that it reaches, so sizes are
    estimates, and the cheapest nesting of estimated terms is found as for matrices of known dimensions.
    """
    n = len(matrices)
    terms: dict[tuple[int, int, int], float] = {}
    for m in range(n - 1):
        # at the node between m and m + 1: entries of the runs a..m there, and of the runs m + 1..b
        runs = [(f"a{m - k}", x) for k, x in enumerate(_reaches([transpose(x) for x in reversed(matrices[: m + 1])]))]
        runs += [(f"b{m + 1 + k}", x) for k, x in enumerate(_reaches(matrices[m + 1 :]))]
        joined, names = None, [name for name, _ in runs]
        for name, found in runs:
            part = found.select("at", F.col("n").cast("double").alias(name))
            joined = part if joined is None else joined.join(part, "at", "full_outer")
        pairs = [(x, y) for x in names if x[0] == "a" for y in names if y[0] == "b"]
        sums = joined.agg(*(F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)).alias(f"{x}_{y}") for x, y in pairs)).first()
        terms |= {(int(x[1:]), m, int(y[1:])): sums[f"{x}_{y}"] for x, y in pairs}
    best: dict[tuple[int, int], tuple[float, object]] = {(k, k): (0.0, k) for k in range(n)}
    for width in range(1, n):
        for a in range(n - width):
            b = a + width
            best[a, b] = min(((best[a, m][0] + best[m + 1, b][0] + terms[a, m, b], (best[a, m][1], best[m + 1, b][1])) for m in range(a, b)), key=lambda x: x[0])
    return best[0, n - 1][1]


def chain(matrices: list[DataFrame]) -> DataFrame:
    """The product of several matrices; of three and more, in the order of the least terms."""
    if len(matrices) <= 2:
        return matrices[0] if len(matrices) == 1 else product(*matrices)
    matrices = [written(m) for m in matrices]

    def multiplied(order) -> DataFrame:
        return matrices[order] if isinstance(order, int) else product(multiplied(order[0]), multiplied(order[1]))

    return multiplied(chain_order(matrices))


def compose(graph: Graph, meta_path: str | list[Step], by: str = "edge_type") -> DataFrame:
    """Path counts between the ends of a meta path."""
    steps = parse_path(meta_path, graph.edge_types, by) if isinstance(meta_path, str) else meta_path
    return chain([adjacency(graph, s.edge, s.inverse) for s in steps])


def deltas(matrix: DataFrame) -> DataFrame:
    """``i, delta``: the sum of squares of each non-empty row."""
    value = "m" if "m" in matrix.columns else "v"
    return matrix.groupBy("i").agg(F.sum(F.col(value) * F.col(value)).alias("delta"))


def dense_deltas(found: DataFrame, rows: DataFrame) -> DataFrame:
    """A delta for each row of *rows* (``i``), 0 for empty ones."""
    return rows.join(found, "i", "left").select("i", F.coalesce("delta", F.lit(0)).alias("delta"))


def row_stats(matrix: DataFrame) -> DataFrame:
    """``i, entries, total`` of each non-empty row."""
    value = "m" if "m" in matrix.columns else "v"
    return matrix.groupBy("i").agg(F.count("*").alias("entries"), F.sum(value).alias("total"))


def neighbor_counts(direct: DataFrame, spatial: DataFrame, rows: DataFrame) -> DataFrame:
    """``i, direct, spatial``: entries of each row of *rows* (``i``) in two matrices, in ascending order of all three.

    A table with a column ``entries`` (as of :func:`row_stats`) has been counted already.
    """
    counts = [m.select("i", F.col("entries").alias(name)) if "entries" in m.columns else m.groupBy("i").agg(F.count("*").alias(name)) for m, name in ((direct, "direct"), (spatial, "spatial"))]
    joined = rows.join(counts[0], "i", "left").join(counts[1], "i", "left")
    return joined.select("i", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "spatial"))).orderBy("direct", "spatial", "i")
