"""Top-k objects by shared columns: ``2 dot / (delta_q + delta_x)``, best first, ties to the larger id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.geo import pair_score
from waymesh.sources.shared import written

from .matrix import deltas as deltas_of


def _long(matrix: DataFrame) -> DataFrame:
    """``i, c, m`` of a plain or an extended matrix."""
    return matrix if "c" in matrix.columns else matrix.select("i", F.col("j").alias("c"), F.col("v").alias("m"))


def _scored(dots: DataFrame, deltas: DataFrame) -> DataFrame:
    """``query, node, score`` from ``query, node, dot``; only the objects of *dots* need a delta."""
    q = deltas.select(F.col("i").alias("query"), F.col("delta").alias("delta_q"))
    x = deltas.select(F.col("i").alias("node"), F.col("delta").alias("delta_x"))
    joined = dots.join(q, "query").join(x, "node")
    return joined.select("query", "node", _score(F.col("dot"), F.col("delta_q"), F.col("delta_x")).alias("score"))


def _score(dot: Column, delta_q: Column, delta_x: Column) -> Column:
    return (F.lit(2.0) * dot / (delta_q + delta_x)).cast("double")


#: Up to so many queries are asked for by value, which reaches the scans below the matrix, and up to so many have a column each.
BY_VALUE, SIDE_BY_SIDE = 1000, 32


def scores(matrix: DataFrame, queries: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """``query, node, score`` of every object that shares a column with a query (*queries*: ``query``).

    Only the queries' rows meet the matrix; all pairs of objects are never formed.  Without *deltas*, and for
    a few queries, the matrix is gone through once: each entry counts towards its row's delta and towards
    the dot product with each query.
    """
    m = _long(matrix)
    asked = queries.select(F.col("query").alias("i")).distinct()
    ids = sorted(r["i"] for r in asked.limit(BY_VALUE + 1).collect() if r["i"] is not None)
    rows = m.where(F.col("i").isin(ids)) if len(ids) <= BY_VALUE else m.join(asked, "i", "left_semi")
    rows = rows.select(F.col("i").alias("query"), "c", F.col("m").alias("q"))
    if deltas is not None or not 0 < len(ids) <= SIDE_BY_SIDE:
        dots = rows.join(m.select(F.col("i").alias("node"), "c", "m"), "c").groupBy("query", "node").agg(F.sum(F.col("q") * F.col("m")).alias("dot"))
        return _scored(dots, deltas_of(m) if deltas is None else deltas)
    of_column = rows.groupBy(F.col("c").alias("at")).agg(*(F.max(F.when(F.col("query") == q, F.col("q"))).alias(f"q{k}") for k, q in enumerate(ids)))
    met = m.join(of_column, m["c"] == of_column["at"], "left")
    of_node = met.groupBy(F.col("i").alias("node")).agg(F.sum(F.col("m") * F.col("m")).alias("delta_x"), *(F.sum(F.col("m") * F.col(f"q{k}")).alias(f"q{k}") for k in range(len(ids))))
    of_query = rows.groupBy("query").agg(F.sum(F.col("q") * F.col("q")).alias("delta_q"))
    return _of_columns(of_node, of_query, ids)


def _of_columns(of_node: DataFrame, of_query: DataFrame, ids: list[int]) -> DataFrame:
    """``query, node, score`` of ``node, delta_x, q0, q1, ...`` (a dot product with each query, or null) and ``query, delta_q``."""
    each = F.explode(F.array(*(F.struct(F.lit(q).cast("bigint").alias("query"), F.col(f"q{k}").alias("dot")) for k, q in enumerate(ids))))
    found = of_node.select("node", "delta_x", each.alias("f")).select("node", "delta_x", "f.query", "f.dot").where("dot IS NOT NULL")
    return found.join(of_query, "query").select("query", "node", _score(F.col("dot"), F.col("delta_q"), F.col("delta_x")).alias("score"))


def few(queries: DataFrame) -> list[int]:
    """The ids of *queries* if they may have a column each, otherwise none."""
    ids = sorted(r["query"] for r in queries.select("query").distinct().limit(SIDE_BY_SIDE + 2).collect() if r["query"] is not None)
    return ids if len(ids) <= SIDE_BY_SIDE else []


def side_by_side(rows: DataFrame, ids: list[int]) -> DataFrame:
    """``query, node, score`` from ``i, delta, q0, q1, ...``: each row's delta and its dot product with each query, null where they share nothing."""
    of_node = rows.select(F.col("i").alias("node"), F.col("delta").alias("delta_x"), *(f"q{k}" for k in range(len(ids))))
    return _of_columns(of_node, rows.where(F.col("i").isin(ids)).select(F.col("i").alias("query"), F.col("delta").alias("delta_q")), ids)


def checked(k: int) -> None:
    if k < 1:
        raise ValueError("k is at least 1")


def top_k(matrix: DataFrame, query: int, k: int, deltas: DataFrame | None = None) -> DataFrame:
    """``node, score, rank`` of the best *k*; the query is one of its own candidates. An empty row has no result."""
    checked(k)
    one = matrix.sparkSession.createDataFrame([(query,)], "query bigint")
    best = scores(matrix, one, deltas).select("node", "score").orderBy(F.desc("score"), F.desc("node")).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("node"))).cast("bigint"))


def ranked(found: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1 within each query."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("node"))
    return found.withColumn("rank", F.row_number().over(order).cast("bigint"))


def top_k_batch(matrix: DataFrame, queries: DataFrame, k: int, deltas: DataFrame | None = None) -> DataFrame:
    """``query, node, score, rank`` of the best *k* for each query."""
    checked(k)
    return ranked(scores(matrix, queries, deltas)).where(F.col("rank") <= k)


#: Entries of a block of rows, about (a row is never split), and queries that are scored together.
BLOCK, TOGETHER = 1 << 18, 256
#: Rows that are added up at once for the queries that are scored together.
BESIDE = 512

_ROWS = "i binary, first binary, delta binary, at binary, row binary, m binary"


def top_k_all(matrix: DataFrame, k: int) -> DataFrame:
    """:func:`top_k_batch` with every row as a query, but no pair of rows is a row of a table.

    Rows are put into blocks by ranges of ids and packed.  A task has a block's queries, and goes through those
    blocks that share a column with it, one at a time, its own first; only each query's best *k* leave it.
    """
    checked(k)
    m = _long(matrix)
    kind, whole = matrix.schema["i"].dataType, m.schema["m"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    m = written(m.where("i IS NOT NULL"))
    if m.schema["c"].dataType.simpleString() not in ("bigint", "int"):
        numbers = written(m.select("c").distinct().withColumn("number", F.monotonically_increasing_id()))
        m = written(m.join(numbers, "c", "left").select("i", F.col("number").alias("c"), "m"))
    entries = m.select(F.col("i").cast("bigint").alias("i"), F.col("c").cast("bigint").alias("c"), F.col("m").cast("double").alias("m"))
    n = max(1, -(-entries.count() // BLOCK))
    # a range of ids has its rows whole
    blocks = entries.repartitionByRange(n, "i").mapInArrow(_packed_blocks(whole), f"columns binary, {_ROWS}")
    packed = written(blocks.withColumn("block", F.spark_partition_id()))
    columns = written(packed.select("block", "columns").mapInArrow(_columns_of, "block int, c long"))
    meets = columns.withColumnRenamed("block", "x").join(columns, "c").select("x", "block").distinct()
    # a task has one block's queries, whatever a shuffle's parts weigh
    pairs = meets.join(packed.drop("columns"), "block").repartition(n, "x")
    found = pairs.groupBy("x").applyInArrow(_best_of_blocks(k), "query long, node long, score double, rank long")
    return found.select(F.col("query").cast(kind).alias("query"), F.col("node").cast(kind).alias("node"), "score", "rank")


def _packed_blocks(whole: bool):
    def run(batches):
        some = [b for b in batches if b.num_rows]
        if some:
            t = _packed_rows(pa.Table.from_batches(some), whole)
            if t is not None:
                yield from t.to_batches()

    return run


def _columns_of(batches):
    import zstandard

    for b in batches:
        for block, columns in zip(b.column("block").to_pylist(), b.column("columns").to_pylist(), strict=True):
            c = np.frombuffer(zstandard.decompress(columns), np.int64)
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(c), block, np.int32)), "c": pa.array(c)})


def _packed_rows(table: pa.Table, whole: bool) -> pa.Table | None:
    """A block as one row: its ids of a delta above 0, how many entries each has, and their deltas; then entries by column."""
    import zstandard

    i, known = table.column("i").to_numpy(), table.column("c").is_valid().to_numpy()
    c, m = (pc.fill_null(table.column(x), 0).to_numpy() for x in ("c", "m"))
    ids, row = np.unique(i, return_inverse=True)
    delta = np.bincount(row, m * m, len(ids))
    if whole and delta.max(initial=0) >= 2.0**63:
        raise OverflowError("a row's sum of squares is beyond 64 bits")
    keep, known = delta > 0, known & table.column("m").is_valid().to_numpy()
    some = known & keep[row]
    row, c, m = (np.cumsum(keep) - 1)[row[some]], c[some], m[some]
    ids, delta = ids[keep], delta[keep]
    if not len(ids):
        return None
    order = np.lexsort((row, c))
    parts = {"columns": np.unique(c), "i": ids, "first": np.bincount(row, minlength=len(ids)).astype(np.int64), "delta": delta, "at": c[order], "row": row[order].astype(np.int32), "m": m[order]}
    return pa.table({x: pa.array([zstandard.compress(v.tobytes(), 1)], pa.binary()) for x, v in parts.items()})


def _unpacked_rows(table: pa.Table, row: int) -> dict[str, np.ndarray]:
    import zstandard

    kinds = {"i": np.int64, "first": np.int64, "delta": np.float64, "at": np.int64, "row": np.int32, "m": np.float64}
    return {c: np.frombuffer(zstandard.decompress(table.column(c)[row].as_py()), kind) for c, kind in kinds.items()}


def _best_of_blocks(k: int):
    def dots(q: np.ndarray, c: np.ndarray, v: np.ndarray, size: int, other: dict, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For *size* queries and all rows of a block the dot products, and which of them share a column."""
        slot = np.minimum(np.searchsorted(other["at"][first], c), len(first) - 1)
        met = np.flatnonzero(other["at"][first][slot] == c)
        begin, length = first[slot[met]], (ends - first)[slot[met]]
        which = np.repeat(met, length)
        entry = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        width = len(other["i"])
        cell = q[which] * width + other["row"][entry]
        dot = np.bincount(cell, v[which] * other["m"][entry], size * width)
        shared = dot > 0 if (v > 0).all() and (other["m"] > 0).all() else np.bincount(cell, minlength=size * width) > 0
        return dot.reshape(size, width), shared.reshape(size, width)

    def merged(best: list[np.ndarray], least: np.ndarray, more: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The best *k* of each query of a group, and in *least* the last one's score."""
        rank, rows = _ranked([np.concatenate([old, *(m[at] for m in more)]) for at, old in enumerate(best)])
        last = rank == k
        least[rows[0][last]] = rows[2][last]
        return [x[rank <= k] for x in rows]

    def beside(q: np.ndarray, c: np.ndarray, v: np.ndarray, own: np.ndarray, other: tuple, best: list[np.ndarray], least: np.ndarray) -> list[np.ndarray]:
        """*best* with a block's rows, where values are positive whole numbers: queries lie side by side at each column, and rows add up what is at theirs."""
        columns, ids, delta, entry, heaviest = other
        spread = np.zeros((len(columns), len(own)), np.int64)
        slot = np.minimum(np.searchsorted(columns, c), len(columns) - 1)
        there = columns[slot] == c
        spread[slot[there], q[there]] = v[there]
        spread = spread.astype(np.uint16 if int(spread.max(initial=0)) * heaviest < 1 << 16 else np.float32)
        out, part = (np.empty((min(len(ids), BESIDE), len(own)), spread.dtype) for _ in range(2))
        more, waiting = [], 0
        for lo in range(0, len(ids), BESIDE):
            size = len(ids[lo : lo + BESIDE])
            out[:size] = 0
            for at in entry:
                at, by = at[0][lo : lo + BESIDE], None if at[1] is None else at[1][lo : lo + BESIDE]
                if not len(at):
                    break
                here, sums = part[: len(at)], out[: len(at)]
                np.take(spread, at, axis=0, out=here, mode="clip")
                if by is not None:
                    here *= by[:, None].astype(spread.dtype)
                np.add(sums, here, out=sums)
            ends, dot = delta[lo : lo + size], out[:size]
            if np.isneginf(least).any() and size > k:
                score = np.where(dot > 0, 2.0 * dot / (own + ends[:, None]), -np.inf)
                bound = np.maximum(least, np.partition(score, size - k, axis=0)[size - k])
            else:
                bound = least
            # no row of these reaches the bound with less
            enough = np.clip(np.ceil(bound * (own + ends.min()) / 2 * (1 - 1e-9)), 1, np.iinfo(np.uint16).max if spread.dtype == np.uint16 else None)
            x, y = np.divmod(np.flatnonzero(dot >= enough.astype(spread.dtype)), len(own))
            score = 2.0 * dot[x, y].astype(np.float64) / (own[y] + ends[x])
            some = score >= bound[y]
            more.append([y[some], ids[lo + x[some]], score[some]])
            waiting += int(some.sum())
            if not lo or waiting > 4 * k * len(own):
                best, more, waiting = merged(best, least, more), [], 0
        return merged(best, least, more) if more else best

    def laid(other: dict) -> tuple | None:
        """A block's columns, rows of most entries first, and the first, second and further entry of each, if values are positive whole numbers that add up in few bits."""
        m = other["m"]
        if not (len(m) and (m > 0).all() and (m == np.rint(m)).all()):
            return None
        sums = np.bincount(other["row"], m, len(other["i"]))
        if sums.max() * m.max() >= 1 << 24:
            return None
        columns, at = np.unique(other["at"], return_inverse=True)
        by_row = np.argsort(other["row"], kind="stable")
        at, m, size, few = at[by_row], m[by_row].astype(np.int64), other["first"], m.sum() <= 2 * len(m)
        if few:  # an entry of value 2 is two entries
            at, size = np.repeat(at, m), sums.astype(np.int64)
        begin, order, entry = np.cumsum(size) - size, np.argsort(-size, kind="stable"), []
        for e in range(int(size.max())):
            here = begin[order[: np.searchsorted(-size[order], -e, "left")]] + e
            entry.append((at[here], None if few else m[here]))
        return columns, other["i"][order], other["delta"][order], entry, int(sums.max())

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = table.column("block").to_pylist()
        mine = block.index(key[0].as_py())
        own = _unpacked_rows(table, mine)
        # queries' entries by row
        order = np.argsort(own["row"], kind="stable")
        row, c, v = own["row"][order].astype(np.int64), own["at"][order], own["m"][order]
        begin = np.concatenate([[0], np.cumsum(own["first"])])
        size = len(own["i"])
        groups = range(0, size, TOGETHER)
        best = {lo: [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] for lo in groups}
        least = np.full(size, -np.inf)
        many = np.bincount(np.unique(c, return_inverse=True)[1]) if len(c) else np.zeros(0, np.int64)
        plain = len(v) and (v > 0).all() and (v == np.rint(v)).all()
        # queries' own block first: it is likely to have what bounds the others
        for at in sorted(range(len(table)), key=lambda at: at != mine):
            other = _unpacked_rows(table, at)
            first = np.flatnonzero(np.concatenate([[True], other["at"][1:] != other["at"][:-1]]))
            ends = np.append(first[1:], len(other["at"]))
            slot = np.searchsorted(other["at"][first], np.unique(c))
            met = np.minimum(slot, len(first) - 1)
            terms = int((many * (ends - first)[met] * (other["at"][first][met] == np.unique(c))).sum())
            # a term costs as much as about a hundred entries side by side
            rows = laid(other) if plain and terms * 100 > len(other["at"]) * size else None
            if rows is not None and float(v.max()) * rows[4] >= 1 << 24:
                rows = None
            for lo in groups:
                hi = min(lo + TOGETHER, size)
                some = slice(begin[lo], begin[hi])
                if rows is not None:
                    best[lo] = beside(row[some] - lo, c[some], v[some], own["delta"][lo:hi], rows, best[lo], least[lo:hi])
                    continue
                dot, shared = dots(row[some] - lo, c[some], v[some], hi - lo, other, first, ends)
                score = 2.0 * dot / (own["delta"][lo:hi, None] + other["delta"])
                score[~shared] = -np.inf
                bound = least[lo:hi]
                if score.shape[1] > k:
                    bound = np.maximum(bound, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]) if (bound == -np.inf).any() else bound
                q, x = np.nonzero(shared & (score >= bound[:, None]))
                best[lo] = merged(best[lo], least[lo:hi], [[q, other["i"][x], score[q, x]]])
        rank, found = _ranked([np.concatenate([best[lo][at] + (lo if not at else 0) for lo in groups]) for at in range(3)])
        return pa.table({"query": own["i"][found[0]], "node": found[1], "score": found[2], "rank": rank})

    return run


def _ranked(rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Queries, nodes and scores in order, and ranks from 1 within each query, ties to the larger id."""
    query, node, score = rows
    order = np.lexsort((-node, -score, query))
    query = query[order]
    new = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    rank = np.arange(len(query)) - first[np.cumsum(new) - 1] + 1 if len(query) else np.zeros(0, np.int64)
    return rank, [query, node[order], score[order]]


def without_query(found: DataFrame) -> DataFrame:
    """Results other than the query itself."""
    return found.where(F.col("node") != F.col("query"))


def candidates(matrix: DataFrame, query: int) -> DataFrame:
    """``i`` of every object that shares a column with *query*."""
    m = _long(matrix)
    return m.join(m.where(F.col("i") == query).select("c").distinct(), "c", "left_semi").select("i").distinct()


def kernel_deltas(left: DataFrame, kernel: DataFrame) -> DataFrame:
    """``i, delta`` through the place kernel; equal to the deltas of the extended matrix."""
    spread = left.join(kernel, left["j"] == kernel["a"]).groupBy("i", "b").agg(F.sum(F.col("v") * F.col("k")).alias("s"))
    own = left.select(F.col("i").alias("at"), F.col("j").alias("to"), F.col("v").alias("own"))
    met = spread.join(own, (F.col("i") == F.col("at")) & (F.col("b") == F.col("to")))
    return met.groupBy("i").agg(F.sum(F.col("own") * F.col("s")).alias("delta"))


def kernel_top_k(left: DataFrame, kernel: DataFrame, queries: DataFrame, k: int, deltas: DataFrame | None = None) -> DataFrame:
    """:func:`top_k_batch` of the extended matrix, without building it."""
    checked(k)
    deltas = kernel_deltas(left, kernel) if deltas is None else deltas
    rows = left.join(queries.select(F.col("query").alias("i")).distinct(), "i")
    spread = rows.join(kernel, rows["j"] == kernel["a"]).groupBy(F.col("i").alias("query"), F.col("b").alias("j")).agg(F.sum(F.col("v") * F.col("k")).alias("s"))
    dots = spread.join(left.select(F.col("i").alias("node"), "j", "v"), "j").groupBy("query", "node").agg(F.sum(F.col("s") * F.col("v")).alias("dot"))
    return ranked(_scored(dots, deltas)).where(F.col("rank") <= k)


def rank_position(found: DataFrame, query: int, node: int) -> DataFrame:
    """``query, node, rank``: the place of *node* in a query's results, -1 if it isn't there."""
    spark = found.sparkSession
    asked = spark.createDataFrame([(query, node)], "query bigint, node bigint")
    order = found if "rank" in found.columns else ranked(found)
    return asked.join(order, ["query", "node"], "left").select("query", "node", F.coalesce("rank", F.lit(-1)).cast("bigint").alias("rank"))


def pair_report(plain: DataFrame, spatial: DataFrame, a: int, b: int, k: int, best: DataFrame | None = None) -> DataFrame:
    """``measure, value``: dot, deltas and score of two objects in two matrices, and the place of *b* among the best *k* of *a*.

    With *best*, the best *k* of *a* in the spatial matrix, only its rows *a* and *b* need to be there.
    """
    parts = []
    for name, matrix, ranks in (("plain", plain, None), ("spatial", spatial, best)):
        m = _long(matrix)
        sums = m.where(F.col("i").isin(a, b)).groupBy("c").agg(F.coalesce(F.sum(F.when(F.col("i") == a, F.col("m"))), F.lit(0)).alias("x"), F.coalesce(F.sum(F.when(F.col("i") == b, F.col("m"))), F.lit(0)).alias("y"))
        totals = sums.agg(*(F.coalesce(F.sum(F.col(p) * F.col(q)), F.lit(0)).cast("double").alias(n) for p, q, n in (("x", "y", "dot"), ("x", "x", "delta_a"), ("y", "y", "delta_b"))))
        totals = totals.withColumn("score", pair_score(F.col("dot"), F.col("delta_a"), F.col("delta_b")))
        parts.append(totals.select(F.explode(F.array(*(F.struct(F.lit(f"{name}_{c}").alias("measure"), F.col(c).alias("value")) for c in totals.columns))).alias("s")).select("s.*"))
        one = m.sparkSession.createDataFrame([(a,)], "query bigint")
        place = rank_position(top_k_batch(m, one, k) if ranks is None else ranks, a, b)
        parts.append(place.select(F.lit(f"{name}_rank").alias("measure"), F.col("rank").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
