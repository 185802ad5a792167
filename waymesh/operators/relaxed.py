"""What a relaxed matrix (:mod:`.spatial`) would give, without forming it.

An extended matrix has an entry for each place near each entry of *left*, so it grows with the square of how densely
places lie.  Its rows' sizes, sums and deltas follow from sums of each place (how many columns it is in, and what
it has there) and from those places of the same row that share a column.  Rows are dealt to buckets of about as many
entries, and within a bucket pairs are found among places sorted by latitude.  Entries travel as ``i, j, v`` alone; what
is known of places comes to each bucket in packed pieces, once and not with each of its entries.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import RADIUS_M, half_edge_weight
from waymesh.sources.shared import written

from . import similarity, spatial

#: Entries of *left* in a bucket, or of a larger bucket those that are added up at once, about; a row is never split.
ENTRIES = 1 << 18
#: Entries of a bucket that gets all places, about: if there are up to half as many, so that copies don't outnumber entries of large tables. Places of a packed piece.
WHOLE, PIECE = 1 << 20, 1 << 13
#: Pairs that are measured at once.
PAIRS = 1 << 20


def _haversine_m(lon: np.ndarray, lat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    half_lat, half_lon = np.radians(lat[b] - lat[a]) / 2, np.radians(lon[b] - lon[a]) / 2
    h = np.sin(half_lat) ** 2 + np.cos(np.radians(lat[a])) * np.cos(np.radians(lat[b])) * np.sin(half_lon) ** 2
    h = np.clip(h, 0.0, 1.0)
    return 2.0 * RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(1.0 - h))


def pairs_in_rows(i: np.ndarray, j: np.ndarray, lon: np.ndarray, lat: np.ndarray, eps_m: float):
    """Runs of ``a, b, dist``: numbers of entries of the same row, different places up to *eps_m* apart; entries are sorted by row and latitude."""
    step = math.degrees(eps_m / RADIUS_M) * (1 + 1e-9) + 1e-12
    live, d = np.arange(len(i)), 0
    while len(live):
        d += 1
        live = live[: np.searchsorted(live, len(i) - d)]
        live = live[(i[live + d] == i[live]) & (lat[live + d] - lat[live] <= step)]
        for lo in range(0, len(live), PAIRS):
            a = live[lo : lo + PAIRS]
            dist = _haversine_m(lon, lat, a, a + d)
            near = (dist <= eps_m) & (j[a] != j[a + d])
            yield a[near], a[near] + d, dist[near]


def _column(table: pa.Table, name: str, kind: type | None = None) -> np.ndarray:
    found = table.column(name)
    return (found if kind is None else pc.fill_null(found, 0)).to_numpy().astype(kind or found.type.to_pandas_dtype(), copy=False)


@dataclass
class Bucket:
    """Entries by row, and where there are coordinates by latitude; a place of several coordinates has several entries, of which one is *first*."""

    table: pa.Table
    i: np.ndarray
    j: np.ndarray
    row: np.ndarray
    first: np.ndarray
    size: int

    def sums(self, values: np.ndarray, some: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros(self.size, kind)
        np.add.at(out, self.row[some], values[some].astype(kind))
        return out


@dataclass
class Part:
    """A relaxed matrix: what each place brings along for it (``j`` and columns), and how a bucket's ``entries, total, delta`` follow from that.

    With *coordinates* it needs each place's own, too.  Columns' names end with the part's number.
    """

    places: DataFrame
    run: Callable[[Bucket, str], tuple[np.ndarray, np.ndarray, np.ndarray]]
    coordinates: DataFrame | None = None


def _piece(table: pa.Table) -> pa.Table:
    """Some places as one value."""
    table, body = table.drop_columns(["piece"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(body, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.take(pc.sort_indices(table, [("j", "ascending")])))
    return pa.table({"body": pa.array([body.getvalue().to_pybytes()], pa.binary())})


def _copied(places: DataFrame, many: int, n: int) -> DataFrame:
    """``bucket, body``: all places packed, for each of *n* buckets. A task makes the copies of a few pieces."""
    pieces = max(1, -(-many // PIECE))
    dealt = places.withColumn("piece", F.pmod(F.xxhash64("j"), F.lit(pieces)).cast("int")).repartition(pieces, "piece")
    return dealt.groupBy("piece").applyInArrow(_piece, "body binary").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"), "body")


def _with_places(run: Callable[[pa.Table], pa.Table], kept: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """*run* on a bucket's entries joined with its places, some rows at once; entries without a place stay if *kept*."""

    def bucket(entries: pa.Table, pieces: pa.Table) -> pa.Table:
        known = pa.concat_tables([pa.ipc.open_stream(body.as_buffer()).read_all() for body in pieces.column("body")]).combine_chunks()
        entries = entries.select(["i", "j", "v"]).combine_chunks()
        entries = entries.take(np.argsort(_column(entries, "i"), kind="stable"))
        i, j = _column(entries, "i"), _column(entries, "j", np.int64)
        known = known.take(np.argsort(_column(known, "j"), kind="stable"))
        low, high = (np.searchsorted(_column(known, "j"), j, side) for side in ("left", "right"))
        found = np.where(entries.column("j").is_valid().to_numpy(), high - low, 0)
        starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(1, np.int64)
        out, lo = [], 0
        while lo < len(i) or not out:
            later = np.searchsorted(starts, lo + ENTRIES)
            hi = int(starts[later]) if later < len(starts) else len(i)
            size = np.maximum(found[lo:hi], 1) if kept else found[lo:hi]
            e = np.repeat(np.arange(lo, hi), size)
            at = low[e] + np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
            t, at = entries.take(e), pa.array(at, mask=found[e] == 0)
            for c in known.column_names:
                t = t if c == "j" else t.append_column(c, known.column(c).take(at))
            out.append(run(t))
            lo = hi
        return pa.concat_tables(out)

    return bucket


def _rows(left: DataFrame, parts: list[Part], weighted: bool, spread: DataFrame | None = None, direct: bool = False, whole: bool = False) -> DataFrame:
    """``i, of, entries, total, delta`` of each non-empty row of each part (*of*: its number), by one pass over *left*.

    *spread* (``j, q0, q1, ...``) adds columns: a row's dot product with each.  With *direct* (of one part) there is a row for each of *left*, with
    how many entries it has there.  With *whole* there is one row of all parts instead, ``i, at, own, delta_0, delta_1, ...``, with the row's entries.
    """
    kind, name = (np.float64, "double") if weighted else (np.int64, "long")
    at = next((p.coordinates for p in parts if p.coordinates is not None), None)
    tables = [] if at is None else [at.dropna(subset=["lon", "lat"]).select(F.col("id").alias("j"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))]
    tables += [p.places.select("j", *(F.col(c).alias(f"{c}_{k}") for c in p.places.columns if c != "j")) for k, p in enumerate(parts)]
    places = tables[0]
    for t in tables[1:]:
        places = places.join(t, "j", "full_outer")
    dots = [] if spread is None else [c for c in spread.columns if c != "j"]
    places = written((places if spread is None else places.join(spread, "j", "left")).dropna(subset=["j"]))
    runs = [p.run for p in parts]

    def run(t: pa.Table) -> pa.Table:
        i, j = _column(t, "i"), _column(t, "j")
        order = np.lexsort((j, _column(t, "lat"), i) if at_places else (j, i))
        t = t.take(order)
        i, j = i[order], j[order]
        new = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
        row = np.cumsum(new) - 1
        by_place, first = np.lexsort((j, row)), np.ones(len(i), bool)
        first[by_place[1:]] = (row[by_place[1:]] != row[by_place[:-1]]) | (j[by_place[1:]] != j[by_place[:-1]])
        b = Bucket(t, i, j, row, first, int(new.sum()))
        own, one, v = i[new], np.ones(len(i), np.int64), _column(t, "v", kind)
        columns = {"direct": b.sums(one, first, np.int64)} if direct else {}
        for c in dots:
            there = first & t.column(c).is_valid().to_numpy()
            columns[c] = pa.array(b.sums(v * _column(t, c, kind), there, kind), mask=b.sums(one, there, np.int64) == 0)
        out = []
        if whole:
            one = np.flatnonzero(first)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[one], minlength=b.size))]).astype(np.int32))
            lists = {n: pa.ListArray.from_arrays(at, pa.array(x[one])) for n, x in (("at", j), ("own", v))}
            return pa.table({"i": own} | lists | {f"delta_{k}": sums(b, f"_{k}")[2] for k, sums in enumerate(runs)})
        for k, sums in enumerate(runs):
            entries, total, delta = sums(b, f"_{k}")
            found = pa.table({"i": own, "of": np.full(len(own), k, np.int32), "entries": entries, "total": total, "delta": delta} | columns)
            out.append(found if direct else found.filter(pa.array(entries > 0)))
        return pa.concat_tables(out)

    at_places = at is not None
    schema = f"i long, of int, entries long, total {name}, delta {name}" + ", direct long" * direct + "".join(f", {c} {name}" for c in dots)
    if whole:
        schema = f"i long, at array<long>, own array<{name}>" + "".join(f", delta_{k} {name}" for k in range(len(parts)))
    entries, many = left.select("i", "j", "v"), places.count()
    n = max(1, -(-left.count() // ENTRIES))
    if copied := 0 < 2 * many <= WHOLE:
        n = max(-(-n * ENTRIES // WHOLE), min(n, left.sparkSession.sparkContext.defaultParallelism))
    else:
        entries = entries.join(places, "j", "left" if direct else "inner")
    entries = entries.withColumn("bucket", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")).groupBy("bucket")
    if copied:
        return entries.cogroup(_copied(places, many, n).groupBy("bucket")).applyInArrow(_with_places(run, direct), schema)
    return entries.applyInArrow(run, schema)


def _exact_sums(eps_m: float, weighted: bool) -> Callable[[Bucket, str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    kind = np.float64 if weighted else np.int64

    def run(b: Bucket, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, row = b.i, b.j, b.row
        v, s, k = (_column(b.table, c, kind) for c in ("v", f"s{of}", f"k{of}"))
        entries = b.sums(_column(b.table, f"n{of}", np.int64), b.first, np.int64)
        total, delta = b.sums(v * s, b.first, kind), b.sums(v * v * k, b.first, kind)
        found = pairs_in_rows(i, j, _column(b.table, "lon"), _column(b.table, "lat"), eps_m)
        if not b.first.all():
            pairs = list(found)
            x, y, dist = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            low, high = np.minimum(j[x], j[y]), np.maximum(j[x], j[y])
            least = np.lexsort((dist, high, low, row[x]))
            x, y, dist, low, high = x[least], y[least], dist[least], low[least], high[least]
            new = np.ones(len(x), bool)
            new[1:] = (row[x[1:]] != row[x[:-1]]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            found = [(x[new], y[new], dist[new])]
        for x, y, dist in found:
            w = np.ones(len(x), np.int64)
            if weighted:
                w = np.maximum(0.0, 1.0 - dist / eps_m) if eps_m > 0 else np.ones(len(x))
                x, y, w = x[w > 0], y[w > 0], w[w > 0]
            # a column that both places are in is one entry
            np.add.at(entries, row[x], -1)
            np.add.at(delta, row[x], 2 * v[x] * v[y] * w)
        if not weighted and len(v) and float(np.abs(v).max()) ** 2 * float(k.max()) * len(v) * 3 > 2.0**62:
            _overflow(i, v, k)
        return entries, total, delta

    return run


def _overflow(i: np.ndarray, v: np.ndarray, k: np.ndarray) -> None:
    """Integer overflow is an error: twice the sum of squares bounds a row's delta, as no place shares more with others than with itself."""
    _, row = np.unique(i, return_inverse=True)
    most = np.bincount(row, v.astype(float) ** 2 * k.astype(float)) * 2
    if len(most) and most.max() > 2.0**62:
        raise OverflowError("a row's sum of squares is beyond 64 bits")


def exact_part(coordinates: DataFrame, eps_m: float, weighted: bool = False) -> Part:
    """:func:`spatial.extend_exact`."""
    return Part(spatial.place_sums(coordinates, eps_m, weighted), _exact_sums(eps_m, weighted), coordinates)


def exact_rows(left: DataFrame, coordinates: DataFrame, eps_m: float, weighted: bool = False, direct: bool = False) -> DataFrame:
    """``i, entries, total, delta`` of each non-empty row of :func:`spatial.extend_exact`; *left* is best stored.

    With *direct*, also ``direct``: how many entries the row has in *left*, and each row of *left* is there.
    """
    return _rows(left, [exact_part(coordinates, eps_m, weighted)], weighted, direct=direct).drop("of")


def exact_deltas(left: DataFrame, coordinates: DataFrame, eps_m: float, weighted: bool = False) -> DataFrame:
    """``i, delta`` of :func:`spatial.extend_exact`."""
    return exact_rows(left, coordinates, eps_m, weighted).select("i", "delta")


def _top_k(left: DataFrame, part: Part, kernel_of: Callable[[DataFrame], DataFrame], queries: DataFrame, k: int, weighted: bool) -> DataFrame:
    """Best *k* by a kernel of some places (*kernel_of*: ``j`` to ``a, b, k``).

    Of a few queries each place has what every query has there, so rows' deltas and dot products come from the same pass over *left*.
    """
    similarity.checked(k)
    ids = similarity.few(queries)
    if not ids:
        asked = queries.select(F.col("query").alias("i")).distinct()
        kernel = kernel_of(written(left.join(asked, "i", "left_semi").select("j").distinct()))
        return similarity.kernel_top_k(left, kernel, queries, k, written(_rows(left, [part], weighted).select("i", "delta")))
    own = written(left.where(F.col("i").isin(ids)))
    kernel = kernel_of(own.select("j").distinct())
    met = own.join(kernel, own["j"] == kernel["a"])
    spread = met.groupBy(F.col("b").alias("j")).agg(*(F.sum(F.when(F.col("i") == q, F.col("v") * F.col("k"))).alias(f"q{n}") for n, q in enumerate(ids)))
    return similarity.ranked(similarity.side_by_side(written(_rows(left, [part], weighted, spread)), ids)).where(F.col("rank") <= k)


def exact_top_k(left: DataFrame, coordinates: DataFrame, eps_m: float, queries: DataFrame, k: int, weighted: bool = False) -> DataFrame:
    """:func:`similarity.top_k_batch` of :func:`spatial.extend_exact`: the kernel is made for the queries' own places only."""
    kernel_of = lambda own: spatial.place_kernel(coordinates, eps_m, weighted, own.withColumnRenamed("j", "id"))
    return _top_k(written(left), exact_part(coordinates, eps_m, weighted), kernel_of, queries, k, weighted)


def _near_in_row(eps_m: float) -> Callable[[pa.Table], pa.Table]:
    # a little wider: which pairs are in range is said by the join within the distance
    wider = eps_m * (1 + 1e-9) + 1e-6

    def run(t: pa.Table) -> pa.Table:
        t = t.take(np.lexsort((_column(t, "j"), _column(t, "lat"), _column(t, "i"))))
        i, j, v = (_column(t, c) for c in "ijv")
        # a place with several coordinates has several entries here, of which the first stands for all
        by_place = np.lexsort((j, i))
        new = np.ones(len(i), bool)
        new[1:] = (i[by_place[1:]] != i[by_place[:-1]]) | (j[by_place[1:]] != j[by_place[:-1]])
        stands = np.empty(len(i), np.int64)
        stands[by_place] = by_place[new][np.cumsum(new) - 1]
        pairs = list(pairs_in_rows(i, j, _column(t, "lon"), _column(t, "lat"), wider))
        x, y = (stands[np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)])] for k in (0, 1))
        x, y = np.divmod(np.unique(np.concatenate([x * len(i) + y, y * len(i) + x])), max(1, len(i)))
        one = np.flatnonzero(stands == np.arange(len(i)))
        at = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(i))[one])]).astype(np.int32)
        lists = {name: pa.ListArray.from_arrays(pa.array(at), pa.array(values[y])) for name, values in (("near", j), ("theirs", v))}
        return pa.table({"i": i[one], "j": j[one], "v": v[one]} | lists)

    return run


def exact_matrix(left: DataFrame, coordinates: DataFrame, eps_m: float, weighted: bool = False) -> DataFrame:
    """:func:`spatial.extend_exact` itself, without a shuffle of its entries; *left* is best stored.

    A column of two places has a second term in a row only if the row has both.  Each entry of *left* knows which places near its own its row has
    (a bucket holds these), so terms are added where they are made.
    """
    kind = "double" if weighted else "bigint"
    places = coordinates.dropna(subset=["lon", "lat"]).select(F.col("id").alias("j"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    n = max(1, -(-left.count() // ENTRIES))
    entries = left.select("i", "j", F.col("v").cast(kind).alias("v")).join(places, "j").withColumn("bucket", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int"))
    known = entries.groupBy("bucket").applyInArrow(_near_in_row(eps_m), f"i long, j long, v {kind}, near array<long>, theirs array<{kind}>")
    pairs = spatial.weighted_pairs(coordinates, eps_m, weighted).select(F.col("u").alias("a"), F.col("v").alias("b"), half_edge_weight(F.col("w"), weighted).alias("w"))
    met = known.join(pairs, known["j"] == pairs["a"]).withColumn("at", F.array_position("near", F.col("b"))).where("at = 0 OR a < b")
    value = (F.col("v") + F.when(F.col("at") > 0, F.get("theirs", (F.col("at") - 1).cast("int"))).otherwise(F.lit(0).cast(kind))) * F.col("w")
    return met.select("i", F.struct(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).alias("c"), value.alias("m"))


def exact_through(left: DataFrame, coordinates: DataFrame, eps_m: float, right: DataFrame, weighted: bool = False) -> DataFrame:
    """:func:`spatial.through` with the relaxed place's own end multiplied first, which has a row for each place and end.

    *left* may have several entries of the same ends; they are added with the rest of the path, so it needs no shuffle of its own.
    """
    kernel = spatial.place_kernel(coordinates, eps_m, weighted)
    ends = written(kernel.join(right.select(F.col("i").alias("b"), "j", F.col("v").alias("by")), "b").groupBy("a", "j").agg(F.sum(F.col("k") * F.col("by")).alias("v")))
    joined = left.select("i", F.col("j").alias("a"), F.col("v").alias("own")).join(ends, "a")
    return joined.groupBy("i", "j").agg(F.sum(F.col("own") * F.col("v")).alias("v"))


def _grid_sums(weighted: bool) -> Callable[[Bucket, str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    kind = np.float64 if weighted else np.int64

    def run(b: Bucket, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, row = (b.table, b.row) if b.first.all() else (b.table.filter(pa.array(b.first)), b.row[b.first])
        v = _column(t, "v", kind)
        unpacked = lambda c, as_: np.frombuffer(b"".join(pc.fill_null(t.column(c), b"").to_pylist()), as_)
        length = pc.fill_null(pc.binary_length(t.column(f"cells{of}")), 0).to_numpy().astype(np.int64) // 8
        steps = np.cumsum(unpacked(f"cells{of}", np.int64))
        cell = steps - np.repeat(np.concatenate([[0], steps])[np.cumsum(length) - length], length)
        w = unpacked(f"w{of}", np.float64).astype(kind) if f"w{of}" in t.column_names else np.ones(len(cell), kind)
        at, m = np.repeat(row, length), np.repeat(v, length) * w
        order = np.lexsort((cell, at))
        at, cell, m = at[order], cell[order], m[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (cell[1:] != cell[:-1])])) if len(at) else np.zeros(0, np.int64)
        sums, at = np.add.reduceat(m, first) if len(first) else m, at[first]
        if not weighted and len(sums) and float(np.abs(sums).max()) ** 2 * len(sums) > 2.0**62 and np.bincount(at, sums.astype(float) ** 2).max() > 2.0**62:
            raise OverflowError("a row's sum of squares is beyond 64 bits")
        entries, total, delta = np.zeros(b.size, np.int64), np.zeros(b.size, kind), np.zeros(b.size, kind)
        np.add.at(entries, at, 1)
        np.add.at(total, at, sums)
        np.add.at(delta, at, sums * sums)
        return entries, total, delta

    return run


def _packed(table: pa.Table) -> pa.Table:
    """``j, cells, w`` of a bucket of places: the bytes of arrays, of each place's entries and of its cells by their steps, which repeat and compress."""
    j, cell, w = (_column(table, c) for c in ("j", "cell", "w"))
    order = np.lexsort((cell, j))
    j, cell, w = j[order], cell[order].astype(np.int64), w[order].astype(np.float64)
    first = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]])) if len(j) else np.zeros(0, np.int64)
    runs = list(zip(first, [*first[1:], len(j)], strict=True))
    return pa.table({"j": pa.array(j[first], pa.int64()), "cells": pa.array([np.diff(cell[a:b], prepend=0).tobytes() for a, b in runs], pa.binary()), "w": pa.array([w[a:b].tobytes() for a, b in runs], pa.binary())})


def _cells_part(columns: DataFrame, weighted: bool) -> Part:
    n = max(1, -(-columns.count() // ENTRIES))
    packed = written(columns.withColumn("bucket", F.pmod(F.xxhash64("j"), F.lit(n)).cast("int")).groupBy("bucket").applyInArrow(_packed, "j long, cells binary, w binary"))
    ones = not weighted and columns.where("w <> 1").isEmpty()
    return Part(packed.drop("w") if ones else packed, _grid_sums(weighted))


def grid_part(coordinates: DataFrame, eps_m: float, cells, weighted: bool = False) -> Part:
    """:func:`spatial.extend_grid`."""
    return _cells_part(written(spatial.cell_columns(coordinates, eps_m, cells, weighted)), weighted)


def grid_rows(left: DataFrame, coordinates: DataFrame, eps_m: float, cells, weighted: bool = False) -> DataFrame:
    """``i, entries, total, delta`` of each non-empty row of :func:`spatial.extend_grid`; *left* is best stored."""
    return _rows(left, [grid_part(coordinates, eps_m, cells, weighted)], weighted).drop("of")


def grid_top_k(left: DataFrame, coordinates: DataFrame, eps_m: float, cells, queries: DataFrame, k: int, weighted: bool = False) -> DataFrame:
    """:func:`similarity.top_k_batch` of :func:`spatial.extend_grid`: the kernel is made for the queries' own places only."""
    left, columns = written(left), written(spatial.cell_columns(coordinates, eps_m, cells, weighted))

    def kernel_of(own: DataFrame) -> DataFrame:
        x = columns.join(own, "j", "left_semi").select(F.col("j").alias("a"), "cell", F.col("w").alias("w_a"))
        y = columns.select(F.col("j").alias("b"), "cell", F.col("w").alias("w_b"))
        return x.join(y, "cell").groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("k"))

    return _top_k(left, _cells_part(columns, weighted), kernel_of, queries, k, weighted)


def rows_of(left: DataFrame, parts: list[Part], weighted: bool = False) -> DataFrame:
    """``i, of, entries, total, delta``: rows of several relaxed matrices by number (of the same *weighted* and coordinates), by one pass over *left*."""
    return _rows(left, parts, weighted)


def whole_rows(left: DataFrame, parts: list[Part], weighted: bool = False) -> DataFrame:
    """``i, at, own, delta_0, delta_1, ...``: each row's entries at known places, and its delta in each of several relaxed matrices, by one pass over *left*."""
    return _rows(left, parts, weighted, whole=True)
