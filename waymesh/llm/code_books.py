"""Vector codes by parts, learnt by Lloyd's rounds with Elkan's bounds.

Vectors become integers and are cut into parts; each part position has a codebook.  The first assignment
measures all entries.  From then on a row keeps, for each part, an upper bound of the distance to its entry
and one lower bound for each entry.  When entries move, bounds shift by the movement; only entries that
neither their lower bound nor half the distance between entries rules out, strictly, are measured again.  A
measurement is of integers, so equal distances are seen as equal and the lower index wins.

Bounds are kept in a table in the shared folder, which each round reads and writes: upper bounds as 32-bit
floats rounded up, lower bounds in half a byte each, in steps of a quarter of the upper bound, rounded down (an
entry nearly four times as far is as good as farther ones).  A round's sums are made by the tasks and added by
Spark; the codebooks, as long as ENTRIES vectors, are all that the driver gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are less than this after scaling, so that squares and sums of 2^36 rows fit into 64 bits.
MOST = 1 << 26
#: Rows that are measured at once.
BLOCK = 1024
#: Bounds are moved by this share of themselves, more than the error of their arithmetic.
_ERROR = 2.0**-20

_STATE = "vec_id long, label string, vector binary, code binary, upper binary, lower binary"
_SUMS = "part int, entry int, n long, total array<long>"


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows whose vector is there and all of whose components are finite numbers."""
    x = vectors[vector_col]
    bad: Column = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = vectors.where(x.isNotNull() & ~bad)
    # labels of any type; null is a label of its own
    return found.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[label_col].cast("string").alias("label"), F.transform(x, lambda v: v.cast("double")).alias("vector"))


def _integers(rows: list | np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(np.asarray(rows, np.float64) * scale)
    if x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"a component is {MOST // scale} or more, too large for exact sums")
    return x.astype(np.int64)


def _measured(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry."""
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)


def _above(x: np.ndarray) -> np.ndarray:
    return (x * (1 + _ERROR)).astype(np.float32) * np.float32(1 + _ERROR)


def _packed(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Lower bounds (rows, parts, entries) as whole quarters of the upper bounds, rounded down, two to a byte."""
    unit = np.maximum(upper.astype(np.float64), 1e-30)[:, :, None] / 4
    steps = np.minimum(np.floor(lower * (1 - _ERROR) / unit), 15).astype(np.uint8)
    if steps.shape[2] % 2:
        steps = np.concatenate([steps, np.zeros((*steps.shape[:2], 1), np.uint8)], 2)
    return (steps[:, :, ::2] << 4 | steps[:, :, 1::2]).reshape(len(steps), -1)


def _unpacked(raw: np.ndarray, upper: np.ndarray, entries: int) -> np.ndarray:
    both = raw.reshape(*upper.shape, -1)
    steps = np.stack([both >> 4, both & 15], 3).reshape(*upper.shape, -1)[:, :, :entries]
    return steps * (np.maximum(upper.astype(np.float64), 1e-30)[:, :, None] / 4)


class Assigner:
    """One round's codebooks (parts, entries, components), how far entries have moved since the last, and how near they lie to each other."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None):
        self.books = books
        between = np.sqrt(np.array([_measured(b, b) for b in books], np.float64))
        self.half = between / 2 * (1 - _ERROR)
        for h in self.half:
            np.fill_diagonal(h, np.inf)
        self.nearest = self.half.min(2)
        self.moved = None if before is None else np.sqrt(((books - before) ** 2).sum(2).astype(np.float64)) * (1 + _ERROR)
        #: Distances measured, and those that bounds have saved.
        self.measured = self.saved = 0

    def first(self, p: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entry, upper bound and lower bounds: all entries are measured."""
        d = _measured(x, self.books[p])
        code = d.argmin(1)  # of equal ones the first
        root = np.sqrt(d.astype(np.float64))
        self.measured += d.size
        return code, root[np.arange(len(x)), code] * (1 + _ERROR), root

    def again(self, p: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the last round's."""
        entries = self.books[p]
        upper = upper + self.moved[p][code]
        low = np.maximum(lower * (1 - _ERROR) - self.moved[p], 0)
        # an upper bound that rules out all is as good as a measurement; others are made tight first
        open_ = np.flatnonzero((upper >= self.nearest[p][code]) & ((low <= upper[:, None]) & (self.half[p][code] <= upper[:, None])).any(1))
        best = np.full(len(x), -1, np.int64)
        best[open_] = ((x[open_] - entries[code[open_]]) ** 2).sum(1)
        upper[open_] = np.sqrt(best[open_].astype(np.float64)) * (1 + _ERROR)
        low[open_, code[open_]] = upper[open_] * (1 - 3 * _ERROR)
        ask = (low[open_] <= upper[open_, None]) & (self.half[p][code[open_]] <= upper[open_, None])
        ask[np.arange(len(open_)), code[open_]] = False
        some, entry = np.nonzero(ask)
        row = open_[some]
        d = ((x[row] - entries[entry]) ** 2).sum(1)
        low[row, entry] = np.sqrt(d.astype(np.float64))
        # each row's least distance, of equal ones the lowest index, its own entry among them
        every = np.concatenate([row, open_])
        to = np.concatenate([entry, code[open_]])
        far = np.concatenate([d, best[open_]])
        order = np.lexsort((to, far, every))
        head = order[np.concatenate([[True], every[order][1:] != every[order][:-1]])] if len(order) else order
        code = code.copy()
        code[every[head]] = to[head]
        best[every[head]] = far[head]
        known = best >= 0
        upper[known] = np.sqrt(best[known].astype(np.float64)) * (1 + _ERROR)
        self.measured += len(d) + len(open_)
        self.saved += x.shape[0] * len(entries) - len(d) - len(open_)
        return code, upper, low


def _cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, components)."""
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, -1).swapaxes(0, 1))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of binaries of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in matrix], pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            yield batch.slice(lo, BLOCK)


def _sums(state: DataFrame, parts: int, entries: int) -> DataFrame:
    """By part position and entry: how many parts it has, and their componentwise sums."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in _blocks(batches):
            x, code = _cut(_matrix(_column(batch, "vector"), "<i4").astype(np.int64), parts), _matrix(_column(batch, "code"), np.uint8)
            if total is None:
                total, count = np.zeros((parts, entries, x.shape[2]), np.int64), np.zeros((parts, entries), np.int64)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        if total is not None:
            p, k = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(count[p, k]), pa.array(list(total[p, k]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    found = state.select("vector", "code").mapInArrow(shared.frugal(summed), _SUMS)
    each = found.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    return each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code`` (a byte for each part) and ``error`` of each kept row, and the codebooks (parts, entries, components).

    Codebooks start as the parts of the *entries* smallest ids (rows that share an id by their components, a
    null id last); fewer rows give fewer entries.  Left out are rows whose vector is null or holds a null or
    a number that isn't finite, and rows that can't be cut into *parts* equal parts of the length that the
    first row has.  Repeated rows are rows of their own, other columns aren't read.  No kept rows give no
    rows and empty codebooks.  A component of MOST / *scale* or more is an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has to fit into a byte")
    shared.in_batches(vectors.sparkSession)
    kept = _kept(vectors, id_col, vector_col, label_col).where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    begin = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("n")).collect()
    if not begin:
        none = kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0)
        return none, np.zeros((parts, 0, 0), np.int64)
    length = begin[0]["n"]
    kept = kept.where(F.size("vector") == length)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # as long as the codebooks
    books = _cut(_integers([r["vector"] for r in seeds], scale), parts)
    entries = books.shape[1]

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Assigner(books, None)
        for batch in _blocks(batches):
            x = _integers(_column(batch, "vector").flatten().to_numpy().reshape(len(batch), -1), scale)
            found = [to.first(p, part) for p, part in enumerate(_cut(x, parts))]
            yield state_of(batch, _binary(x.astype("<i4")), found)

    def state_of(batch: pa.RecordBatch, vector: pa.Array, found: list) -> pa.RecordBatch:
        code, upper, lower = (np.stack([f[k] for f in found], 1) for k in range(3))
        upper = _above(upper)
        return pa.RecordBatch.from_arrays([_column(batch, "vec_id"), _column(batch, "label"), vector, _binary(code.astype(np.uint8)), _binary(upper), _binary(_packed(lower, upper))], names=["vec_id", "label", "vector", "code", "upper", "lower"])

    def stepped(books: np.ndarray, before: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to = Assigner(books, before)
            for batch in _blocks(batches):
                x = _cut(_matrix(_column(batch, "vector"), "<i4").astype(np.int64), parts)
                code, upper = _matrix(_column(batch, "code"), np.uint8).astype(np.int64), _matrix(_column(batch, "upper"), np.float32)
                lower = _unpacked(_matrix(_column(batch, "lower"), np.uint8), upper, entries)
                found = [to.again(p, x[p], code[:, p], upper[:, p].astype(np.float64), lower[:, p]) for p in range(parts)]
                yield state_of(batch, _column(batch, "vector"), found)

        return run

    state = shared.stored(kept.mapInArrow(shared.frugal(started), _STATE))
    for _ in range(rounds):
        before, books = books, books.copy()
        for r in _sums(state, parts, entries).collect():  # as long as the codebooks
            books[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
        old, state = state, shared.stored(state.mapInArrow(shared.frugal(stepped(books, before)), _STATE))
        shared.dropped(old)

    final = books

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            x, code = _cut(_matrix(_column(batch, "vector"), "<i4").astype(np.int64), parts), _matrix(_column(batch, "code"), np.uint8)
            error = sum(((x[p] - final[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([_column(batch, "vec_id"), _column(batch, "label"), _column(batch, "code"), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "vector", "code").mapInArrow(shared.frugal(measured), "vec_id long, label string, code binary, error long"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all kept ``embeddings``, their errors, and the errors of equal labels together."""
    found, books = learn(shared.table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = shared.stored(found)
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = found.join(by_label, found["label"].eqNullSafe(by_label["label"]))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
