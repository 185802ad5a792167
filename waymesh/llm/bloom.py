"""Two Bloom filters, for hashes seen once and hashes seen twice, built where the data lie.

Each task adds its hashes to a pair of bit arrays, sized for the whole input.  Pairs are merged by
``twice |= other.twice | (once & other.once); once |= other.once``: an element that two tasks have seen
once each has all of its bits in both ``once`` arrays, so it is in the merged ``twice``.  A false
positive is possible, a false negative is not.  The bit arrays are cut into shards, which are packed,
shuffled and merged in three levels, so that no task gets them all, and only ``twice`` (at most 64 MB) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbuf

#: Bits of either filter: about eight for each expected hash, at least 128 kB and at most 64 MB.  A hash seen
#: once passes as seen twice if others have all of its three bits: 3 in a hundred at eight bits, 15 at four, 47
#: at two.  So up to 130 million hashes most stay where they are; beyond, the exact step gets more and more.
PER_HASH, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29
HASHES = 3
SHARDS = 32
#: Pairs merged at once: with a million tasks no merge gets more than a thousand shards.
WIDTH = 32

_MERGE = "shard int, level int, once binary, twice binary"


def bits_for(hashes: int) -> int:
    """The size of a filter for so many distinct hashes."""
    bits = LEAST_BITS
    while bits < min(PER_HASH * hashes, MOST_BITS):
        bits *= 2
    return bits


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)]


class Filter:
    """A Bloom filter over 64-bit hashes, its bits in bytes."""

    def __init__(self, bits: int = LEAST_BITS, data: bytes | None = None):
        self.bits = bits if data is None else 8 * len(data)
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def add(self, h: np.ndarray) -> None:
        for p in _places(h, self.bits):
            np.bitwise_or.at(self.data, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in _places(h, self.bits):
            out &= (self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(x.tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(x), np.uint8)


def _merged(table: pa.Table) -> pa.Table:
    once = twice = None
    for a, b in zip(table.column("once"), table.column("twice"), strict=True):
        o, t = _unpack(a.as_py()), _unpack(b.as_py())
        if once is None:
            once, twice = o.copy(), t.copy()
        else:
            twice |= t | (once & o)
            once |= o
    first = {k: table.column(k)[0].as_py() for k in ("shard", "level")}
    return pa.table({"shard": pa.array([first["shard"]], pa.int32()), "level": pa.array([first["level"]], pa.int32()), "once": pa.array([_pack(once)], pa.binary()), "twice": pa.array([_pack(twice)], pa.binary())})


def seen_once(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> bytes:
    """The ``once`` filter's bytes: all that *hashes* yields from *df*'s batches."""
    return _seen(df, hashes, bits, "once")


def seen_twice(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> bytes:
    """The ``twice`` filter's bytes over what *hashes* yields from *df*'s batches.

    Each yielded array holds the hashes of some holders (documents, say), each hash once per holder; a
    hash counts as seen twice when two holders have it.  An empty input gives an empty filter.
    """
    return _seen(df, hashes, bits, "twice")


def _seen(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, which: str) -> bytes:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice, some = Filter(bits), Filter(bits), False
        for batch in batches:
            for h in hashes(batch):
                if len(h):
                    some = True
                    values, counts = np.unique(h, return_counts=True)
                    again = (counts > 1) | once.has(values)
                    twice.add(values[again])
                    once.add(values)
        if some:
            level = TaskContext.get().partitionId()
            cut = bits // 8 // SHARDS
            for k in range(SHARDS):
                part = slice(k * cut, (k + 1) * cut)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level], pa.int32()), pa.array([_pack(once.data[part])], pa.binary()), pa.array([_pack(twice.data[part])], pa.binary())], names=["shard", "level", "once", "twice"])

    parts = df.mapInArrow(shared.frugal(build), _MERGE)
    for level in ((F.col("level") / WIDTH).cast("int"), (F.col("level") / WIDTH).cast("int"), F.lit(0)):
        parts = parts.withColumn("level", level).groupBy("shard", "level").applyInArrow(_merged, _MERGE)
    data = np.zeros(bits // 8, np.uint8)
    cut = bits // 8 // SHARDS
    for row in parts.select("shard", which).collect():  # SHARDS rows of a fixed size
        data[row["shard"] * cut : (row["shard"] + 1) * cut] = _unpack(bytes(row[which]))
    return data.tobytes()


def parted(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Of *rows*, those that a Bloom filter of *ids* (one column of integers without nulls, stored) has, and all others.

    All rows with one of the ids are among the first, and a few with another; the others stay where they are.
    A null id is among the others.
    """
    (name,) = ids.columns

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _hashed(batch, name)

    sent = rows.sparkSession.sparkContext.broadcast(seen_once(ids, of, bits_for(ids.count())))

    def chosen(wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute as pc

            found = Filter(data=sent.value)
            for batch in batches:
                there = pc.is_valid(batch.column(batch.schema.get_field_index(id_col))).to_numpy(zero_copy_only=False)
                hit = found.has(_hashed(batch, id_col)) & there
                yield batch.filter(pa.array(hit == wanted))

        return run

    return tuple(rows.mapInArrow(shared.frugal(chosen(wanted)), rows.schema) for wanted in (True, False))


def _hashed(batch: pa.RecordBatch, name: str) -> np.ndarray:
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return textbuf.mixed(pc.fill_null(column, 0).to_numpy(zero_copy_only=False).view(np.uint64))
