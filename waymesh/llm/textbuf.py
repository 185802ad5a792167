"""Vectorised work on the bytes of many texts at once: words, lines and hashes of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in runs of about so many bytes; a longer text makes a run of its own.
RUN_BYTES = 1 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true within the given ranges (ends included)."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


SPACE = byte_set((0x09, 0x0D), (0x20, 0x20))
#: A-Z become a-z, nothing else changes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Run:
    """Some texts, end to end: ``data`` holds their bytes, text *i* is ``data[at[i]:at[i + 1]]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first = data, at, first

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    """Splits a string column without nulls into runs of whole texts."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Run(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def spans(run: Run, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of *is_word* bytes, never across texts, and each text's first one."""
    inside = is_word[run.data]
    n = len(inside)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = run.at[(run.at > 0) & (run.at < n)]
    starts[edge] = inside[edge]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    ends[edge] = inside[edge - 1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends)
    return s, e, np.searchsorted(s, run.at)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x9FB21C651E98DF25)
    h = h ^ (h >> U64(28))
    h = h * U64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U64(32))


#: Of an 8-byte word, the bits of its first 0 to 8 bytes.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Longer ranges are hashed one by one.
BLOCKED = 32


class Ranges:
    """64-bit hashes of byte ranges: their 8-byte blocks, each mixed into the hash of those before it; long ranges by XXH3.

    Up to 8 bytes the hash is a bijection for each length.  No step is linear in the bytes, so no pattern
    of bytes collides by construction.
    """

    def __init__(self, seed: int):
        self.seed = seed

    def over(self, data: np.ndarray) -> "Blocks":
        return Blocks(data, self.seed)


class Blocks:
    def __init__(self, data: np.ndarray, seed: int):
        self.data, self.seed = np.ascontiguousarray(data), seed
        self.salt = U64(int(mixed(np.array([seed + 1], U64))[0]))
        # the 8 bytes from each place on, zeros beyond the end
        word = np.zeros(len(data) + BLOCKED + 8, U64)
        word[: len(data)] = data
        for k in (1, 2, 4):
            word[:-k] |= word[k:] << U64(8 * k)
        self.word = word

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        h = mixed((self.word[start] & _FIRST[np.minimum(n, 8)]) ^ self.salt)
        for k in range(8, BLOCKED, 8):
            some = np.flatnonzero(n > k)
            if not len(some):
                break
            h[some] = mixed(h[some] * U64(0x9E3779B97F4A7C15) + (self.word[start[some] + k] & _FIRST[np.minimum(n[some] - k, 8)]))
        h = mixed(h ^ (n.astype(U64) * U64(0x9E3779B97F4A7C15)))
        long = np.flatnonzero(n > BLOCKED)
        if len(long):
            from xxhash import xxh3_64_intdigest

            view, seed = memoryview(self.data), self.seed
            h[long] = np.fromiter((xxh3_64_intdigest(view[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), U64, len(long))
        return h


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as plain strings without nulls (null: empty)."""
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column, "") if column.null_count else column


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
