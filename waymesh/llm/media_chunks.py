"""Media columns by content-defined payload chunking.

A text's payload is its UTF-8 bytes, filled up with spaces, stored as the 8-bit samples of a mono WAVE
file.  A rolling gear hash cuts the payload into chunks.  A medium is a header and an ordered list of
chunk digests; the chunk store has the bytes of each digest once:

1. Digests go into two Bloom filters (seen once, seen twice) where the texts lie.
2. The media table is written: chunks that no other medium can have lie in the row of theirs; the
   others are written as rows of their own, once per task, and become the chunk store, one row per digest.
3. Everything is read back: media with chunks elsewhere are put together by joins on digests, each
   distinct medium once; length and SHA-256 are verified, and features are computed from the samples.

So bytes are shuffled only for chunks that repeat.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, shared, textbuf

UNIT = 192
LEAST, MOST, BITS = 512, 8192, 11  # bytes of a chunk: about 2.5 kB on average
RATE = 8000
_GEAR = np.random.Generator(np.random.PCG64(111)).integers(0, 2**32, 256, dtype=np.uint32)

_STORE = "doc_id long, n_bytes long, media_sha binary, header binary, digests array<binary>, own array<binary>, digest binary, bytes binary"
_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payloads(run: textbuf.Run) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a run, filled up with spaces to positive multiples of UNIT, end to end, and where each begins."""
    size = np.diff(run.at)
    full = np.maximum(-(-size // UNIT), 1) * UNIT
    at = np.concatenate([[0], np.cumsum(full)])
    out = np.full(at[-1], 0x20, np.uint8)
    out[np.repeat(at[:-1] - run.at[:-1], size) + np.arange(len(run.data))] = run.data
    return out, at


def cuts(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each payload.

    The hash at a byte covers the 32 bytes up to it; as a chunk has at least LEAST bytes, it never
    looks beyond its payload, and equal payloads are cut alike.
    """
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    marks = (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist()
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        ends = []
        while b - a > LEAST:
            i = bisect_left(marks, a + LEAST)
            a = min(marks[i] if i < len(marks) else b, a + MOST, b)
            ends.append(a)
        if not ends or ends[-1] < b:
            ends.append(b)
        out.append(ends)
    return out


def header(n: int) -> bytes:
    """Of a WAVE file of *n* 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def samples(media: bytes) -> np.ndarray:
    """The samples of a WAVE file as :func:`header` begins it."""
    n = struct.unpack("<I", media[40:44])[0]
    if media[:4] != b"RIFF" or media[36:40] != b"data" or len(media) != 44 + n:
        raise ValueError("not a medium of this store")
    return np.frombuffer(media, np.uint8, n, 44)


def features(x: np.ndarray) -> str:
    """Number, mean, deviation and crossings of the middle line, and the shares of eight bands of the samples."""
    bands = np.bincount(x >> 5, minlength=8) / len(x)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"n={len(x)};mean={x.mean():.6f};dev={x.std():.6f};cross={crossings};bands=" + "/".join(f"{b:.4f}" for b in bands)


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _read(media: bytes, sha: bytes) -> tuple:
    if hashlib.sha256(media).digest() != sha:
        raise ValueError("a medium differs from what was stored")
    x = samples(media)
    payload = x.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha.hex(), features(x)


def _read_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)]


def store(docs: DataFrame, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The written media table and chunk store of ``doc_id, text`` (text not null).

    Media: ``doc_id, n_bytes, media_sha, header, digests, own`` (bytes of chunks, null where they are in
    the store).  Chunks: ``digest, bytes``, a digest once.
    """

    if bits is None:
        # chunks by their average size, and one for each text
        bits = bloom.bits_for(docs.agg(F.coalesce(F.sum(F.octet_length("text") / F.lit(1 << BITS) + 1), F.lit(0)).cast("bigint").alias("n")).first()["n"])

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for run in textbuf.runs(textbuf.string_column(batch, "text")):
            data, at = payloads(run)
            raw = data.tobytes()
            found = []
            for a, ends in zip(at.tolist(), cuts(data, at), strict=False):
                for b in ends:
                    found.append(_digest(raw[a:b])[:8])
                    a = b
            yield np.frombuffer(b"".join(found), np.uint64)

    twice = docs.sparkSession.sparkContext.broadcast(bloom.seen_twice(docs.select("text"), hashes, bits))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.Filter(data=twice.value)
        written: set[bytes] = set()
        names = [c.split()[0] for c in _STORE.split(", ")]
        for batch in batches:
            ids = _field(batch, "doc_id")
            for run in textbuf.runs(textbuf.string_column(batch, "text")):
                data, at = payloads(run)
                raw, size = data.tobytes(), np.diff(run.at).tolist()
                chunks = []
                for a, ends in zip(at.tolist(), cuts(data, at), strict=False):
                    chunks.append([raw[x:y] for x, y in zip([a, *ends], ends, strict=False)])
                digests = [[_digest(c) for c in x] for x in chunks]
                flat = [d for x in digests for d in x]
                common = iter(seen.has(np.frombuffer(b"".join(d[:8] for d in flat), np.uint64)).tolist())
                rows, extra = [], {}
                for d, doc in enumerate(ids.slice(run.first, len(run)).to_pylist()):
                    head = header(int(at[d + 1] - at[d]))
                    own = []
                    for key, chunk in zip(digests[d], chunks[d], strict=True):
                        shared_one = next(common)
                        own.append(None if shared_one else chunk)
                        if shared_one and key not in written:
                            extra[key] = chunk
                            written.add(key)
                    rows.append((doc, size[d], hashlib.sha256(head + raw[at[d] : at[d + 1]]).digest(), head, digests[d], own, None, None))
                rows += [(None,) * 6 + pair for pair in extra.items()]
                if len(written) > 500_000:
                    written.clear()
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    written = shared.stored(docs.mapInArrow(shared.frugal(write), _STORE))
    chunks = shared.stored(written.where("digest IS NOT NULL").select("digest", "bytes").dropDuplicates(["digest"]))
    return written.where("digest IS NULL").drop("digest", "bytes"), chunks


def read_back(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, n_bytes``, what :func:`_read` gives, ``n_chunks`` and ``n_shared`` of each stored medium."""
    missing = F.exists("own", lambda x: x.isNull())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read(h + b"".join(own), sha) for h, own, sha in zip(*(_field(batch, c).to_pylist() for c in ("header", "own", "media_sha")), strict=True)]
            count = pa.array([len(x) for x in _field(batch, "own")], pa.int32())
            yield pa.RecordBatch.from_arrays([_field(batch, "doc_id"), _field(batch, "n_bytes"), *_read_columns(rows), count, pa.array(np.zeros(len(count), np.int32))], names=out_names)

    def pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shas = [], _field(batch, "media_sha")
            for h, own, found, digests, sha in zip(*(_field(batch, c).to_pylist() for c in ("header", "own", "found", "digests", "media_sha")), strict=True):
                for x in found:
                    if _digest(x["bytes"]) != digests[x["pos"]]:
                        raise ValueError("a chunk differs from its digest")
                    own[x["pos"]] = x["bytes"]
                rows.append(_read(h + b"".join(own), sha))
            yield pa.RecordBatch.from_arrays([shas, *_read_columns(rows)], names=["sha", *read_names])

    read_names = [c.split()[0] for c in _READ.split(", ")]
    out_names = ["doc_id", "n_bytes", *read_names, "n_chunks", "n_shared"]
    complete = media.where(~missing).select("doc_id", "n_bytes", "media_sha", "header", "own").mapInArrow(shared.frugal(whole), f"doc_id long, n_bytes long, {_READ}, n_chunks int, n_shared int")
    # equal media are put together once
    partial = media.where(missing)
    each = partial.select("media_sha", "header", "digests", "own").dropDuplicates(["media_sha"])
    wanted = each.select("media_sha", "own", F.posexplode("digests").alias("pos", "digest")).where(F.get("own", F.col("pos")).isNull()).drop("own")
    found = wanted.join(chunks, "digest").groupBy("media_sha").agg(F.collect_list(F.struct("pos", "bytes")).alias("found"))
    rebuilt = shared.stored(each.join(found, "media_sha").mapInArrow(shared.frugal(pieced), f"sha binary, {_READ}"))
    counts = partial.select("doc_id", "n_bytes", "media_sha", F.size("own").alias("n_chunks"), F.size(F.filter("own", lambda x: x.isNull())).alias("n_shared"))
    return complete.unionByName(counts.join(rebuilt, counts["media_sha"] == rebuilt["sha"]).select(out_names))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """Stores the payload of each row of *docs* and reads it back.

    A null or empty text is a payload of UNIT spaces.  Equal texts give equal values.  Ids may be null or
    repeat; other columns aren't read.  A medium that can't be rebuilt bit by bit is an error.
    """
    return read_back(*store(shared.keyed(docs, id_col, text_col), bits))


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media columns of all of ``documents``."""
    return media_columns(shared.table(spark, sf_dir, "documents"))
