"""Line dedup: Bloom filters find suspected repeats, and only those are shuffled and confirmed.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased.  A key of
at least ``min_chars`` code points that at least ``min_docs`` documents hold is repeated: all lines of
that key go, except in the document with the largest id holding it.

1. Each task hashes the keys of its documents into a once-seen and a twice-seen Bloom filter, sized for
   the number of lines.
2. Keys in the merged twice-seen filter (64 MB at most, broadcast) are suspects; only their 128-bit
   digests (BLAKE2) and ids are shuffled, pre-aggregated, and counted exactly.
3. A third Bloom filter has the ids that lose a line.  Texts of others stay where they are; each of these gets
   the digests that it loses, by a join on its id, and is rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, shared, textbuf

MIN_CHARS, MIN_DOCS = 20, 3

_SUSPECTS = "doc_id long, k1 long, k2 long"
_OUT = "doc_id long, text string, n_lines long, n_dropped long"


class _Lines:
    """Starts and ends of the lines of a run (of what is kept), and of their keys in the lower-cased data."""

    def __init__(self, run: textbuf.Run, min_chars: int):
        data, at = run.data, run.at
        breaks = np.flatnonzero(data == 0x0A)
        # a text of k breaks has k + 1 lines; the empty text has one
        self.start = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
        self.end = np.sort(np.concatenate([at[1:], breaks]), kind="stable")
        per_text = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
        self.doc = np.repeat(np.arange(len(run)), per_text)
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        solid = np.flatnonzero(~textbuf.SPACE[data])
        lo = np.searchsorted(solid, self.start)
        hi = np.searchsorted(solid, self.end)
        some = hi > lo
        padded = np.append(solid, 0)
        self.s = np.where(some, padded[lo], self.start)
        self.e = np.where(some, padded[hi - 1] + 1, self.start)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.long = heads[self.e] - heads[self.s] >= min_chars
        self.lower = textbuf.LOWER[data] if len(data) else data

    def hashes(self, ranges: textbuf.Ranges, lines: np.ndarray) -> np.ndarray:
        return ranges.over(self.lower).hash(self.s[lines], self.e[lines])

    def digests(self, lines: np.ndarray) -> list[bytes]:
        from hashlib import blake2b

        view = memoryview(self.lower)
        return [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(self.s[lines].tolist(), self.e[lines].tolist(), strict=True)]


def _per_holder(doc: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Each document's keys, once per document."""
    order = np.lexsort((doc, *key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (doc, *key)], axis=0)
    return order[new]


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Suspected lines ``(doc_id, k1, k2)``, one row per document and key, and the repeated keys ``(k1, k2, keeper)``.

    *docs* has ``doc_id`` and ``text`` without nulls in ``text``; rows with a null id hold nothing.  Rows that
    share an id count as one document.
    """
    held = docs.where(F.col("doc_id").isNotNull())
    if bits is None:
        breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
        bits = bloom.bits_for(held.agg(F.coalesce(F.sum(breaks + 1), F.lit(0)).alias("n")).first()["n"])

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        ranges = textbuf.Ranges(101)
        for run in textbuf.runs(textbuf.string_column(batch, "text")):
            lines = _Lines(run, min_chars)
            pick = np.flatnonzero(lines.long)
            k = lines.hashes(ranges, pick)
            yield k[_per_holder(lines.doc[pick], k)]

    twice = held.sparkSession.sparkContext.broadcast(bloom.seen_twice(held.select("text"), hashes, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ranges = bloom.Filter(data=twice.value), textbuf.Ranges(101)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for run in textbuf.runs(textbuf.string_column(batch, "text")):
                lines = _Lines(run, min_chars)
                pick = np.flatnonzero(lines.long)
                pick = pick[seen.has(lines.hashes(ranges, pick))]
                key = np.frombuffer(b"".join(lines.digests(pick)), np.int64).reshape(-1, 2)
                one = _per_holder(lines.doc[pick], key[:, 0], key[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[run.first + lines.doc[pick[one]]], pa.int64()), pa.array(key[one, 0]), pa.array(key[one, 1])], names=["doc_id", "k1", "k2"])

    found = shared.stored(held.select("doc_id", "text").mapInArrow(shared.frugal(suspects), _SUSPECTS))
    # ids that occur in several rows count once; both steps combine before they shuffle
    once = found.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))
    repeated = once.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    return found, shared.stored(repeated)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text`` (rebuilt), ``n_lines`` (before) and ``n_dropped`` for each row of *docs*, and the columns *carry* in a struct ``rest``.

    A null or empty text is one empty line and stays empty.  A row with a null id holds no line for others
    and keeps all of its own.  Rows that share an id are one document, and each row is rebuilt.  Other
    columns, of whatever name, aren't read.  No rows in, no rows out.
    """
    base = shared.keyed(docs, id_col, text_col)
    found, repeated = repeated_lines(base, min_chars, min_docs, bits)
    loses = found.join(repeated, ["k1", "k2"]).where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("loses"))
    loses = shared.stored(loses)
    carried = shared.keyed(docs, id_col, text_col, carry)
    some, others = bloom.parted(carried, loses.select("doc_id"))
    both = some.join(loses, "doc_id", "left")
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    whole = others.select("doc_id", "text", lines.cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"), *(["rest"] if carry else []))
    kind = T.StructType([*T.StructType.fromDDL(_OUT).fields, *carried.schema.fields[2:]])

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            text, loses = textbuf.string_column(batch, "text"), batch.column(batch.schema.get_field_index("loses"))
            n_lines = pc.add(pc.count_substring(text, "\n"), 1).cast(pa.int64())
            dropped = np.zeros(len(text), np.int64)
            rows = np.flatnonzero(pc.is_valid(loses).to_numpy(zero_copy_only=False))
            if len(rows):
                new = {}
                part = text.take(pa.array(rows))
                keys = loses.take(pa.array(rows))
                for run in textbuf.runs(part):
                    lines = _Lines(run, min_chars)
                    for i in range(len(run)):
                        a, b = lines.first[i], lines.first[i + 1]
                        pairs = keys[run.first + i].values
                        raw = np.stack([pairs.field(c).to_numpy() for c in ("k1", "k2")], 1).tobytes()
                        lost = {raw[k : k + 16] for k in range(0, len(raw), 16)}
                        gone = lines.long[a:b].copy()
                        long = np.flatnonzero(gone)
                        gone[long] = [d in lost for d in lines.digests(a + long)]
                        where = rows[run.first + i]
                        dropped[where] = gone.sum()
                        new[where] = b"\n".join(run.data[s:e].tobytes() for s, e in zip(lines.start[a:b][~gone], lines.end[a:b][~gone], strict=True)).decode()
                mask = np.zeros(len(text), bool)
                mask[rows] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array([new[r] for r in rows], text.type))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), text, n_lines, pa.array(dropped), *([batch.column(batch.schema.get_field_index("rest"))] if carry else [])], names=["doc_id", "text", "n_lines", "n_dropped", *(["rest"] if carry else [])])

    return both.mapInArrow(shared.frugal(rebuilt), kind).unionByName(whole)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of :func:`dedup_lines` over all of ``documents``."""
    out = dedup_lines(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH blank AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM docs),
keys AS (SELECT doc_id, i, line, translate(trim(line, b), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines, blank),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keys.doc_id, i, line, keeper IS NOT NULL AND keeper <> keys.doc_id AS gone FROM keys LEFT JOIN repeated ON keys.k = repeated.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
