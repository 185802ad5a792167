"""Sum-of-squares packing of tokenized documents into sequences.

Each piece goes where the sum, over residual gaps, of the squared number of open bins with that gap
becomes smallest; ties go to the smallest gap left.  Pieces are packed in blocks of bounded size, in
parallel and from the longest on; bins that come out nearly full are final, the pieces of the others go
on to the next round, in fewer blocks.  A round keeps a small share of the pieces, so the last block
is small, whatever the input, and no step sees all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, word_bpe

SIZE = 2048
#: Pieces of one block.
BLOCK = 4096
#: A bin with at most so many free tokens is final in any round.
SLACK = 4
ROUNDS = 6

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long, done boolean"


def tokenizer_file(path: str | None = None) -> str:
    """The vocabulary's JSON text, from *path* or the installed public one; it is sent to executors as text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenized_pieces(docs: DataFrame, spec: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each row's ids and a closing 0, cut into pieces of *size*."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe.Coder(spec)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            text = batch.column(batch.schema.get_field_index("text"))
            for lo in range(0, len(text), 256):
                doc, piece, start, length, crc = [], [], [], [], []
                for d, codes in zip(ids[lo : lo + 256].to_pylist(), coder.encode(text[lo : lo + 256].to_pylist()), strict=True):
                    raw = codes.astype("<u4").tobytes() + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[at : at + 4 * size]
                        doc.append(d)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return shared.keyed(docs, id_col, text_col).mapInArrow(shared.frugal(pieces), _PIECES)


def sum_of_squares(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """For pieces in the given order: their bins, their offsets, and the fill of each bin."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap; gap 0 is closed and isn't counted
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    fill: list[int] = []
    where, offset = [], []
    for n in lengths:
        if n >= size:
            choice, best = -1, 0
        else:
            # the change of the sum: a bin of gap g becomes one of gap g - n
            change = 2 * (count[: size + 1 - n] - count[n:] + 1)
            change[0] = 1 - 2 * count[n]
            change[count[n:] == 0] = np.iinfo(np.int64).max
            choice = int(np.argmin(change))
            best = change[choice]
            if best > 2 * count[size - n] + 1:
                choice = -1
        if choice < 0:
            b, gap = len(fill), size
            fill.append(0)
        else:
            gap = choice + n
            b = by_gap[gap].pop()
            count[gap] -= 1
        where.append(b)
        offset.append(fill[b])
        fill[b] += n
        if gap - n:
            by_gap[gap - n].append(b)
            count[gap - n] += 1
    return where, offset, fill


def pack(pieces: DataFrame, size: int = SIZE, block: int = BLOCK, slack: int = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to *size* tokens; every piece is packed once.

    Nulls in ``doc_id`` and repeated rows don't matter: a row is a piece, and rows are dealt to blocks by
    their place in *pieces*, which is to be a stored table.  No rows in, no rows out.
    """
    full = pieces.where(F.col("length") >= size).withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("bigint")})
    left = pieces.where(F.col("length") < size)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = full
    for r in range(rounds):
        n = left.count()
        blocks = max(1, -(-n // block))
        last = blocks == 1 or r == rounds - 1

        def one(table: pa.Table) -> pa.Table:  # runs before r and last change: stored() is eager
            b = table.column("block")[0].as_py()
            table = table.select(names).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
            where, offset, fill = sum_of_squares(table.column("length").to_pylist(), size)
            done = np.array([last or size - f <= slack for f in fill], bool)[where]
            # odd, and apart for all bins, blocks and rounds
            ids = ((b << 24 | np.array(where, np.int64)) * rounds + r) * 2 + 1
            return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64())).append_column("done", pa.array(done))

        dealt = left.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(r)), F.lit(blocks)))
        packed = shared.stored(dealt.groupBy("block").applyInArrow(one, _PACKED))
        out = out.unionByName(packed.where("done").drop("done"))
        if last:
            return out
        left = packed.where(~F.col("done")).select(*names)
    return out


def pack_documents(docs: DataFrame, spec: str | None = None, size: int = SIZE, **columns: str) -> DataFrame:
    """Tokenizes and packs each row of *docs*.

    A null or empty text is the closing 0 alone; a null id stays null; rows that share an id are packed
    separately; other columns aren't read.  Only rows longer than *size* are cut.
    """
    return pack(shared.stored(tokenized_pieces(docs, spec or tokenizer_file(), size, **columns)), size)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of 2048 tokens."""
    return pack_documents(shared.table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
