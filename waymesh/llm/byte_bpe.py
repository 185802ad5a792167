"""Byte-level BPE: texts to ids by a transducer, ids to bytes and whole characters by a state machine.

Texts are cut by the vocabulary's pattern; each match goes through :class:`bpe_transducer.Transducer`, and a
worker remembers the ids of short matches.  Nothing is shuffled: a row is encoded, or decoded, where it lies.
"""

from __future__ import annotations

import re
import zlib
from array import array
from base64 import b64decode
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textbuf
from .bpe_transducer import WHOLE, Decoder, Pieces, Transducer
from .word_bpe import process_state

#: Matches whose ids a Python worker remembers, and their most characters.
REMEMBERED, SHORT = 400_000, 48
#: Matches, and ids, that are held at once.
BLOCK = 1 << 16

#: Of no class: what the pattern takes for neither a letter, a number nor white space.
_NO_CLASS = "͸"


def vocabulary(path: str | None = None) -> bytes:
    """The file of ranks, from *path* or the installed public one; it is sent to executors as it is."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def pattern() -> str:
    """The pattern that the public vocabularies come with."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks_of(spec: bytes) -> dict[bytes, int]:
    return {b64decode(token): int(rank) for token, rank in map(bytes.split, spec.splitlines())}


def newer_characters() -> str:
    """Ranges of characters, as in a class of a pattern, that ``regex`` knows as letters or numbers and ``tiktoken``, with older tables, doesn't.

    Both libraries are asked for all characters.  Without ``tiktoken`` there is nothing to agree with.
    """
    try:
        import tiktoken
    except ImportError:
        return ""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    newer: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        asked = tiktoken.Encoding("single bytes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        newer |= set(regex.findall(kind, every)) - set(bytes(asked.encode_ordinary(every)).decode())
    places = np.array(sorted(map(ord, newer)))
    cuts = np.flatnonzero(np.diff(places) > 1) + 1
    return "".join(f"\\U{x[0]:08X}-\\U{x[-1]:08X}" for x in np.split(places, cuts) if len(x))


class _Known(dict):
    """Ids of matches, as bytes; new ones are found, and those of short ones kept."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, match: str) -> bytes:
        ids = array("i", self.transducer.encode(match.encode())).tobytes()
        if len(match) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = ids
        return ids


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Coder:
    """Texts to ids."""

    def __init__(self, spec: bytes, cut: str, newer: str = ""):
        import regex

        state = process_state(f"byte bpe {zlib.crc32(spec)}")
        if not state:
            state["known"] = _Known(Transducer(ranks_of(spec)))
        self.known = state["known"]
        self.cut = regex.compile(cut)
        self.newer = re.compile(f"[{newer}]") if newer else None

    def _matches(self, text: str) -> Iterator[str]:
        if self.newer is not None and not _latin(text) and self.newer.search(text):
            # cut as if these characters had no class; places stay the same
            return (text[m.start() : m.end()] for m in self.cut.finditer(self.newer.sub(_NO_CLASS, text)))
        return iter(self.cut.findall(text)) if len(text) < BLOCK else (m.group() for m in self.cut.finditer(text))

    def encode(self, text: str) -> np.ndarray:
        matches, parts = self._matches(text), []
        while some := list(islice(matches, BLOCK)):
            parts.append(b"".join(map(self.known.__getitem__, some)))
        return np.frombuffer(b"".join(parts), np.int32)


def encode(docs: DataFrame, spec: bytes | None = None, cut: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for each row of *docs*: the ids of its whole text, without special tokens.

    A null or empty text has no ids.  A null id stays null, repeated rows and rows that share an id are rows
    of their own, and other columns aren't read.  No rows in, no rows out.
    """
    spec = vocabulary() if spec is None else spec
    cut = pattern() if cut is None else cut
    newer = newer_characters()
    sent = docs.sparkSession.sparkContext.broadcast((spec, cut, newer))  # the vocabulary's file, whatever the table

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*sent.value)
        for batch in batches:
            ids, text = batch.column(batch.schema.get_field_index("doc_id")), textbuf.string_column(batch, "text")
            for lo in range(0, len(text), 256):
                found = [coder.encode(t) for t in text[lo : lo + 256].to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 256], pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))], names=["doc_id", "ids"])

    return shared.keyed(docs, id_col, text_col).mapInArrow(shared.frugal(coded), "doc_id long, ids array<int>")


def decode(coded: DataFrame, spec: bytes | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded`` (bytes) and ``is_text`` (they are whole UTF-8) for each row of *coded*.

    Ids go through the state machine in blocks, as a stream would; null or no ids have no bytes, which are
    text.  An id that the vocabulary doesn't have, or a null within the array, is an error.
    """
    spec = vocabulary() if spec is None else spec
    sent = coded.sparkSession.sparkContext.broadcast(spec)  # the vocabulary's file, whatever the table
    shared.in_batches(coded.sparkSession)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = process_state(f"byte pieces {zlib.crc32(sent.value)}")
        if not state:
            state["pieces"] = Pieces(ranks_of(sent.value))
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            values, at = ids.values, np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].tolist()
            out, whole = [], []
            if values[at[0] : at[-1]].null_count:
                raise ValueError("an id that the vocabulary doesn't have: null")
            for a, b in zip(at, at[1:], strict=False):
                stream = Decoder(state["pieces"])
                out.append(b"".join([*(stream.feed(values[k : min(k + BLOCK, b)].to_numpy()) for k in range(a, b, BLOCK)), stream.close()]))
                whole.append(stream.state == WHOLE)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), ids, pa.array(out, pa.binary()), pa.array(whole, pa.bool_())], names=["doc_id", "ids", "decoded", "is_text"])

    rows = coded.select(coded[id_col].cast("bigint").alias("doc_id"), F.coalesce(coded[ids_col], F.array().cast("array<int>")).cast("array<int>").alias("ids"))
    return rows.mapInArrow(shared.frugal(streamed), "doc_id long, ids array<int>, decoded binary, is_text boolean")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all of ``documents``, and digests of what they decode to."""
    spec = vocabulary()
    both = decode(encode(shared.table(spark, sf_dir, "documents"), spec), spec)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "is_text")
