"""Session helpers shared by the corpus operators: tables in the shared folder, folds, input columns."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker: a fixed number of rows could be any number of bytes, as texts may be long.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own."""
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session, whose executors are the driver's own process, gets a private
    folder; on a cluster it is an error, as no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="waymesh-")
    return _FALLBACK[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans up
        pass


def _release() -> None:
    """Gives memory that this Python process has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(f: Callable) -> Callable:
    """*f* over Arrow batches, so that the worker, which stays for later tasks, keeps little memory."""

    def run(batches: Iterator) -> Iterator:
        made, held, out = f(batches), 0, None
        try:
            for out in made:
                yield out
                held += out.nbytes + (1 << 20)
                if held >= 8 << 20:
                    _release()
                    held = 0
        finally:
            made.close()  # what it holds is free before memory goes back
            made = out = None
            _release()

    return run


def stored(df: DataFrame) -> DataFrame:
    """*df* written once as Parquet to the shared folder and read again.

    This cuts the lineage for good: the table outlives any executor, later plans read only the columns
    they need, and what produced it isn't run again.  The files go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._waymesh_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._waymesh_path)


def fold(key: Column, parts: int) -> Column:
    """``crc32(key as text) mod parts``; a null key is in fold 1, and so is neither first nor last."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(parts), F.lit(1).cast("bigint"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), nulls: bool = False) -> DataFrame:
    """The id and the text (null: empty, unless *nulls* are kept), under fixed names, so that other columns can't clash; columns *carry* in a struct ``rest``."""
    in_batches(docs.sparkSession)
    rest = [F.struct(*(docs[c] for c in carry)).alias("rest")] if carry else []
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), (docs[text_col] if nulls else F.coalesce(docs[text_col], F.lit(""))).alias("text"), *rest)


def carried(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, ...]:
    """All columns that :func:`keyed` doesn't have by itself; the id is among them, as its type may differ."""
    return tuple(c for c in docs.columns if c != text_col)


def unpacked(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """*docs*' columns again, from rows that carry all of them."""
    return found.select(*(F.col("text" if c == text_col else f"rest.`{c}`").alias(c) for c in docs.columns))


def gathered(batches: Iterator, size: int) -> Iterator:
    """Small Arrow batches joined to ones of about *size* bytes."""
    import pyarrow as pa

    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.nbytes
        if held >= size:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, held = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()
