"""Matrices and deltas from a stream equal those of a rebuild after every micro-batch."""

import random

from pyspark.sql import functions as F

from waymesh.operators import matrix
from waymesh.streaming import kept


def test_kept_up_to_date(spark, tmp_path):
    rng, d = random.Random(1), str(tmp_path)
    (tmp_path / "in").mkdir()
    edges = spark.readStream.schema("i bigint, j bigint").parquet(f"{d}/in")
    every = []
    for n in range(4):
        # a hub with most of the edges, repeated ones, and some without an end
        rows = [(rng.choice([0, 0, 0, rng.randrange(30)]), rng.randrange(200 if n % 2 else 40)) for _ in range(600)] + [(None, 1), (2, None)]
        every += [r for r in rows if None not in r]
        spark.createDataFrame(rows, "i bigint, j bigint").coalesce(1).write.mode("append").parquet(f"{d}/in")
        for name, changes in (("entries", kept.changed_entries(edges)), ("deltas", kept.changed_deltas(edges, 4))):
            q = kept.keep(changes, f"{d}/{name}", f"{d}/check-{name}")  # each time from where the last one stopped
            q.processAllAvailable()
            q.stop()
        rebuilt = spark.createDataFrame(every, "i bigint, j bigint").groupBy("i", "j").agg(F.count("*").alias("v"))
        assert sorted(map(tuple, kept.kept_matrix(spark, f"{d}/entries").collect())) == sorted(map(tuple, rebuilt.collect()))
        assert sorted(map(tuple, kept.kept_deltas(spark, f"{d}/deltas").collect())) == sorted(map(tuple, matrix.deltas(rebuilt).collect()))
    changes = spark.read.schema(kept.PARTS).parquet(f"{d}/deltas")
    small = kept.compacted(changes, ["i", "part"], "delta")
    assert small.count() < changes.count() and small.count() == small.select("i", "part").distinct().count()
    assert small.groupBy("i").agg(F.sum("delta")).count() == len({i for i, _ in every})


def test_a_batch_that_runs_again(spark, tmp_path):
    """A repeated batch replaces itself."""
    d = str(tmp_path)
    for v in (1, 2):
        spark.createDataFrame([(0, 0, v)], "i bigint, j bigint, v bigint").write.mode("overwrite").parquet(f"{d}/batch=0")
    spark.createDataFrame([(0, 0, 5), (1, 1, 1)], "i bigint, j bigint, v bigint").write.mode("overwrite").parquet(f"{d}/batch=1")
    assert sorted(map(tuple, kept.kept_matrix(spark, d).collect())) == [(0, 0, 5), (1, 1, 1)]
