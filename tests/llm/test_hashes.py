"""Byte ranges that collide under any polynomial modulo a power of two must not be taken for each other."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh.llm import bloom, decontaminate, jaccard_join, lattice, line_dedup, lm_scoring, packing, textbuf, word_bpe

LENGTH = 1 << 11
PARITY = [bin(i).count("1") & 1 for i in range(LENGTH)]
A = "".join("ab"[b] for b in PARITY)
B = "".join("ba"[b] for b in PARITY)


@pytest.mark.parametrize("n", [8, 16, 24, 32, 33, 64, 512, 1024, 2048])
@pytest.mark.parametrize("seed", [101, 303, 606, 808, 909])
def test_ranges(n, seed):
    data = np.frombuffer((A[:n] + B[:n] + A[:n]).encode(), np.uint8)
    h = textbuf.Ranges(seed).over(data).hash(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] != h[1] and h[0] == h[2]


def test_ranges_equal_bytes_only():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 20_000)
    end = start + rng.integers(0, 40, 20_000)
    h = textbuf.Ranges(5).over(data).hash(start, end)
    seen = {}
    for a, b, x in zip(start.tolist(), end.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(data[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
    # the bytes after a range don't matter, nor where it lies
    assert textbuf.Ranges(5).over(data[7:30]).hash(np.array([0]), np.array([20])) == textbuf.Ranges(5).over(data).hash(np.array([7]), np.array([27]))


def test_lines(frame):
    """A line of two documents and its complement in a third: no line is in three documents."""
    rows = [(1, A), (2, A), (3, B)]
    assert {(r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(rows)).collect()} == set(rows)


def test_words_of_all_operators(frame, spark):
    near = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(frame([(1, A), (2, B), (3, A)])).collect()}
    assert near == {1: 1, 2: 2, 3: 1}
    found = decontaminate.find_hits(frame([(1, A), (2, B)]), spark.createDataFrame([(7, A)], "item_id long, text string"))
    assert {r.doc_id: len(r.hits) for r in found.collect()} == {1: 1, 2: 0}
    scored = {r.doc_id: r.n_known for r in lm_scoring.score(frame([(1, A), (2, B)]), F.col("doc_id") == 1).collect()}
    assert scored == {1: 2, 2: 1}
    pieces = [b" a", b"ab", b"abba"]
    grid = lattice.Lattice(pieces)
    data = np.frombuffer((A + B).encode(), np.uint8)
    start, end = np.array([0, LENGTH]), np.array([LENGTH, 2 * LENGTH])
    weights = grid.scaled(np.concatenate([[0.5, 0.1, 0.2], np.full(256, 1e-3)]))
    got = lattice.Memo(grid, weights).sums(data, start, end, textbuf.Ranges(808).over(data).hash(start, end))
    assert got[0, 0] != got[1, 0]
    spec = packing.tokenizer_file()
    coder = word_bpe.Coder(spec)
    a, b = coder.encode([A, B])
    assert a.tolist() == coder.library(A).tolist() and b.tolist() == coder.library(B).tolist() and pa.array(a) != pa.array(b)


def test_parted_by_a_filter(spark):
    rows = spark.range(5000).selectExpr("cast(id as int) AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(None, "no id"), (7, "again")], "doc_id int, text string"))
    some, others = bloom.parted(rows, spark.createDataFrame([(7,), (4000,), (-1,)], "of long"))
    assert some.schema == others.schema == rows.schema
    a, b = ([(r.doc_id, r.text) for r in x.collect()] for x in (some, others))
    assert sorted(map(str, a + b)) == sorted(str((r.doc_id, r.text)) for r in rows.collect())
    assert {(7, "text 7"), (7, "again"), (4000, "text 4000")} <= set(a) and len(a) < 50 and (None, "no id") in b
    assert "Exchange" not in others._jdf.queryExecution().executedPlan().toString()
    none, every = bloom.parted(rows, spark.createDataFrame([], "of long"))
    assert none.count() == 0 and every.count() == 5002
