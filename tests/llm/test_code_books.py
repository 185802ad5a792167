import hashlib
import math

import numpy as np
import pytest

from waymesh.llm import code_books


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Codes, errors and codebooks of ``(vec_id, vector, label)``, in plain integers; rows that are to be left out are none of them."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    x = [[math.floor(scale * c) for c in r[1]] for r in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for v in x] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            to = [nearest(p, v)[1] for v in cut[p]]
            of = [[v for v, t in zip(cut[p], to, strict=True) if t == k] for k in range(len(books[p]))]
            new.append([[sum(c) // len(vs) for c in zip(*vs, strict=True)] if vs else books[p][k] for k, vs in enumerate(of)])
        books = new
    both = [[nearest(p, cut[p][i]) for p in range(parts)] for i in range(len(x))]
    return [(r[0], "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), r[2]) for r, b in zip(rows, both, strict=True)], books


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, lab, b"x", 3) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code binary, n int").repartition(3)


def same(found, books, rows, **sizes):
    want, want_books = brute(rows, **sizes)
    got = [(r.vec_id, bytes(r.code).hex(), r.error, None if r.label is None else int(r.label)) for r in found.collect()]
    key = lambda r: (str(r[0]), *r[1:3], str(r[3]))
    assert sorted(got, key=key) == sorted(want, key=key) and books.tolist() == want_books


def test_bounds_change_nothing(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (30, 32))
    rows = [(i, (centres[i % 30] + rng.normal(0, 0.2, 32)).astype(np.float32).tolist(), i % 5 or None) for i in range(500)]
    found, books = code_books.learn(table(spark, rows))
    same(found, books, rows)


def test_ties_repeats_and_few_rows(spark):
    """Components on a coarse lattice: equal distances everywhere, equal entries, entries that nothing uses."""
    rng = np.random.default_rng(4)
    rows = [(i % 150, (rng.integers(-2, 3, 16) / 128).tolist(), i % 3) for i in range(300)] + [(None, [0.0] * 16, None)] * 2
    found, books = code_books.learn(table(spark, rows), rounds=4)
    same(found, books, rows, rounds=4)
    found, books = code_books.learn(table(spark, rows[:3], "double"), parts=4, entries=5)
    same(found, books, rows[:3], parts=4, entries=5)


def test_bounds_save_measurements():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (2000, 4))
    books = x[None, :64]
    first = code_books.Assigner(books, None)
    code, upper, lower = first.first(0, x)
    after = books + rng.integers(-20, 21, books.shape)
    again = code_books.Assigner(after, books)
    packed = code_books._packed(lower[:, None], code_books._above(upper[:, None]))
    kept = code_books._unpacked(packed, code_books._above(upper[:, None]), 64)
    assert (kept[:, 0] <= lower).all()
    new, up, low = again.again(0, x, code, upper.copy(), kept[:, 0])
    d = code_books._measured(x, after[0])
    assert (new == d.argmin(1)).all() and (up**2 >= d.min(1)).all() and (low**2 <= d * (1 + 1e-9)).all()
    assert again.measured < 0.5 * x.shape[0] * 64 and again.measured + again.saved == x.shape[0] * 64


def test_left_out_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [i / 7.0 - 1, -i / 9.0, 0.1, 0.2], 1) for i in range(9)]
    bad = [(-1, None, 1), (-2, [nan, 0.0, 0.0, 0.0], 1), (-3, [0.0, inf, 0.0, 0.0], 1), (-4, [0.0, -inf, 0.0, 0.0], 1), (-5, [0.0, None, 0.0, 0.0], 1), (-6, [], 1), (-7, [1.0, 2.0, 3.0], 1), (50, [1.0] * 8, 1)]
    found, books = code_books.learn(table(spark, good + bad), parts=4, entries=4)
    same(found, books, good, parts=4, entries=4)
    for rows in ([], bad[:6]):
        found, books = code_books.learn(table(spark, rows))
        assert found.count() == 0 and books.size == 0


def test_components_beyond_exact_sums(spark):
    with pytest.raises(Exception, match="too large"):
        code_books.learn(table(spark, [(1, [1e30] * 16, 1)]))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, books = brute(rows)
    label = {}
    for r in want:
        label[r[3]] = label.get(r[3], 0) + r[2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    got = code_books.op12_vector_codes(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted((i, code, error, label[lab], digest) for i, code, error, lab in want)


def test_query_of_nothing(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert code_books.op12_vector_codes(spark, str(tmp_path)).count() == 0
