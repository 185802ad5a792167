import re
from collections import Counter

import duckdb
import numpy as np

from waymesh.llm import source_divergence

from .conftest import HOSTILE

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, terms=200):
    """``(lang, source, part, item): (value, rank)`` from ``(lang, source, text)``."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)))) for lang, source, text in rows]
    out = {}

    def ranked(lang, source, part, values):
        best = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
        out.update({(lang, source, part, item): (v, k) for k, (item, v) in enumerate(best, 1) if part == "pair" or k <= terms})

    for lang in {r[0] for r in found}:
        docs = Counter(t for r in found if r[0] == lang for t in r[2])
        kept = [t for t, n in docs.items() if n >= least]
        count = {s: sum((r[2] for r in found if r[:2] == (lang, s)), Counter()) for s in {r[1] for r in found if r[0] == lang}}
        count[None] = sum(count.values(), Counter())
        total = {s: sum(c[t] for t in kept) + len(kept) for s, c in count.items()}
        p = {s: {t: 1 + 1000000000 * (c[t] + 1) // total[s] for t in kept} for s, c in count.items()}
        f = lambda x, y: (x - y) ** 2 // y
        for s in set(count) - {None}:
            ranked(lang, s, "pair", {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in set(count) - {None, s}})
            ranked(lang, s, "term", {t: f(p[s][t], p[None][t]) for t in kept if count[s][t] and p[s][t] > p[None][t]})
    return out


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n int, term string").repartition(3)
    found = source_divergence.divergence(df, **sizes).collect()
    got = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in found}
    assert len(got) == len(found) and got == brute(rows, terms=sizes.get("terms", 200))
    return got


def invented(seed, docs, sources, words):
    rng = np.random.default_rng(seed)
    return [(("en", "fr", None)[k % 3], f"s{k * k % sources}", " ".join(f"W{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10 % 10]}é" for x in rng.zipf(1.3, 60) % words)) for k in range(docs)]


def test_tiles_equal_brute_force(spark):
    rows = invented(1, 120, 9, 80)
    got = check(spark, rows, block=2, chunk=7, slab=3)
    assert got == check(spark, rows) and any(k[2] == "term" for k in got)
    assert len(check(spark, rows, terms=2)) < len(got)


def test_nulls_ties_and_groups_without_terms(spark):
    rows = [(None, None, None), (None, "a", ""), ("", "b", "same same Same"), ("", "b", "same"), (None, "c", "SAME same 12 same"), ("de", "a", "alone"), ("xx", "a", "1 2"), ("xx", "b", None)]
    got = check(spark, [*rows, *rows])
    # neither group of a language without kept terms differs
    assert got["xx", "a", "pair", "b"] == (0, 1) and ("", "c", "pair", "") in got
    assert not any(k[0] == "de" and k[2] == "pair" for k in got)


def test_one_source_with_most_rows_and_long_texts(spark):
    long = " ".join(f"term{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(40_000))
    check(spark, [("en", "hot", f"the common words again {'abc'[k % 3]}x") for k in range(300)] + [("en", f"s{k % 4}", long[k * 100 :]) for k in range(4)] + [("en", "s9", "the the")], block=2, chunk=50)


def test_hostile_and_empty(hostile):
    found = source_divergence.divergence(hostile).collect()
    langs = {k: ("en" if k % 2 else "fr", f"s{k % 3}") for k in range(len(HOSTILE))}
    assert {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in found} == brute([(*langs[k], t) for k, (_, t) in enumerate(HOSTILE)])
    assert source_divergence.divergence(hostile.limit(0)).count() == 0


def test_shares_of_large_counts():
    for count, total in ((0, 1), (9_999_999_999_999, 10_000_000_000_123), (7, 280_000_000_000_000), (279_999_999_999_998, 280_000_000_000_000)):
        want = 1 + 1000000000 * (count + 1) // total
        assert source_divergence._shares(np.array([[count]]), np.array([[total]]))[0, 0] == want


def test_query_equals_its_statement(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(map(tuple, source_divergence.op11_source_divergence(spark, d).collect())) == sorted(con.sql(source_divergence.SQL).fetchall())
