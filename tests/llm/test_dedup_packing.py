import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymesh.llm import bloom, components, decontaminate, jaccard_join, line_dedup, packing, shared, textbuf, word_bpe

from .conftest import HOSTILE

BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def kept_lines(rows):
    key = lambda line: ascii_lower(line.strip(BLANK))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (i is not None and len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        out.append((str(i), "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out)


COMMON = "A line that several documents have in common"
LINES = [
    (10, f"first\n{COMMON}\nlast"),
    (11, f"{COMMON}\n{COMMON.upper()}  "),
    (12, f"\t{COMMON}\r\n\nother é"),
    (13, "exactly twenty chars\nx"),
    (14, "EXACTLY TWENTY CHARS"),
    (15, " exactly twenty chars "),
    (16, "nineteen chars long\nnineteen chars long"),
    (17, "nineteen chars long"),
    (18, "nineteen chars long"),
    (19, "öööööööööööööööööööö\n"),
    (20, "öööööööööööööööööööö"),
    (21, "öööööööööööööööööööö"),
    (22, "only two documents have this line"),
    (23, "only two documents have this line\nonly two documents have this line"),
]


@pytest.mark.parametrize("bits", [1 << 26, 1 << 10])
def test_lines(frame, bits):
    rows = [*HOSTILE, *LINES, *LINES[:1]]
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(frame(rows), bits=bits).collect())
    assert got == kept_lines(rows)
    assert line_dedup.dedup_lines(frame([]), bits=bits).collect() == []


def test_bloom(spark):
    df = spark.range(0, 3000, 1, 7).unionByName(spark.range(0, 500, 1, 3))

    def hashes(batch):
        yield textbuf.mixed(batch.column(0).to_numpy().view(np.uint64))

    twice = bloom.Filter(1 << 16, bloom.seen_twice(df, hashes, 1 << 16))
    h = textbuf.mixed(np.arange(3000, dtype=np.uint64))
    assert twice.has(h[:500]).all() and twice.has(h[500:]).mean() < 0.05
    assert bloom.Filter(1 << 16, bloom.seen_once(df, hashes, 1 << 16)).has(h).all()


def test_bloom_grows_with_its_hashes():
    """Two million hashes in filters made for them, merged from several parts: few of those seen once pass, and all that are seen twice do."""
    n, parts = 2_000_000, 8
    bits = bloom.bits_for(n)
    h = textbuf.mixed(np.arange(n, dtype=np.uint64))
    again = h[:1000]
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for k in range(parts):
        own = bloom.Filter(bits)
        own.add(np.concatenate([h[k::parts], again]) if k == 3 else h[k::parts])
        twice |= once & own.data
        once |= own.data
    found = bloom.Filter(data=twice.tobytes())
    assert found.has(again[again != h[3]]).mean() > 0.85  # those of part 3 itself are its own
    assert found.has(h[1000:]).mean() < (1 - np.exp(-3 / 8)) ** 3  # others have all three bits
    assert bloom.bits_for(0) == bloom.LEAST_BITS and bloom.bits_for(10**12) == bloom.MOST_BITS and bits > 8 * n // 2


def test_many_distinct_lines_stay_where_they_are(frame):
    """With far more lines than the smallest filter has bits, few lines seen once are suspects."""
    per_doc, docs = 1500, 800
    rows = [(i, "\n".join(f"line {i} of this document, number {k}" for k in range(per_doc)) + "\nthe same last line everywhere, yes") for i in range(docs)]
    base = shared.keyed(frame(rows, 8))
    assert per_doc * docs > bloom.LEAST_BITS
    suspects, repeated = line_dedup.repeated_lines(base)
    assert docs <= suspects.count() < docs + 0.03 * per_doc * docs
    assert [r.keeper for r in repeated.collect()] == [docs - 1]


def shingles(text):
    w = ascii_lower(text or "").encode().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_rows():
    rng = random.Random(9)
    rows, n = [], 0
    for size in (4, 5, 6, 8, 9, 12, 20, 47, 48, 60, 100, 300, 900):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, size // 40))):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(0, 2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(0, 3)
            rows.append((n, " ".join(w)))
            n += 1
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(n + k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for k in range(40)]
    rows += [(n + 100 + k, passage) for k in range(5)]
    # a chain: each links with the next one, the ends don't
    chain = [f"c{k}" for k in range(120)]
    rows += [(n + 200 + k, " ".join(chain[8 * k : 8 * k + 60])) for k in range(6)]
    return rows


@pytest.mark.parametrize("few,block,closest", [(8, 1024, 8), (2, 8, 1)])
def test_near_equals_brute_force(frame, monkeypatch, few, block, closest):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "CLOSEST", closest)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(components, "ALONE", 1 << 21 if few == 8 else 0)
    rows = near_rows()
    found = jaccard_join.near_duplicates(frame(rows, 3), carry=("row", "key")).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    want = brute_components(rows)
    assert got == want and all((r.rest.row, r.rest.key) == (3, 4) for r in found)
    assert len({c for _, c in want.values()}) < len(rows) - 60


def test_near_query_equals_all_pairs(spark):
    """The registered query over the whole table of the second smallest size."""
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = {}
    for s in holders.values():
        for n, a in enumerate(s):
            for b in s[:n]:
                common[min(a, b), max(a, b)] = common.get((min(a, b), max(a, b)), 0) + 1
    edges = [pair for pair, n in common.items() if 100 * n >= 80 * (len(sets[pair[0]]) + len(sets[pair[1]]) - n)]
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op9_jaccard_join(spark, folder).collect()}
    assert edges and got == {i: (len(sets[i]), root(i)) for i in sets}


def test_hot_passage_copies_no_rows(frame, monkeypatch):
    """Sets that share a passage and mostly differ in too much beside it don't meet; those that hang together meet pivots only."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 32)
    rng, passage = random.Random(12), " ".join(f"p{k}" for k in range(40))
    long = " ".join(f"l{k}" for k in range(180))
    fresh = iter(range(10**6))
    unlike = [(k, passage + "".join(f" q{next(fresh)}" for _ in range(rng.randrange(5, 10)))) for k in range(500)]
    alike = [(2000 + k, long + "".join(f" q{next(fresh)}" for _ in range(rng.randrange(1, 9)))) for k in range(500)]
    # links that only some of a group have: the nearer to the bare passage, the more partners
    mixed = [(4000 + k, " ".join(f"m{i}" for i in range(40)) + "".join(f" q{next(fresh)}" for _ in range(2 + k % 8))) for k in range(200)]
    rows = unlike + alike + mixed
    copies = []
    blocks = jaccard_join._in_blocks

    def counted(members):
        copies.append((members.count(), members.select("cid").distinct().count()))
        return blocks(members)

    monkeypatch.setattr(jaccard_join, "_in_blocks", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(rows, 4)).collect()}
    assert got == brute_components(rows)
    assert len({got[k][1] for k, _ in unlike}) == 500 and len({got[k][1] for k, _ in alike}) == 1
    assert all(sets <= 200 for _, sets in copies), copies


def test_places_bound_what_differs():
    """Two sets that are similar have a key in common before which both together show no more than may differ."""
    rng = np.random.Generator(np.random.PCG64(21))
    hot = rng.integers(0, 3, 1 << 22).astype(np.int32)
    for n in (3, 9, 10, 40, 90, 127):
        for _ in range(30):
            out = int(rng.integers(0, n // 9 + 1))
            base = np.unique(rng.integers(0, 2**63, n + 2 * out, dtype=np.uint64))
            a, b = base[: n + out], np.concatenate([base[:n], base[n + out :]])
            b = np.sort(b)
            if 100 * n < 80 * (n + 2 * out) or len(base) < n + 2 * out:
                continue
            both = np.concatenate([a, b])
            at = np.array([0, len(a), len(a) + len(b)])
            which, key, place = jaccard_join.placed_keys(both, at, hot)
            x, y = ({k: p for w, k, p in zip(which.tolist(), key.tolist(), place.tolist(), strict=True) if w == side} for side in (0, 1))
            assert any(9 * (x[k] + y[k]) <= len(a) + len(b) for k in x.keys() & y.keys())


def test_unrelated_sets_share_no_key():
    rng = np.random.Generator(np.random.PCG64(8))
    hot = np.zeros(1 << 22, np.int32)
    for size in (1, 7, 56, 57, 58, 100, 116, 117, 118, 127, 128, 129, 150, 159, 160, 255, 256, 300, 1000):
        sets = [np.sort(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)) for _ in range(400)]
        _, keys = jaccard_join.sketch_keys(np.concatenate(sets), np.arange(401) * size, hot)
        assert len(np.unique(keys)) == len(keys)


def test_forest_spans_what_is_near():
    rng = np.random.default_rng(5)
    d = rng.random((60, 60)).astype(np.float32)
    d = np.minimum(d, d.T)
    d[d > 0.03] = np.inf
    links = jaccard_join.forest(d)
    edges = [(i, j) for i, j in zip(*np.nonzero(np.isfinite(d)), strict=True) if i != j]

    def groups(links):
        label = list(range(60))
        for _ in range(60):
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert groups(links) == groups(edges) and len(links) == 60 - len(set(groups(edges)))
    assert jaccard_join.forest(np.zeros((0, 0), np.float32)) == []


def test_near_hostile(frame):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(frame(HOSTILE)).collect())
    want = sorted((str(i), len(shingles(t)), "None" if i is None else "5" if i == 8 else str(i)) for i, t in HOSTILE)
    assert got == want
    assert jaccard_join.near_duplicates(frame([])).collect() == []


def test_sketch_bounds():
    """Hamming distances never exceed the symmetric difference, and similar sets share a key."""
    rng = np.random.Generator(np.random.PCG64(2))
    hot = np.zeros(1 << 22, np.int32)
    for size in (1, 5, 9, 30, 48, 95, 96, 200, 700, 3000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for change in {0, 1, size // 20, size // 10}:
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 2**63, change // 2, dtype=np.uint64)]))
            if not len(b):
                continue
            both, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            inter = len(np.intersect1d(a, b))
            which, keys = jaccard_join.sketch_keys(both, at, hot)
            if 100 * inter >= 80 * (len(a) + len(b) - inter):
                assert set(keys[which == 0].tolist()) & set(keys[which == 1].tolist())
            bits = [np.array(x, np.int64).view(np.uint64) for x in jaccard_join.bit_sketches(both, at).to_pylist()]
            while len(bits[0]) != len(bits[1]):
                k = int(len(bits[1]) > len(bits[0]))
                half = len(bits[k]) // 2
                bits[k] = bits[k][:half] ^ bits[k][half:]
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(a) + len(b) - 2 * inter


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, 500), (7, None), (200, 300), (200, 300)]
    got, also = ({r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), alone=alone).collect()} for alone in (0, 10**6))
    assert got == also
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}
    for alone in (0, 10):
        assert components.components(spark.createDataFrame([], "a long, b long"), alone=alone).collect() == []
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame(edges, "a long, b long"), rounds=1, alone=0)


ITEMS = [(1, "One two three four five six seven eight nine ten ELEVEN."), (2, "short item"), (2, None), (None, "no id but text"), (3, "five six seven eight nine ten eleven twelve thirteen fourteen"), (4, "one two one two one two one two one two one two"), (10, "Größe zählt"), (5, ""), (6, "word")]
PASSAGES = [
    (1, "x one two, three-four five six seven eight nine ten y"),
    (2, "one two three four five six seven eight nine TEN eleven twelve thirteen fourteen fifteen"),
    (3, "a SHORT! item; short item"),
    (4, "short, er item"),
    (5, "one two one two one two one two one two one two one two"),
    (6, "größe zählt Größe zählt"),
    (7, "one two three four five six seven eight nine"),
    (8, "the word in a text"),
]


def words(text):
    table = {c for c in map(chr, range(128)) if not (c.isdigit() or c.islower())}
    return "".join(" " if c in table else c for c in ascii_lower(text or "")).split(" ") and [w for w in "".join(" " if c in table else c for c in ascii_lower(text or "")).split(" ") if w]


def brute_hits(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            x = words(text)
            if item is None or not x:
                continue
            n = min(len(x), 10)
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((str(i), len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


@pytest.mark.parametrize(("shard", "held"), [(10**6, 1 << 28), (12, 1 << 28), (12, 1)])
def test_decontamination(frame, spark, shard, held):
    rows = [*HOSTILE, *PASSAGES]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_hits(frame(rows), items, shard_words=shard, pass_bytes=held, with_text=True, carry=("lang", "block")).withColumn("n_hit", decontaminate.n_hit()).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in found) == brute_hits(rows, ITEMS)
    assert all(r.rest.block == 2 for r in found)
    for r in found:
        for h in r.hits:
            assert words(r.text[h.start : h.end]) == words(r.text)[h.first : h.last]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton_equals_brute_force(items, doc):
    a = decontaminate.Automaton([(str(k), [w.encode() for w in x]) for k, x in enumerate(items)], 4)
    monkey = decontaminate.LANE
    got = []
    try:
        for decontaminate.LANE in (monkey, 5):  # long stretches are cut into lanes
            ranges = decontaminate.textbuf.Ranges(303)
            raw = np.frombuffer("".join(doc).encode(), np.uint8)
            at = np.arange(len(doc))
            code = a.code(ranges.over(raw).hash(at, at + 1)) if len(doc) else np.zeros(0, np.int64)
            x, y, texts, found = a.occurrences(code, np.array([0, len(doc)]))
            got.append((set().union(*(range(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True))), {a.names[i] for i in found}))
            assert not texts.any()
    finally:
        decontaminate.LANE = monkey
    want = {(k, k + n, str(i)) for i, x in enumerate(items) if x for n in (min(len(x), 4),) for k in range(len(doc) - n + 1) for j in range(len(x) - n + 1) if doc[k : k + n] == x[j : j + n]}
    assert got == [({p for x, y, _ in want for p in range(x, y)}, {i for _, _, i in want})] * 2


def test_automaton_is_small():
    """Repetitive and random items of 200,000 words: under 150 bytes a word, in seconds."""
    rng = np.random.default_rng(4)
    items = [(str(i), [b"w%d" % w for w in rng.zipf(1.3, 500) % 5000]) for i in range(390)] + [("rep", [b"ab"] * 5000)]
    a = decontaminate.Automaton(items, 10)
    assert a.bytes < 150 * 200_000
    ids = {w: n for n, w in enumerate(dict.fromkeys(w for _, x in items for w in x))}
    code = np.array([ids[w] for w in items[7][1]])
    x, y, _, found = a.occurrences(code, np.array([0, 500]))
    assert "7" in {a.names[i] for i in found} and set().union(*(range(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True))) == set(range(500))


def test_removal(frame, spark):
    items = spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    text = "Before. One two three four five six seven eight nine ten! " + "More words go on and on. " * 9
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(frame([(1, text), (2, "short item"), (3, "clean"), (4, None), (5, "short item é short item 日本 a b c d e f g h")]), items).collect()}
    assert got == {1: text.replace("One two three four five six seven eight nine ten", ""), 3: "clean", 4: "", 5: " é  日本 a b c d e f g h"}
    assert decontaminate.find_hits(frame([(1, "x")]), items.limit(0)).first().hits == []


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.tokenizer_file()).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    spec = packing.tokenizer_file()
    plain, coder = Tokenizer.from_str(spec), word_bpe.Coder(spec)
    rng = random.Random(6)
    letters = "abcdefgh éÈßñ×÷ªµº¹²½ 0123456789 ,.;!?###$$$&&&\t\n\x0b\x85\xa0\x1c\x1f\x00ABCÀÖ'"
    texts = ["", "it's they're o'clock 'sx", "日本語 Ünïcödé İstanbul ΣΑΣ", "x" * 200, "T̈ é", "<|endoftext|> <|startoftext|>", "hello WORLD 12345 ¼½", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(300))]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(frame):
    rng = random.Random(8)
    rows = [*((i, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(1, 400)))) for i in range(100, 400)), *HOSTILE]
    got = packing.pack_documents(frame(rows, 3)).collect()
    ids = {str(i): [*library(t or ""), 0] for i, t in rows}
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[str(r.doc_id)].append(r)
        part = np.array(ids[str(r.doc_id)][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.start == r.piece * 2048
    copies = collections.Counter(str(i) for i, _ in rows)
    for d, n in copies.items():
        assert sum(r.length for r in by_doc[d]) == n * len(ids[d])
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) * 1.02 + 1
    assert packing.pack_documents(frame([])).collect() == []


def test_rounds_lose_nothing(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randrange(1, 61), i) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), size=100, block=64, slack=1).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 100 and len(fill) <= 1.03 * sum(r[3] for r in rows) / 100 + 1


def test_rows_alike_are_dealt_apart(spark):
    """Rows that share everything fill many blocks, and no sequence number is given twice."""
    n = 6000
    rows = spark.range(n).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0 AS piece", "CAST(0 AS BIGINT) AS start", "CAST(60 AS BIGINT) AS length", "CAST(7 AS BIGINT) AS ids_crc32")
    got = packing.pack(shared.stored(rows), size=100, block=64).collect()
    assert len(got) == n and len({r.sequence_id for r in got}) == n and {r.offset for r in got} == {0}


def test_sum_of_squares_rule():
    """Each step has the least sum of squares of all places, new bins included."""
    rng = random.Random(5)
    lengths = [rng.randrange(1, 21) for _ in range(200)]
    where, _, _ = packing.sum_of_squares(lengths, 20)
    fill: list[int] = []
    value = lambda f: sum(n * n for g, n in collections.Counter(20 - x for x in f).items() if g)
    for n, b in zip(lengths, where, strict=True):
        if n == 20:
            options = None
        else:
            options = [value([*fill, n]), *(value([*fill[:k], fill[k] + n, *fill[k + 1 :]]) for k in range(len(fill)) if fill[k] + n <= 20)]
        if b == len(fill):
            fill.append(n)
        else:
            fill[b] += n
        assert options is None or value(fill) == min(options)


def test_digest_queries_have_their_columns(spark, tmp_path):
    spark.createDataFrame(LINES, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert line_dedup.op10_line_dedup(spark, str(tmp_path)).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    r = decontaminate.op8_decontamination(spark, str(tmp_path)).where("doc_id = 10").first()
    assert (r.n_items, r.items_sha256, r.contaminated) == (0, hashlib.sha256(b"").hexdigest(), False)
    assert jaccard_join.op9_jaccard_join(spark, str(tmp_path)).columns == ["doc_id", "n_shingles", "component_id"]
    assert pa.array([1]).to_pylist() == [1]
