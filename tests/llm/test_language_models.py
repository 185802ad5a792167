import collections
import functools
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh.llm import language_id, lattice, lm_scoring, shared, textbuf, toxicity

from .conftest import HOSTILE

PIECES = [b" a", b" ab", b"b", b"ba", b"bab", b" ", b"a"]
PROBABILITY = np.concatenate([np.arange(1, 8) / 30, np.full(256, 1e-4)])


def by_hand(word):
    """The sum over all segmentations of a word's bytes, each cut tried."""
    raw, total = b" " + word, 0.0
    single = {bytes([b]): 1e-4 for b in range(256)}
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(raw)), k) for k in range(len(raw))):
        p = 1.0
        for a, b in zip((0, *cuts), (*cuts, len(raw)), strict=True):
            part = raw[a:b]
            options = (PROBABILITY[PIECES.index(part)] if part in PIECES else 0) + single.get(part, 0)
            p *= options
        total += p
    return math.log(total)


def laid(words):
    raw = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    return lattice.spaced(raw, np.concatenate([[0], stop[:-1]]), stop)


def test_forward_equals_all_segmentations(monkeypatch):
    words = [b"a", b"ab", b"bab", b"abab", b"zz", b"ababbabab", "é".encode()]
    grid = lattice.Lattice(PIECES)
    got = grid.forward(*laid(words), grid.scaled(PROBABILITY))[:, 0]
    assert got == pytest.approx([by_hand(w) for w in words])
    monkeypatch.setattr(lattice, "SHORT", 2)  # the path for long words
    assert grid.forward(*laid(words), grid.scaled(PROBABILITY))[:, 0] == pytest.approx([by_hand(w) for w in words])
    assert np.isfinite(grid.forward(*laid([b"ab" * 20_000]), grid.scaled(PROBABILITY))).all()


def test_expected_uses():
    words = [b"ab", b"bab", b"abab"]
    grid = lattice.Lattice(PIECES)
    weights = grid.scaled(PROBABILITY)
    uses = grid.expected(*laid(words), np.array([1.0, 2.0, 1.0]), weights)
    length = np.concatenate([[len(p) for p in PIECES], np.ones(256)])
    assert (uses * length).sum() == pytest.approx(3 + 2 * 4 + 5)  # every byte is covered once
    h = 1e-6  # a use is the derivative of the logarithm by that of the probability
    more = PROBABILITY.copy()
    more[3] *= 1 + h
    change = grid.forward(*laid(words), grid.scaled(more)) - grid.forward(*laid(words), weights)
    assert uses[3] == pytest.approx((change[:, 0] * [1, 2, 1]).sum() / h, rel=1e-3)


def test_expected_uses_of_long_words(monkeypatch):
    grid = lattice.Lattice(PIECES)
    weights = grid.scaled(PROBABILITY)
    words, count = [b"ab", b"bab", b"ababbabab", "é".encode()], np.array([1.0, 2.0, 1.0, 3.0])
    short = grid.expected(*laid(words), count, weights)
    monkeypatch.setattr(lattice, "SHORT", 1)  # the path for long words
    assert grid.expected(*laid(words), count, weights) == pytest.approx(short)
    monkeypatch.undo()
    uses = grid.expected(*laid([b"ab" * 100]), np.ones(1), weights)
    length = np.concatenate([[len(p) for p in PIECES], np.ones(256)])
    assert (uses * length).sum() == pytest.approx(201)  # every byte is covered once
    fitted, prior = uses + PROBABILITY, PROBABILITY
    assert not np.allclose(fitted / fitted.sum(), prior / prior.sum())
    assert (grid.expected(*laid([b"ab" * 50_000]), np.ones(1), weights) * length).sum() == pytest.approx(100_001)


def texts(n):
    rng = np.random.default_rng(n)
    parts = {"en": ["the", "ing", "tion", "wh", "er", "and"], "de": ["sch", "ung", "der", "keit", "ä", "und"]}
    return [(i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(30)), lang) for i in range(n) for lang in (["en", "de"][i % 2],)]


def test_language(spark, hostile):
    docs = spark.createDataFrame(texts(200), "doc_id long, text string, lang string")
    model = language_id.fit(docs, train=shared.fold(F.col("doc_id"), 5) != 0, per_language=40)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [(i, lang) for i, _, lang in texts(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    odd = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(hostile, model).collect()]
    assert len(odd) == len(HOSTILE) and all(0 <= s <= 1 for _, _, s in odd)
    assert {p for i, p, _ in odd if i in (1, 2, 3)} == {"und"} and {p for i, p, _ in odd if i in (4, 6)} <= {"en", "de"}
    one = spark.createDataFrame([(1, "1234 €€ ×÷ --")], "doc_id long, text string")
    assert language_id.identify(one, model).first().lang_pred == "und"


def test_language_query_equals_brute_force(spark, tmp_path):
    """The registered query's fit and predictions, word by word over all segmentations."""
    rows = [(i, t, lang) for i, t, lang in texts(60)] + [(100, None, "en"), (101, "12 34", None), (102, "the therand undkeit", None), (103, "x" * 70, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language_id.op4_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    pieces, prior = lattice.vocabulary()
    start = np.concatenate([prior * 0.99, np.full(256, 0.01 / 256)])
    every = [*pieces, *(bytes([b]) for b in range(256))]
    at = {}
    for n, piece in enumerate(every):
        at.setdefault(piece, []).append(n)
    split = lambda t: re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())

    def arcs(raw):
        return [(a, b, n) for a in range(len(raw)) for b in range(a + 1, len(raw) + 1) for n in at.get(raw[a:b], ())]

    def sums(raw, p):
        """The sum over all segmentations, and each piece's expected uses."""
        forward, backward, found = [1.0] + [0.0] * len(raw), [0.0] * len(raw) + [1.0], sorted(arcs(raw))
        for a, b, n in found:
            forward[b] += forward[a] * p[n]
        for a, b, n in sorted(found, key=lambda x: -x[1]):
            backward[a] += backward[b] * p[n]
        return forward[-1], [(n, forward[a] * p[n] * backward[b] / forward[-1]) for a, b, n in found]

    model = {}
    for lang in ("de", "en"):
        counts = collections.Counter(w for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 5 for w in split(t))
        p = start
        for _ in range(language_id.PASSES):
            uses = language_id.PRIOR * start
            for w, c in counts.items():
                for n, use in sums(b" " + w, p)[1]:
                    uses[n] += c * use
            p = uses / uses.sum()
        model[lang] = p
    known = {}
    for i, t, _ in rows:
        words = split(t)
        if i in (100, 101):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        for w in words:
            if w not in known:
                known[w] = [math.log(sums(b" " + w, model[lang])[0]) for lang in ("de", "en")]
        total = [sum(known[w][k] for w in words) * min(1, language_id.SCORE_WORDS / len(words)) for k in (0, 1)]
        share = [1 / (1 + math.exp(min(total[1 - k] - total[k], 500))) for k in (0, 1)]
        assert got[i].lang_pred == ("de" if share[0] >= share[1] else "en"), i
        assert got[i].score == pytest.approx(max(share), abs=1e-6) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_samples_are_bounded(spark):
    """Rows alike in id and text, or with null ids, don't swell the fitted samples."""
    docs = spark.range(4000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "IF(id % 4 < 3, 'the same text', concat('text number ', id)) AS text", "'en' AS lang")
    model = language_id.fit(docs, per_language=50)
    assert model.languages == ["en"]
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs.selectExpr("doc_id", "text", "concat('l', monotonically_increasing_id()) AS lang"))


def test_language_without_training(frame, spark):
    none = language_id.fit(frame([]))
    assert none.languages == [] and language_id.identify(frame([(1, "words")]), none).first().lang_pred == "und"
    assert language_id.identify(frame([]), none).collect() == []


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 2000])
def test_lm_counts_and_base(frame, chunk_bytes):
    rows = [*HOSTILE, *((i + 100, " ".join(f"w{(i * j) % 13} Common" for j in range(40))) for i in range(30))]
    train = shared.fold(F.col("doc_id"), 10) != 0
    got = lm_scoring.score(frame(rows), train, chunk_bytes=chunk_bytes).collect()
    assert len(got) == len(rows)
    counts, ends = collections.Counter(), 0
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    for i, words in split:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(words)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = sorted((str(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in (*(counts[x] for x in w), ends)), 3)) for i, w in split)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)


def all_segmentations(raw, pieces, log_p):
    """The logarithm of the sum over all segmentations of a word with its space, by plain recursion over its first piece."""
    weight = {}
    for piece, x in zip([*pieces, *(bytes([b]) for b in range(256))], log_p, strict=True):
        weight.setdefault(piece, []).append(math.exp(x))

    @functools.cache
    def total(at):
        if at == len(raw):
            return 1.0
        return sum(x * total(end) for end in range(at + 1, len(raw) + 1) for x in weight.get(raw[at:end], ()))

    return math.log(total(0))


def test_lm_query_equals_all_segmentations(spark, tmp_path):
    """The registered query on a small table: every score is the document's sum over all segmentations."""
    rows = [(i, " ".join(f"{a}{b}" for a in ("The", "cat", "naïve", "q") for b in ("", "s", str(i)))) for i in range(25)]
    rows += [(100, "un" * 30), (101, ""), (102, None), (103, "  x\ty  x ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.op3_lattice_lm(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    words = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    tokens = sum(len(words[i]) for i in train) + len(train)
    end = (len(train) + 0.5) / (tokens + 1)
    pieces, log_p = lm_scoring.piece_scores()
    assert np.exp(log_p).sum() == pytest.approx(1)
    going_on = log_p + math.log1p(-end)
    for i, r in got.items():
        want = sum(all_segmentations(b" " + w, pieces, going_on) for w in words[i]) + math.log(end)
        assert r.score == pytest.approx(want / math.log(10)), i
        assert r.held_out == (i not in train) and r.n_tokens == len(words[i]) + 1


def test_lm_learns_words(spark, tmp_path):
    """From LEAST training words on, words' counts are mixed with their sums over all segmentations, and held-out texts score nearly as the base model does."""
    rows = [(i, " ".join(f"Zq{(i * j * j + j) % 97}x{j % 7}" for j in range(40)) + (f" rare{i}" if i % 3 == 0 else "")) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.op3_lattice_lm(spark, str(tmp_path)).collect()}
    words = {i: t.lower().encode().split() for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for i in train for w in words[i])
    n, v = sum(count.values()), len(count)
    assert n >= lm_scoring.LEAST
    end = (len(train) + 0.5) / (n + len(train) + 1)
    pieces, log_p = lm_scoring.piece_scores()
    going_on = log_p + math.log1p(-end)
    chance = {w: ((1 - end) * count[w] + v * math.exp(all_segmentations(b" " + w, pieces, going_on))) / (n + v) for w in {w for x in words.values() for w in x}}
    assert sum(chance.values()) < 1 - end
    for i, r in got.items():
        assert r.score == pytest.approx((sum(math.log(chance[w]) for w in words[i]) + math.log(end)) / math.log(10)), i
    held = [r for r in got.values() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert held and sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens - 0.5


def test_lm_is_a_distribution():
    """Documents of any number of pieces add up to 1: those of up to twelve pieces nearly so."""
    end, p = 0.3, PROBABILITY / PROBABILITY.sum()
    assert sum(end * ((1 - end) * p.sum()) ** k for k in range(40)) == pytest.approx(1, abs=1e-5)
    grid = lattice.Lattice(PIECES)
    words = [b"a", b"ab", b"bab", b"abab", b"zz", b"ababbabab", "é".encode()]
    logs = grid.log_forward(*laid(words), np.log(PROBABILITY))
    assert logs == pytest.approx([by_hand(w) for w in words])


def test_log_forward_of_long_words(monkeypatch):
    grid, log_p = lattice.Lattice(PIECES), np.log(PROBABILITY)
    words = [b"a", b"ab", b"bab", b"abab", b"zz", b"ababbabab", "é".encode(), b""]
    want = [by_hand(w) for w in words]
    for together in (1, 7, 1 << 18):  # each word alone, some, all
        monkeypatch.setattr(lattice, "TOGETHER", together)
        assert grid.log_forward(*laid(words), log_p) == pytest.approx(want)
        assert grid.forward(*laid(words), grid.scaled(PROBABILITY))[:, 0] == pytest.approx(want)
    long = laid([b"ab" * 40_000, b"ba" * 30])
    assert grid.log_forward(*long, log_p) == pytest.approx(grid.forward(*long, grid.scaled(PROBABILITY))[:, 0])


def test_arcs():
    """All pieces in words, single bytes too, and none beyond a word's end."""
    rng = np.random.default_rng(2)
    pieces = list({bytes(rng.integers(97, 100, rng.integers(1, 6)).astype(np.uint8)) for _ in range(60)})
    grid = lattice.Lattice(pieces)
    raw = rng.integers(96, 101, 400).astype(np.uint8)
    limit = np.repeat(np.arange(20, 401, 20), 20)
    every = [*pieces, *(bytes([b]) for b in range(256))]
    got = sorted(zip(*(x.tolist() for x in grid.arcs(raw, limit)), strict=True))
    want = sorted((a, a + len(p), n) for a in range(400) for n, p in enumerate(every) if raw[a : a + len(p)].tobytes() == p and a + len(p) <= limit[a])
    assert got == want


def test_lm_empty(frame):
    none = F.lit(False)
    assert lm_scoring.score(frame([]), none).collect() == []
    r = lm_scoring.score(frame([(1, "ab ab")]), none).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)


def toxic_rows(n):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(["an", "er", "th", "ing", "st", "or"], 2)) for _ in range(200)]
    out = []
    for i in range(n):
        words = rng.choice(plain, int(rng.integers(3, 200))).tolist()
        bad = i % 3 == 0
        if bad:
            for k in rng.integers(0, len(words), 1 + len(words) // 40):
                words[k] = rng.choice(["idiot", "trash", "scumish"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_gradients():
    rng = np.random.Generator(np.random.PCG64(1))
    net = toxicity.Network(rng)
    x, y, w = rng.normal(size=(4, 3, toxicity.INPUT)), np.array([1.0, 0, 1]), np.ones(3)
    on = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [0, 0, 0, 0]], bool)

    def loss():
        flat = net.projected(x.reshape(-1, toxicity.INPUT)).reshape(2, 4, 3, -1)
        s = net.forward(flat, on)
        return (np.logaddexp(0, s) - y * s).mean()

    grads, dx = net.gradients(x, on, y, w)
    for name, at in [("w", (0, 1, 2)), ("w", (1, 3, 25)), ("u", (0, 2, 3)), ("u", (1, 1, 24)), ("b", (1, 0, 5)), ("aw", (3, 2)), ("av", (1, 0)), ("ow", (4, 0)), ("ob", (0,))]:
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-5
        up = loss()
        net.p[name][at] = keep - 1e-5
        slope = (up - loss()) / 2e-5
        net.p[name][at] = keep
        assert grads[name][at] == pytest.approx(slope, abs=1e-7), name
    keep = x[1, 0, 3]
    x[1, 0, 3] = keep + 1e-5
    up = loss()
    x[1, 0, 3] = keep - 1e-5
    assert dx[1, 0, 3] == pytest.approx((up - loss()) / 2e-5, abs=1e-7)


def test_toxicity_held_out(spark, hostile, monkeypatch):
    rows = toxic_rows(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, shared.fold(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.rate(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= toxicity.THRESHOLD) == y for i, y in held) >= 0.95 * len(held)
    odd = toxicity.rate(hostile, model).collect()
    assert len(odd) == len(HOSTILE) and all(0 <= r.score <= 1 for r in odd)
    # a toxic end of a long text is found
    long = spark.createDataFrame([(1, " ".join(["aner thing"] * 20000)), (2, " ".join(["aner thing"] * 20000) + " idiot trash scumish idiot trash")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.rate(long, model).collect()}
    assert scores[1] < scores[2]


def by_plain_loops(model, text):
    """A text's score: each window word by word, with nothing shared between words, windows or directions."""
    ranges, p = textbuf.Ranges(1010), {k: v.astype(np.float32) for k, v in model.network.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def bucket(raw, size):
        return int(ranges.over(np.frombuffer(raw, np.uint8)).hash(np.array([0]), np.array([len(raw)]))[0]) % size

    words = re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())
    x = []
    for w in words:
        raw = b" " + w + b" "
        grams = [raw[i : i + g] for g in toxicity.GRAMS for i in range(len(raw) - g + 1)]
        x.append(np.concatenate([model.own[bucket(raw, toxicity.WORD_BUCKETS)], np.max([model.chars[bucket(g, toxicity.GRAM_BUCKETS)] for g in grams], 0)]))
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(words):
        starts.append(starts[-1] + toxicity.STRIDE)
    scores = []
    for a in starts:
        window = x[a : a + toxicity.WINDOW]
        states = []
        for side, order in ((0, range(len(window))), (1, range(len(window) - 1, -1, -1))):
            h, own = np.zeros(toxicity.HIDDEN, np.float32), {}
            for t in order:
                g = window[t] @ p["w"][side] + p["b"][side][0]
                k = toxicity.HIDDEN
                z, r = sigmoid(g[:k] + h @ p["u"][side][:, :k]), sigmoid(g[k : 2 * k] + h @ p["u"][side][:, k : 2 * k])
                h = (1 - z) * h + z * np.tanh(g[2 * k :] + (r * h) @ p["u"][side][:, 2 * k :])
                own[t] = h
            states.append(own)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(window))]
        e = np.array([float(np.tanh(b @ p["aw"]) @ p["av"][:, 0]) for b in both])
        share = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(e) else e
        pooled = sum((s * b for s, b in zip(share, both, strict=True)), np.zeros(2 * toxicity.HIDDEN))
        scores.append(float(pooled @ p["ow"][:, 0] + p["ob"][0]))
    return float(sigmoid(np.array([1, max(scores), np.mean(scores), np.log(len(scores))]) @ model.last))


def test_toxicity_equals_plain_loops(spark):
    rows = toxic_rows(120)
    model = toxicity.train(pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows]), 1.0)
    texts = [*(t for _, t, _ in rows[:30]), "", "123 !", "Ünï idiot", " ".join(f"w{i} idiot" for i in range(300)), *(t or "" for _, t in HOSTILE if t is None or len(t) < 1000)]
    got = {r.doc_id: r.score for r in toxicity.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(by_plain_loops(model, t), abs=2e-4), t[:50]


def area(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def log_odds(present, toxic, size):
    """Of each bucket: how much likelier a toxic text has it than another."""
    n = np.zeros((2, size))
    for b, y in zip(present, toxic, strict=True):
        n[y, b] += 1
    rate = (n + 0.5) / (np.bincount(toxic, minlength=2)[:, None] + 1)
    return np.log(rate[1] / rate[0]) * n.sum(0) / (n.sum(0) + 5)


def test_embeddings_beat_log_odds(spark):
    """On held-out texts of a whole table, the network, which begins at random, is clearly better than log odds of its buckets."""
    folder = "/root/testdata/sf0.1"
    joined = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("text IS NOT NULL").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in joined])
    toxic, texts = np.array([r.toxic for r in joined]), pa.array([r.text for r in joined])
    fitted = texts.filter(pa.array(~held))
    model = toxicity.train(fitted, toxic[~held], 1.0)
    words, memo = toxicity.Words(), {}
    other = texts.filter(pa.array(held))
    score = np.concatenate([model.texts(run, words, memo) for run in textbuf.runs(other)])
    known, asked = toxicity._Sample(fitted), toxicity._Sample(other)
    odds = log_odds([np.unique(known.buckets(i)) for i in range(len(known.docs))], toxic[~held], toxicity.WORD_BUCKETS + toxicity.GRAM_BUCKETS)
    alone = []
    for i, (back, a, b) in enumerate(asked.docs):
        x = toxicity._embedded(odds[: toxicity.WORD_BUCKETS, None], odds[toxicity.WORD_BUCKETS :, None], asked.buckets(i), asked.begin[a : b + 1] - asked.begin[a]) if b > a else np.zeros((0, 2))
        strength = np.maximum(x.max(1, initial=0), 0) ** 2
        alone.append(max(strength[back[k : k + toxicity.WINDOW] - a].sum() for k in toxicity.windows(np.array([len(back)]))[1]))
    assert area(toxic[held], score) > 0.95 and area(toxic[held], score) > area(toxic[held], np.array(alone)) + 0.04


def test_toxicity_without_labels(frame, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(frame([(1, "x")]), labels, F.lit(True)) is None
    assert toxicity.rate(frame([(1, "x")]), None).first().score == 0
    assert toxicity.rate(frame([]), None).collect() == []


def test_windows_cover():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        _, at = toxicity.windows(np.array([n]))
        covered = {p for a in at for p in range(a, min(a + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and all(a < max(n, 1) for a in at)
    assert pa.array(toxicity.windows(np.array([3, 100]))[0].tolist()).to_pylist()[0] == 0
