"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters by two learnt embeddings: one of the word itself, and one of its characters, the largest
value in each dimension among those of its n-grams (all hashed).  Two gated recurrent layers read a window
of words in either direction, attention pools their states, and a linear layer gives the window's score.
Windows overlap and cover the whole text; a text's score is a logistic function of its windows' largest
and mean score and their number.

Network and embeddings are fitted together to a bounded sample of labelled rows in one task, from random
values.  Which windows of a toxic text are toxic isn't labelled: the first pass takes many of each text, and
each further pass half as many, those that the network itself scores highest, down to two.  A part of the
sample, unseen by the network, fits the last function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textbuf

#: The sample: about so many labelled rows of either class, chosen by hash.
SAMPLE = {1: 1200, 0: 2400}
WINDOW, STRIDE = 32, 24
WORD_BUCKETS, GRAM_BUCKETS, GRAMS = 1 << 16, 1 << 17, (3, 5, 7, 8)
OWN, CHARS, HIDDEN, ATTENTION = 6, 8, 10, 10
INPUT = OWN + CHARS
EPOCHS, BATCH, RATE, EMBEDDING_RATE = 6, 96, 6e-3, 0.05
#: Windows of a text in the first pass.
FIRST_WINDOWS = 6
#: The part of a training window's words whose own embedding is left out, so that characters are learnt too.
DROPPED = 0.3
THRESHOLD = 0.7
REMEMBERED = 200_000
WORD = textbuf.byte_set((0x61, 0x7A), (0x80, 0xFF))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Distinct words of texts as numbers, each with its buckets: one for the word, then its n-grams."""

    def __init__(self):
        self.ranges = textbuf.Ranges(1010)

    def split(self, run: textbuf.Run):
        lower = textbuf.LOWER[run.data] if len(run.data) else run.data
        s, e, first = textbuf.spans(textbuf.Run(lower, run.at, 0), WORD)
        sums = self.ranges.over(lower)
        h, at, back = np.unique(sums.hash(s, e), return_index=True, return_inverse=True)
        return lower, s[at], e[at], h, back, first

    def buckets(self, lower: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words end to end, and where each word's begin."""
        # each word between two spaces, so that its ends are part of n-grams
        n = e - s + 2
        stop = np.cumsum(n)
        begin = stop - n
        data = np.full(stop[-1] if len(stop) else 0, 0x20, np.uint8)
        place = np.arange(len(data)) - np.repeat(begin, n)
        inner = (place > 0) & (place < np.repeat(n, n) - 1)
        data[inner] = lower[(np.repeat(s, n) + place - 1)[inner]]
        sums = self.ranges.over(data)
        owner, value = [np.arange(len(s))], [(sums.hash(begin, stop) & textbuf.U64(WORD_BUCKETS - 1)).astype(np.int64)]
        every = np.repeat(np.arange(len(s)), n)
        for g in GRAMS:
            at = np.flatnonzero(place + g <= np.repeat(n, n))
            owner.append(every[at])
            value.append((sums.hash(at, at + g) & textbuf.U64(GRAM_BUCKETS - 1)).astype(np.int64) + WORD_BUCKETS)
        owner, value = np.concatenate(owner), np.concatenate(value)
        order = np.argsort(owner, kind="stable")
        return value[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(s)))])


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and first words (within the text) of all windows; a text without words has one window."""
    many = np.maximum(-(-(count - (WINDOW - STRIDE)) // STRIDE), 1)
    text = np.repeat(np.arange(len(count)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, k * STRIDE


def _largest(table: np.ndarray, value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, in each dimension, the largest value of its n-grams' embeddings and the place in *value* that has it."""
    n = np.diff(begin)
    keep = np.ones(len(value), bool)
    keep[begin[:-1]] = False  # the word itself
    place = np.flatnonzero(keep)
    rows = table[value[place] - WORD_BUCKETS]
    edge = begin[:-1] - np.arange(len(n))
    most = np.maximum.reduceat(rows, edge, axis=0)
    first = np.full(most.shape, len(place), np.int64)
    owner = np.repeat(np.arange(len(n)), n - 1)
    at, dim = np.nonzero(rows == most[owner])
    np.minimum.at(first, (owner[at], dim), at)
    return most, place[first]


def _embedded(own: np.ndarray, chars: np.ndarray, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Inputs of words: the own embedding and that of the characters; a word has one n-gram at least."""
    if len(begin) < 2:
        return np.zeros((0, own.shape[1] + chars.shape[1]), own.dtype)
    keep = np.ones(len(value), bool)
    keep[begin[:-1]] = False
    most = np.maximum.reduceat(chars[value[keep] - WORD_BUCKETS], begin[:-1] - np.arange(len(begin) - 1), axis=0)
    return np.concatenate([own[value[begin[:-1]]], most], 1)


class Network:
    """Parameters by name; both directions side by side in the first axis of the recurrent ones."""

    def __init__(self, rng: np.random.Generator):
        d, h, a = INPUT, HIDDEN, ATTENTION

        def random(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[-2]), shape)

        self.p = {"w": random(2, d, 3 * h), "u": random(2, h, 3 * h), "b": np.zeros((2, 1, 3 * h)), "aw": random(2 * h, a), "av": random(a, 1), "ow": random(2 * h, 1), "ob": np.zeros(1)}

    def forward(self, x: np.ndarray, on: np.ndarray, keep: bool = False):
        """Scores of windows: *x* (words of the windows, window, input) projected for both directions, *on* (window, word)."""
        p, (steps, m) = self.p, (on.shape[1], on.shape[0])
        h = HIDDEN
        states = np.zeros((2, steps, m, h), x.dtype)
        trail = []
        for side in (0, 1):
            now = np.zeros((m, h), x.dtype)
            u = p["u"][side].astype(x.dtype)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                g = x[side, t]
                zr = _sigmoid(g[:, : 2 * h] + now @ u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * now) @ u[:, 2 * h :])
                mask = on[:, t : t + 1]
                new = np.where(mask, (1 - z) * now + z * c, now)
                if keep:
                    trail.append((side, t, now, z, r, c))
                now = new
                states[side, t] = now
        both = np.concatenate([states[0], states[1]], 2)  # word, window, 2 h
        squashed = np.tanh(both @ p["aw"].astype(x.dtype))
        a = (squashed @ p["av"].astype(x.dtype))[:, :, 0]
        a = np.where(on.T, a, -1e9)
        a = np.exp(a - a.max(0)) * on.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * both).sum(0)
        score = (pooled @ p["ow"].astype(x.dtype))[:, 0] + p["ob"].astype(x.dtype)[0]
        return (score, (both, squashed, a, pooled, trail)) if keep else score

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs of words for both directions (2, word, 3 h)."""
        return np.stack([x @ self.p["w"][s].astype(x.dtype) + self.p["b"][s].astype(x.dtype) for s in (0, 1)])

    def gradients(self, x: np.ndarray, on: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Of the weighted logistic loss: for each parameter, and for the inputs *x* (word, window, input)."""
        p, h = self.p, HIDDEN
        steps, m = x.shape[:2]
        flat = self.projected(x.reshape(-1, INPUT)).reshape(2, steps, m, 3 * h)
        score, (both, squashed, a, pooled, trail) = self.forward(flat, on, True)
        d = {k: np.zeros_like(v) for k, v in p.items()}
        ds = ((_sigmoid(score) - target) * weight / m)[:, None]
        d["ow"], d["ob"] = pooled.T @ ds, ds.sum(0)
        dpooled = ds @ p["ow"].T
        dboth = a[:, :, None] * dpooled
        da = (both * dpooled).sum(2)
        da = a * (da - (a * da).sum(0))
        d["av"] = np.einsum("tma,tm->a", squashed, da)[:, None]
        dsq = da[:, :, None] * p["av"][:, 0] * (1 - squashed**2)
        d["aw"] = np.einsum("tmh,tma->ha", both, dsq)
        dboth += dsq @ p["aw"].T
        dx = np.zeros_like(x)
        carry = np.zeros((m, h))
        previous = None
        for side, t, before, z, r, c in reversed(trail):
            if side != previous:
                carry, previous = np.zeros((m, h)), side
            dn = carry + dboth[t, :, side * h : (side + 1) * h]
            mask = on[:, t : t + 1]
            live = np.where(mask, dn, 0)
            u = p["u"][side]
            dc = live * z * (1 - c**2)
            dz = live * (c - before) * z * (1 - z)
            drn = dc @ u[:, 2 * h :].T
            dr = drn * before * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], 1)
            carry = np.where(mask, dn * (1 - z), dn) + drn * r + np.concatenate([dz, dr], 1) @ u[:, : 2 * h].T
            d["u"][side][:, : 2 * h] += before.T @ np.concatenate([dz, dr], 1)
            d["u"][side][:, 2 * h :] += (r * before).T @ dc
            d["w"][side] += x[t].T @ dg
            d["b"][side] += dg.sum(0)
            dx[t] += dg @ p["w"][side].T
        return d, dx


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.n = rate, {}, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * grad
        v = self.v[name] = 0.999 * self.v.get(name, 0) + 0.001 * grad**2
        n = self.n[name] = self.n.get(name, 0) + 1
        value -= self.rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)


class Model:
    def __init__(self, own: np.ndarray, chars: np.ndarray, network: Network, last: np.ndarray):
        self.own, self.chars, self.network, self.last = own.astype(np.float32), chars.astype(np.float32), network, last

    def words(self, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Inputs of words from their buckets."""
        return _embedded(self.own, self.chars, value, begin)

    def texts(self, run: textbuf.Run, words: Words, memo: dict) -> np.ndarray:
        """Scores of a run's texts, from 0 to 1."""
        x, back, first = self.inputs(run, words, memo)
        return _sigmoid(self.summary(x, back, first) @ self.last)

    def inputs(self, run: textbuf.Run, words: Words, memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        from itertools import repeat

        lower, s, e, h, back, first = words.split(run)
        if len(memo.get("known", ())) > REMEMBERED or not memo:
            memo |= {"known": {}, "x": np.zeros((1 << 14, INPUT), np.float32)}
        known = memo["known"]
        number = np.fromiter(map(known.get, h.tolist(), repeat(-1)), np.int64, len(h))
        new = np.flatnonzero(number < 0)
        if len(new):
            made = self.words(*words.buckets(lower, s[new], e[new]))
            base = len(known)
            while base + len(new) > len(memo["x"]):
                memo["x"] = np.concatenate([memo["x"], np.zeros_like(memo["x"])])
            memo["x"][base : base + len(new)] = made
            number[new] = np.arange(base, base + len(new))
            known.update(zip(h[new].tolist(), number[new].tolist(), strict=True))
        return memo["x"][number], back, first

    def scores(self, x: np.ndarray, back: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and scores of all windows, of words *x*, texts' words *back* and their beginnings *first*."""
        text, at = windows(np.diff(first))
        gates = np.concatenate([self.network.projected(x), np.zeros((2, 1, 3 * HIDDEN), np.float32)], 1)
        score = np.zeros(len(text), np.float32)
        padded = np.append(back, len(x))
        for lo in range(0, len(text), 4096):
            t, a = text[lo : lo + 4096], at[lo : lo + 4096]
            place = a[:, None] + np.arange(WINDOW)
            on = place < np.diff(first)[t][:, None]
            word = padded[np.where(on, place + first[t][:, None], len(back))]
            score[lo : lo + 4096] = self.network.forward(_Picked(gates, word), on)
        return text, score

    def summary(self, x: np.ndarray, back: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each text: 1, the largest and the mean window score, and the logarithm of the number of windows."""
        text, score = self.scores(x, back, first)
        if not len(text):
            return np.zeros((0, 4))
        edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        n = np.diff(np.append(edge, len(text)))
        return np.stack([np.ones(len(edge)), np.maximum.reduceat(score, edge), np.add.reduceat(score, edge) / n, np.log(n)], 1)


class _Picked:
    """Gates of the words at a place of all windows, looked up as they are needed."""

    dtype = np.dtype(np.float32)

    def __init__(self, gates: np.ndarray, word: np.ndarray):
        self.gates, self.word = gates, word

    def __getitem__(self, at: tuple[int, int]) -> np.ndarray:
        return self.gates[at[0]][self.word[:, at[1]]]


class _Rows:
    """Steps for a table of which a batch changes few rows: each value's step shrinks with its gradients so far."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate, self.seen = table, rate, np.full(table.shape, 1e-6)

    def step(self, row: np.ndarray, grad: np.ndarray, dim: np.ndarray | None = None) -> None:
        which, at = np.unique(row, return_inverse=True)
        total = np.zeros((len(which), self.table.shape[1]))
        np.add.at(total, at if dim is None else (at, dim), grad)
        self.seen[which] += total**2
        self.table[which] -= self.rate * total / np.sqrt(self.seen[which])


class _Sample:
    """A sample's texts as buckets: of all distinct words of texts end to end, and each text's words by number."""

    def __init__(self, texts: pa.Array):
        words = Words()
        values, begins, self.docs, n, held = [], [np.zeros(1, np.int64)], [], 0, 0
        for run in textbuf.runs(texts, 1 << 16):
            for d in range(len(run)):
                one = textbuf.Run(run.data[run.at[d] : run.at[d + 1]], np.array([0, run.at[d + 1] - run.at[d]]), 0)
                lower, s, e, _, back, _ = words.split(one)
                value, begin = words.buckets(lower, s, e)
                values.append(value)
                begins.append(begin[1:] + held)
                self.docs.append((back + n, n, n + len(s)))
                held += len(value)
                n += len(s)
        self.value, self.begin = np.concatenate(values), np.concatenate(begins)

    def buckets(self, i: int) -> np.ndarray:
        _, a, b = self.docs[i]
        return self.value[self.begin[a] : self.begin[b]]

    def of_words(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of words by number, and where each one's begin."""
        size = self.begin[w + 1] - self.begin[w]
        stop = np.cumsum(size)
        return self.value[np.repeat(self.begin[w] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)], np.concatenate([[0], stop]).astype(np.int64)

    def window(self, i: int, at: int) -> np.ndarray:
        row = np.full(WINDOW, -1, np.int64)
        some = self.docs[i][0][at : at + WINDOW]
        row[: len(some)] = some
        return row


def train(texts: pa.Array, toxic: np.ndarray, weight: float, seed: int = 7) -> Model:
    """Fits a model; *weight* is how many texts without toxicity one in the sample stands for, in relation to toxic ones."""
    rng = np.random.Generator(np.random.PCG64(seed))
    sample = _Sample(texts)
    part = np.zeros(len(sample.docs), bool)
    part[rng.permutation(len(sample.docs))[: int(0.7 * len(sample.docs))]] = True
    seen, rest = np.flatnonzero(part).tolist(), np.flatnonzero(~part).tolist()
    own, chars = rng.normal(0, 0.1, (WORD_BUCKETS, OWN)), rng.normal(0, 0.1, (GRAM_BUCKETS, CHARS))
    network, optimiser = Network(rng), Adam(RATE)
    rows = _Rows(own, EMBEDDING_RATE), _Rows(chars, EMBEDDING_RATE)

    def strengths(i: int, model: Model | None) -> np.ndarray:
        """Of each window of a text, how toxic the network finds it; at first, anything."""
        back, a, b = sample.docs[i]
        if model is None:
            return rng.random(len(windows(np.array([len(back)]))[1]))
        begin = sample.begin[a : b + 1] - sample.begin[a]
        return model.scores(model.words(sample.buckets(i), begin), back - a, np.array([0, len(back)]))[1]

    for epoch in range(EPOCHS):
        model = Model(own, chars, network, np.zeros(4)) if epoch else None
        most = max(2, FIRST_WINDOWS >> epoch)
        chosen, y = [], []
        for i in seen:
            strength = strengths(i, model)
            best = np.argsort(-strength, kind="stable")[: most if toxic[i] else 1].tolist()
            if not toxic[i]:
                best += rng.choice(len(strength), min(len(strength), most), replace=False).tolist()
            for k in dict.fromkeys(best):
                chosen.append(sample.window(i, k * STRIDE))
                y.append(float(toxic[i]))
        grid, target = np.array(chosen), np.array(y)
        shuffled = rng.permutation(len(target))
        for lo in range(0, len(shuffled), BATCH):
            batch = shuffled[lo : lo + BATCH]
            word, on = grid[batch].T, (grid[batch] >= 0)
            live = np.flatnonzero(word.ravel() >= 0)
            x = np.zeros((word.size, INPUT))
            if len(live):
                bucket, edge = sample.of_words(word.ravel()[live])
                most, place = _largest(chars, bucket, edge)
                kept = rng.random(len(live)) >= DROPPED
                x[live] = np.concatenate([own[bucket[edge[:-1]]] * kept[:, None], most], 1)
            grads, dx = network.gradients(x.reshape(*word.shape, INPUT), on, target[batch], np.ones(len(batch)))
            for name, g in grads.items():
                optimiser.step(name, network.p[name], g)
            if len(live):
                d = dx.reshape(word.size, INPUT)[live]
                rows[0].step(bucket[edge[:-1]][kept], d[kept, :OWN])
                rows[1].step((bucket[place] - WORD_BUCKETS).ravel(), d[:, OWN:].ravel(), np.tile(np.arange(CHARS), len(live)))
    model = Model(own, chars, network, np.zeros(4))
    f = np.concatenate([model.summary(model.words(sample.buckets(i), sample.begin[a : b + 1] - sample.begin[a]), back - a, np.array([0, len(back)])) for i in rest for back, a, b in (sample.docs[i],)]) if rest else np.zeros((0, 4))
    t = toxic[rest].astype(float)
    w = np.where(t > 0, 1.0, weight)
    start = np.array([-1.0, 0.5, 0.5, 0.0])
    last = start.copy()
    for _ in range(30):  # Newton steps, held near the start
        p = _sigmoid(f @ last)
        grad = f.T @ (w * (p - t)) + 2 * (last - start)
        hess = (f * (w * p * (1 - p))[:, None]).T @ f + 2 * np.eye(4)
        step = np.linalg.solve(hess, grad)
        last = last - step * min(1, 1 / max(np.abs(step).max(), 1e-9))
    model.last = last
    return model


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> Model | None:
    """Fits the model to labelled rows whose id satisfies *allowed* (a condition on ``doc_id``); None without both classes.

    Ids with several labels have the largest, ids with several texts the first in order; null ids, texts and
    labels aren't used.
    """
    sample = sample or SAMPLE
    marked = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    share = {y: min(1.0, sample[y] / counts[y]) for y in (0, 1)}
    limit = F.when(F.col("toxic") == 1, F.lit(int(share[1] * (1 << 30)) + 1)).otherwise(F.lit(int(share[0] * (1 << 30)) + 1))
    # bounded: about sum(sample) ids
    chosen = F.broadcast(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).where("text IS NOT NULL").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("one", F.lit(1))
    weight = share[1] / share[0]

    def learn(table: pa.Table) -> pa.Table:
        import pickle

        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        toxic = np.array(table.column("toxic").to_pylist())
        made = train(text, toxic, weight) if len(set(toxic.tolist())) == 2 else None
        raw = pickle.dumps(None if made is None else (made.own, made.chars, made.network.p, made.last))
        return pa.table({"model": pa.array([raw], pa.binary())})

    import pickle

    found = rows.groupBy("one").applyInArrow(learn, "model binary").collect()
    parts = pickle.loads(bytes(found[0]["model"])) if found else None
    if parts is None:
        return None
    network = Network(np.random.Generator(np.random.PCG64(0)))
    network.p = parts[2]
    return Model(parts[0], parts[1], network, parts[3])


def rate(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row of *docs*.

    All windows of a whole text are scored; a null or empty text has one empty window.  Without a model every
    score is 0.  Ids may be null or repeat; other columns aren't read.
    """
    base = shared.keyed(docs, id_col, text_col)
    if model is None:
        return base.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words, memo = sent.value, Words(), {}
        for batch in batches:
            found = [m.texts(r, words, memo) for r in textbuf.runs(textbuf.string_column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.concatenate(found).astype(float) if found else [], pa.float64())], names=["doc_id", "score"])

    return base.mapInArrow(shared.frugal(run), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all of ``documents``, learnt from two thirds of the labels."""
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    held_out = shared.fold(F.col("doc_id"), 3) == 1
    scored = rate(docs, fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
