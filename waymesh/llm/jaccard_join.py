"""N-gram Jaccard join by parity sketches: near-duplicate classes, exact and without all pairs of a group.

A text's set holds its distinct shingles.  A set of a size band is cut, by hash, into 2^j segments (a small
one into its single shingles); a segment's sketch is the XOR of its shingles' hashes.  The number of
segments that differ between two sets (a Hamming distance over sketch words) is at most the size of their
symmetric difference, which for a Jaccard similarity of 0.8 is at most a ninth of both sizes.  So, with the
segments of a set in any order that all sets share, the first non-empty ones, one more than that bound, of
two similar sets have one in common (pigeonhole).  Only these are joined, rarest first, so that common
passages seldom meet.

Sets with a key in common are candidates; the Hamming distance of their bit sketches, a lower bound of the
symmetric difference, rules most of them out.  Keys of few sets give their pairs.  The sets of keys with
many gather around the smallest set of each key.  A group that fits into a block gives a spanning forest of
the pairs that its sketches leave, closest first.  In a larger group each set meets only a few pivots and
takes the closest.  Pairs are verified on whole sets.  As only what hangs together matters, groups in one
component are done; in the others each set offers its closest candidates outside its own component, eight
times as many in each round, until none is left.

A small set shows single shingles, so what stands before the first key that two sets share is in neither's
intersection: with 9 p of both places together beyond both sizes together they can't be similar.  A set's
slack is nine times the least place of its keys in the group less its size; two sets whose slacks add up to
more than 0 don't meet there.  Sets of large groups are dealt to strata by component, size and slack, and
strata that have no pair to offer don't meet, so a passage that any number of sets share costs no copies
of rows where these sets hang together or differ in too much beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, components, shared, textbuf

U64 = np.uint64
WORDS = 5
#: Similar: 100 * intersection >= PERCENT * union. The sketch bounds are for 80.
PERCENT = 80
#: Buckets of the table of frequent shingles; the table's size is fixed.
HOT_BUCKETS = 1 << 22
#: Shingles counted at a time, and the count from which a bucket is frequent.
CHUNK, HOT = 1 << 20, 6
#: Keys combined at a time.
KEYS = 1 << 18
#: Of a key's sets, all pairs are candidates up to so many rows.
FEW = 8
#: A block's most sets, and about as many bytes of bit sketches.
BLOCK_SETS, BLOCK_BYTES = 1024, 2 << 20
#: Candidates that a set offers in the first round.
CLOSEST = 8
#: Sets of a large group that all its sets are held against first, about.
PIVOTS = 16
#: Smaller sets show single shingles; larger ones are cut into segments of one to two shingles on average.
SMALL = 128
_LEAST = 4  # the smallest bit sketch has 2^6 bits

_TEXTS = textbuf.byte_set((0, 255)) & ~textbuf.SPACE
_STEP = [U64(x) for x in np.random.Generator(np.random.PCG64(505)).integers(1, 2**63, WORDS + 1, dtype=np.uint64) * U64(2) + U64(1)]


def shingle_sets(run: textbuf.Run, ranges: textbuf.Ranges) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    lower = textbuf.LOWER[run.data] if len(run.data) else run.data
    s, e, first = textbuf.spans(textbuf.Run(lower, run.at, 0), _TEXTS)
    h = ranges.over(lower).hash(s, e)
    n = np.diff(first)
    padded = np.concatenate([h, np.zeros(WORDS, U64)])
    total = np.zeros(len(h), U64)
    for i in range(WORDS):
        total += padded[i : i + len(h)] * _STEP[i]
    left = first[1:].repeat(n) - np.arange(len(h))  # words from here to the text's end
    keep = left >= WORDS
    for d in np.flatnonzero((n > 0) & (n < WORDS)):
        a, b = first[d], first[d + 1]
        with np.errstate(over="ignore"):
            total[a] = np.sum(h[a:b] * np.array(_STEP[: b - a])) + U64(b - a) * _STEP[WORDS]
        keep[a] = True
    shingles = textbuf.mixed(total[keep])
    at = np.concatenate([[0], np.cumsum(np.maximum(n - WORDS + 1, np.minimum(n, 1)))])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        shingles[a:b].sort()
    doc = np.repeat(np.arange(len(run)), np.diff(at))
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    return shingles[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(run)))]).astype(np.int64)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(x)])
    return total[at[1:]] - total[at[:-1]]


def set_hashes(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    return tuple(textbuf.mixed(_sums(textbuf.mixed(sets ^ salt), at)) for salt in (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)))


def band(n: np.ndarray) -> np.ndarray:
    """0 for sets of fewer than SMALL shingles, and j for 64 * 2^j up to 128 * 2^j of them."""
    return np.maximum(np.frexp(np.maximum(n, 1).astype(float))[1] - 7, 0).astype(np.int64)


def most_different(n: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of a set of *n* shingles and a similar one of band *j*."""
    return (n + np.minimum(5 * n // 4, (np.int64(SMALL) << j) - 1)) // 9


def bit_sketches(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """Of each set, the parity of its shingles in each of 1.3 to 2.7 times as many bits (64 at least), as 64-bit words.

    Half as many bits are the XOR of the sketch's halves.  The Hamming distance of two sketches is at most
    the size of the symmetric difference.
    """
    n = np.diff(at)
    size = np.maximum(np.floor(np.log2(np.maximum(n, 1) / 1.5)).astype(np.int64), _LEAST)
    words = np.where(n > 0, np.int64(1) << (size - _LEAST), 0)
    begin = np.concatenate([[0], np.cumsum(words)])
    place = textbuf.mixed(sets ^ U64(0x082EFA98EC4E6C89)) & np.repeat((words * 64 - 1).astype(U64), n)
    where = (place >> U64(6)).astype(np.int64) + np.repeat(begin[:-1], n)
    order = np.argsort(where, kind="stable")
    bit = (U64(1) << (place & U64(63)))[order]
    where = where[order]
    out = np.zeros(begin[-1], U64)
    if len(where):
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        out[where[first]] = np.bitwise_xor.reduceat(bit, first)
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(textbuf.as_signed(out)))


def hamming(a: str | Column, b: str | Column) -> Column:
    """The Hamming distance of two sketches whose lengths are at most one doubling apart, at the shorter one's."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def halved(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    x = F.when(F.size(a) > F.size(b), halved(a)).otherwise(a)
    y = F.when(F.size(b) > F.size(a), halved(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, v: n + v)


def sketch_keys(sets: np.ndarray, at: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers and the keys that each set shows."""
    return placed_keys(sets, at, hot)[:2]


def placed_keys(sets: np.ndarray, at: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set numbers, the keys that each set shows, and how many of its shingles stand before each.

    A set shows keys in its own band and, if a smaller set of the band below can be similar to it, there.
    Of segments, which two sets may both have without agreeing in them, 0 are said to stand before.
    """
    n = np.diff(at)
    own = band(n)
    # whether the largest set of the band below reaches 80 % of this one
    low = (n > 0) & (own > 0) & ((np.int64(SMALL) << np.maximum(own - 1, 0)) - 1 >= -(-4 * n // 5))
    which, keys, places = [], [], []
    for role, picked in ((own, n > 0), (own - 1, low)):
        docs = np.flatnonzero(picked)
        if not len(docs):
            continue
        size, j = n[docs], role[docs].astype(U64)
        most = most_different(size, role[docs])
        index = np.repeat(at[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        s = sets[index]
        doc = np.repeat(np.arange(len(docs)), size)
        segment = s >> np.where(j > 0, U64(58) - j, U64(0))[doc]
        new = np.ones(len(s), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        value = np.bitwise_xor.reduceat(textbuf.mixed(s ^ U64(0xA4093822299F31D0)), begin)
        rank = np.minimum.reduceat(hot[(s & U64(len(hot) - 1)).astype(np.int64)], begin)
        owner = doc[begin]
        key = textbuf.mixed(value + segment[begin] * _STEP[0] + j[owner] * _STEP[1])
        order = np.lexsort((key, rank, owner))
        owner, key = owner[order], key[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(docs)))[owner]
        shown = place <= most[owner]
        which.append(docs[owner[shown]])
        keys.append(key[shown])
        places.append(np.where(j[owner] > 0, 0, place)[shown])
        # too few segments have shingles, which is next to impossible: two such sets may agree in empty ones only
        short = np.flatnonzero(np.bincount(owner, minlength=len(docs)) <= most)
        which.append(docs[short])
        keys.append(textbuf.mixed(j[short] * _STEP[2]))
        places.append(np.zeros(len(short), np.int64))
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(which), np.concatenate(keys), np.concatenate(places)


def distances(n: np.ndarray, bits: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Of each pair, its sketches' Hamming distance as a part of both sizes; infinite for pairs that can't be similar or aren't across *side*."""
    m = len(n)
    out = np.full((m, m), np.inf, np.float32)
    words = np.array([len(x) for x in bits])
    members = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    sketch = {w: np.stack([bits[i] for i in at]) for w, at in members.items()}
    for w, at in members.items():
        for rows, x in ((at, sketch[w]), *(((members[2 * w], sketch[2 * w][:, :w] ^ sketch[2 * w][:, w:]),) if 2 * w in members else ())):
            step = max(1, (1 << 21) // (len(at) * w))
            for lo in range(0, len(rows), step):
                r = rows[lo : lo + step]
                h = np.bitwise_count(x[lo : lo + step, None] ^ sketch[w]).sum(2, dtype=np.int64)
                both = n[r][:, None] + n[at]
                near = (9 * h <= both) & (5 * np.minimum(n[r][:, None], n[at]) >= 4 * np.maximum(n[r][:, None], n[at])) & (side[r][:, None] != side[at])
                d = np.where(near, h / both, np.inf)
                out[np.ix_(r, at)] = d
                out[np.ix_(at, r)] = d.T
    return out


def forest(d: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the finite distances, the closest pairs first: each component takes its closest edge to another, until none is left."""
    m = len(d)
    label = np.arange(m)
    links: list[tuple[int, int]] = []
    d = d.copy()
    while m:
        d[label[:, None] == label] = np.inf
        to = d.argmin(1)
        best = d[np.arange(m), to]
        order = np.lexsort((best, label))
        first = order[np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))]
        merged = False
        for i in first[np.isfinite(best[first])].tolist():
            a, b = label[i], label[to[i]]
            if a != b:
                links.append((i, int(to[i])))
                label[label == max(a, b)] = min(a, b)
                merged = True
        if not merged:
            break
    return links


def same(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar."""
    both = int(np.isin(a, b, assume_unique=True).sum()) if len(a) < len(b) else int(np.isin(b, a, assume_unique=True).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of *docs*, and the (small) columns *carry* in a struct ``rest``.

    Texts are lower-cased (A-Z) and split at ``[\\x20\\x09-\\x0D]``; a text of fewer than five words is one
    shingle.  A null or blank text has the empty set and is its own component.  A row with a null id has a
    null component and links nothing.  Ids are expected to be distinct: rows that share one are compared as
    separate documents.  Other columns aren't read.  No rows in, no rows out.  Classes of equal sets are told
    apart by 128 bits and the size, but joined by 64 bits: beyond 10^9 distinct sets a link may get lost.
    """
    base = shared.keyed(docs, id_col, text_col, carry)
    rest = [T.StructField("rest", base.schema["rest"].dataType, True)] if carry else []
    spark = base.sparkSession

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = textbuf.Ranges(606)
        names = ["kind", "doc_id", "n", "h1", "h2", "bits", *(f.name for f in rest)]
        count, seen, more = np.zeros(HOT_BUCKETS, np.int32), 0, None

        def frequent() -> pa.RecordBatch:
            found = np.flatnonzero(count >= HOT)
            zero = pa.array(np.zeros(len(found), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), pa.array(found), pa.array(count[found].astype(np.int64)), zero, zero, pa.nulls(len(found), pa.list_(pa.int64())), *(pa.nulls(len(found), t) for t in more)], names=names)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            carried = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            more = [c.type for c in carried]
            for run in textbuf.runs(textbuf.string_column(batch, "text")):
                sets, at = shingle_sets(run, ranges)
                h1, h2 = set_hashes(sets, at)
                np.add.at(count, (sets & U64(HOT_BUCKETS - 1)).astype(np.int64), 1)
                seen += len(sets)
                if seen >= CHUNK:
                    yield frequent()
                    count[:] = 0
                    seen = 0
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(run), np.int32)), ids.slice(run.first, len(run)), pa.array(np.diff(at)), pa.array(textbuf.as_signed(h1)), pa.array(textbuf.as_signed(h2)), bit_sketches(sets, at), *(c.slice(run.first, len(run)) for c in carried)], names=names)
        if more is not None:
            yield frequent()

    kind = T.StructType([*T.StructType.fromDDL("kind int, doc_id long, n long, h1 long, h2 long, bits array<long>").fields, *rest])
    first = shared.stored(base.mapInArrow(shared.frugal(first_pass), kind))
    hot = np.zeros(HOT_BUCKETS, np.int32)
    frequent = first.where("kind = 1").groupBy("doc_id").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n"))
    found = frequent.toPandas()  # at most HOT_BUCKETS rows
    hot[found["doc_id"].to_numpy()] = found["n"].to_numpy()
    del found
    sent = spark.sparkContext.broadcast(hot)

    rows = first.where("kind = 0").drop("kind")
    # exact copies of a set: one class, known by its hash and named by its smallest id
    classes = shared.stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))

    def shown(only: Broadcast | None = None) -> DataFrame:
        """``key, cid`` of all sets, or ``key, cid, place`` of those keys that a Bloom filter has; made from the texts each time, as most keys are needed once."""

        def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges, table = textbuf.Ranges(606), sent.value
            found = bloom.Filter(data=only.value) if only else None
            keys: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            places: list[np.ndarray] = []

            def combined() -> pa.RecordBatch:
                """The chunk's keys and sets, each pair once."""
                k, c, p = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
                order = np.lexsort((k, c))
                k, c, p = k[order], c[order], p[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                columns = [pa.array(textbuf.as_signed(x[new])) for x in (k, c)]
                if not found:
                    return pa.RecordBatch.from_arrays(columns, names=["key", "cid"])
                return pa.RecordBatch.from_arrays([*columns, pa.array(p[new].astype(np.int32))], names=["key", "cid", "place"])

            held = 0
            for batch in batches:
                for run in textbuf.runs(textbuf.string_column(batch, "text")):
                    sets, at = shingle_sets(run, ranges)
                    h1 = set_hashes(sets, at)[0]
                    which, key, place = placed_keys(sets, at, table)
                    if found:
                        on = found.has(textbuf.mixed(key))
                        which, key, place = which[on], key[on], place[on]
                    keys.append(key)
                    places.append(place)
                    owners.append(h1[which])
                    held += len(key)
                    if held >= KEYS:
                        yield combined()
                        keys, owners, places, held = [], [], [], 0
            if held:
                yield combined()

        return base.where("doc_id IS NOT NULL").select("text").mapInArrow(shared.frugal(second_pass), "key long, cid long" + (", place int" if only else ""))

    def hashes_of(name: str) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
        def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            yield _hashed(batch, name)

        return of

    def filter_of(df: DataFrame, name: str) -> Broadcast:
        return spark.sparkContext.broadcast(bloom.seen_once(df.select(name), hashes_of(name), bloom.bits_for(df.count())))

    # keys of several sets: counted with map-side sums; their sets are found by a filter before any shuffle
    several = shared.stored(shown().groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last"), F.count("*").alias("n")).where("hub < last").drop("last"))
    met = shared.stored(shown(filter_of(several, "key")).join(several, "key"))
    shared.dropped(several)
    few = met.where(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_set("cid")).alias("c"))
    each = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = shared.stored(few.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct())
    around = shared.stored(met.where(F.col("n") > FEW).groupBy("hub", "cid").agg(F.min("place").alias("place")))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(around.select("cid")).distinct()
    info = classes.join(ids, classes["h1"] == ids["cid"]).select("cid", "rep")
    own = rows.where("n > 0").select("doc_id", "h1", "n", "bits")
    info = shared.stored(info.join(own, (info["rep"] == own["doc_id"]) & (info["cid"] == own["h1"])).select("cid", "rep", "n", "bits").dropDuplicates(["cid"]))

    # pairs that the sketches rule out go
    left, right = (info.select(*(F.col(c).alias(f"{c}_{x}") for c in ("cid", "n", "bits"))) for x in "ab")
    # sizes first, as the bits are most of a row
    size = info.select("cid", "n")
    sizes = [size.select(F.col("cid").alias(f"of_{x}"), F.col("n").alias(f"size_{x}")) for x in "ab"]
    fit = pairs.join(sizes[0], F.col("a") == F.col("of_a")).join(sizes[1], F.col("b") == F.col("of_b")).where("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)").select("a", "b")
    sized = fit.join(left, F.col("a") == F.col("cid_a")).join(right, F.col("b") == F.col("cid_b"))
    alike = sized.where(hamming("bits_a", "bits_b") * 9 <= F.col("n_a") + F.col("n_b")).select("a", "b")
    able = _able(around, info)
    blocks = _in_blocks(able.where("not large").join(info.withColumn("comp", F.col("cid")), "cid"))
    edges = shared.stored(alike.unionByName(blocks.applyInArrow(_forests, "a long, b long")).unionByName(_to_pivots(able.where("large"), info)).distinct())
    asked = edges.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(able.where("large").select("cid")).distinct()
    member = shared.stored(info.join(asked, "cid"))
    shared.dropped(met, pairs, around)

    # whole sets of those that may be similar to one; other texts stay where they are
    wanted = member.select(F.col("rep").alias("doc_id"), "cid")

    def third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, given = textbuf.Ranges(606), set()
        for batch in batches:
            cid = batch.column(batch.schema.get_field_index("cid")).to_pylist()
            for run in textbuf.runs(textbuf.string_column(batch, "text")):
                sets, at = shingle_sets(run, ranges)
                h1 = textbuf.as_signed(set_hashes(sets, at)[0]).tolist()
                out = []
                for d, h in enumerate(h1):
                    if h == cid[run.first + d] and h not in given:  # else another row with the id of a class, or the same again
                        given.add(h)
                        out.append((h, sets[at[d] : at[d + 1]].tobytes()))
                if len(given) > 200_000:
                    given.clear()
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["cid", "shingles"])

    wanted_ids = filter_of(wanted, "doc_id")

    def maybe_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = bloom.Filter(data=wanted_ids.value)
        for batch in batches:
            yield batch.filter(pa.array(found.has(_hashed(batch, "doc_id"))))

    near = base.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(shared.frugal(maybe_wanted), "doc_id long, text string")
    sets = shared.stored(near.join(wanted, "doc_id").select("text", "cid").mapInArrow(shared.frugal(third_pass), "cid long, shingles binary"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y"))
            ok = [same(np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    def verified(e: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
        return shared.stored(e.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(shared.frugal(check), "a long, b long, ok boolean"))

    done, most = [verified(edges)], CLOSEST
    while True:
        links = done[0]
        for v in done[1:]:
            links = links.unionByName(v)
        linked = shared.stored(components.components(links.where("ok").select("a", "b")))
        state = member.join(linked.withColumnsRenamed({"node": "cid", "component": "comp"}), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        # what is in question is known by ids alone; sketches follow only there
        open_ = _open(able.join(state.select("cid", "n", "comp"), "cid"))
        offered = shared.stored(_in_blocks(open_.join(state.select("cid", "bits"), "cid")).applyInArrow(_offers(most), "a long, b long, more boolean"))
        new = shared.stored(offered.select("a", "b").distinct().join(links.select("a", "b"), ["a", "b"], "left_anti"))
        more = bool(offered.where("more").limit(1).count())
        shared.dropped(offered, open_)
        if new.isEmpty() and not more:
            break
        done.append(verified(new))
        shared.dropped(new, linked)
        most *= 8
    least = member.join(linked, member["cid"] == linked["node"]).groupBy("component").agg(F.min("rep").alias("least"))
    of_class = linked.join(least, "component").select("node", "least")
    named = shared.stored(classes.join(of_class, classes["h1"] == of_class["node"], "left").select("h1", "h2", "n", F.coalesce("least", "rep").alias("least")))
    shared.dropped(classes, info, able, edges, member, sets, linked, new, *done)
    joined = rows.drop("bits").join(named, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *(f.name for f in rest))


def _hashed(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Hashes of a column of integers without nulls."""
    return textbuf.mixed(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))


def _able(around: DataFrame, info: DataFrame) -> DataFrame:
    """``hub, cid, slack, bytes, m, large`` of the sets (``hub, cid, place``) that can be similar to another one of their group."""
    placed = shared.stored(around.join(info.select("cid", "n", (8 * F.size("bits")).cast("bigint").alias("bytes")), "cid").select("hub", "cid", (9 * F.col("place") - F.col("n")).alias("slack"), "bytes"))
    least = shared.stored(placed.groupBy("hub").agg(F.min("slack").alias("least")))
    kept = shared.stored(placed.join(least, "hub").where("slack + least <= 0"))
    # stored, so that joins with a large group's many sets are split or broadcast by what is known of its sizes
    size = shared.stored(kept.groupBy("hub").agg(F.count("*").alias("m"), F.sum("bytes").alias("all")).where("m > 1").select("hub", "m", (_parts("m", "all") > 1).alias("large")))
    able = shared.stored(kept.join(size, "hub").select("hub", "cid", "slack", "least", "bytes", "m", "large"))
    shared.dropped(placed, least, kept, size)
    return able


def _parts(sets: str, size: str) -> Column:
    return F.ceil(F.greatest(F.col(sets) / BLOCK_SETS, F.col(size) / BLOCK_BYTES)).cast("bigint")


def _to_pivots(able: DataFrame, info: DataFrame) -> DataFrame:
    """Of each set of the large groups, the pair with the closest pivot that it may be similar to.

    Pivots are about PIVOTS sets of a group, by hash, and about as many of those with the least slack, which most sets can be similar to.
    """
    lowest = able.where("slack = least").groupBy("hub").agg(F.count("*").alias("lows"))
    marked = able.join(lowest, "hub")
    dealt = F.xxhash64("hub", "cid")
    chosen = marked.where((F.pmod(dealt, F.col("m")) < PIVOTS) | ((F.col("slack") == F.col("least")) & (F.pmod(dealt, F.col("lows")) < PIVOTS)))
    found = chosen.join(info, "cid").groupBy("hub").agg(F.collect_list(F.struct("cid", "n", "slack", "bits")).alias("pivots"))
    each = able.select("hub", "cid", "slack").join(info.select("cid", "n", "bits"), "cid").join(shared.stored(found), "hub")
    fits = F.filter("pivots", lambda p: (p.cid != F.col("cid")) & (p.slack + F.col("slack") <= 0) & (5 * F.least(p.n, F.col("n")) >= 4 * F.greatest(p.n, F.col("n"))))
    closest = F.array_min(F.transform(fits, lambda p: F.struct((9 * hamming(p.bits, "bits") / (p.n + F.col("n"))).alias("d"), p.cid.alias("to"))))
    # exploded, so that the filter doesn't work it out again
    near = each.select("cid", F.explode(F.array(closest)).alias("near")).where("near.d <= 1")
    return near.select(F.least("cid", "near.to").alias("a"), F.greatest("cid", "near.to").alias("b"))


#: Strata of a group: sizes a quarter apart, which only meet the next ones, and slack in eighths of the size.
_STRATUM = 32
#: Numbers of a stratum's tiles are below.
_TILES = 1 << 32


def _open(members: DataFrame) -> DataFrame:
    """Sets (``hub, cid, n, comp, slack, bytes``) of the groups in several components, less those that no set of another component can be similar to, by size and slack of their strata.

    Large groups come in strata, and in ``meets`` each has its partners with their numbers of tiles.
    """
    by = members.groupBy("hub", "comp").agg(F.count("*").alias("c"))
    of = shared.stored(by.groupBy("hub").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("hub", "main"))
    level = F.floor(8 * F.col("slack") / F.col("n")) + 8
    stratum = (F.floor(F.log("n") / F.log(F.lit(1.25))) * _STRATUM + F.greatest(F.lit(0), F.least(level, F.lit(_STRATUM - 1)))) * 2 + (F.col("comp") == F.col("main")).cast("int")
    rows = shared.stored(members.join(of, "hub").withColumn("stratum", F.when(F.col("large"), stratum).otherwise(0).cast("bigint")).select("hub", "cid", "n", "slack", "bytes", "comp", "stratum"))
    cells = shared.stored(rows.groupBy("hub", "stratum").agg(F.count("*").alias("c"), F.sum("bytes").alias("size"), F.min("slack").alias("slack"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.min("comp").alias("min_comp"), F.max("comp").alias("max_comp")).withColumn("parts", _parts("c", "size")).drop("c", "size"))
    to = cells.withColumnsRenamed({c: f"to_{c}" for c in cells.columns})
    alike = F.greatest("min_comp", "max_comp", "to_min_comp", "to_max_comp") == F.least("min_comp", "max_comp", "to_min_comp", "to_max_comp")
    can = (F.col("slack") + F.col("to_slack") <= 0) & (5 * F.col("max_n") >= 4 * F.col("to_min_n")) & (5 * F.col("to_max_n") >= 4 * F.col("min_n")) & ~alike
    met = cells.join(to, F.col("hub") == F.col("to_hub")).where(can)  # strata of a group, of which there are a few hundred at most
    meets = shared.stored(met.groupBy("hub", "stratum", "parts").agg(F.collect_list(F.struct("to_stratum", "to_parts")).alias("meets")))
    out = shared.stored(rows.join(meets, ["hub", "stratum"]).drop("bytes"))
    shared.dropped(of, rows, cells, meets)
    return out


def _in_blocks(members: DataFrame):
    """Sets (``hub, cid, n, slack, bits, comp``) grouped by pairs of tiles; sets without ``stratum, parts, meets`` are in one tile for each group."""
    if "meets" not in members.columns:
        whole = members.withColumns({"mine": F.lit(0).cast("bigint"), "other": F.lit(0).cast("bigint")})
    else:
        mine = F.col("stratum") * _TILES + F.pmod(F.xxhash64("cid"), F.col("parts"))
        tiles = F.flatten(F.transform("meets", lambda x: F.transform(F.sequence(F.lit(0).cast("bigint"), x.to_parts - 1), lambda k: x.to_stratum * _TILES + k)))
        whole = members.withColumn("mine", mine).withColumn("other", F.explode(tiles))
    return whole.select(F.col("hub").alias("of"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "n", "slack", "bits", "comp").groupBy("of", "i", "j")


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set numbers, components and distances of a tile or of a pair of tiles."""
    cid, n, comp, mine, slack = (table.column(c).to_numpy() for c in ("cid", "n", "comp", "mine", "slack"))
    bits = [x.values.to_numpy().view(U64) for x in table.column("bits")]
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    d = distances(n, bits, mine if across else np.arange(len(cid)))
    d[slack[:, None] + slack > 0] = np.inf
    return cid, comp, d


def _pairs(cid: np.ndarray, i: np.ndarray, j: np.ndarray, **more: pa.Array) -> pa.Table:
    return pa.table({"a": pa.array(np.minimum(cid[i], cid[j]), pa.int64()), "b": pa.array(np.maximum(cid[i], cid[j]), pa.int64()), **more})


def _forests(table: pa.Table) -> pa.Table:
    cid, _, d = _block(table)
    links = np.array(forest(d), np.int64).reshape(-1, 2)
    return _pairs(cid, links[:, 0], links[:, 1])


def _offers(most: int) -> Callable[[pa.Table], pa.Table]:
    """Each set's closest pairs with sets of other components, and whether it has more of them."""

    def offers(table: pa.Table) -> pa.Table:
        cid, comp, d = _block(table)
        d[comp[:, None] == comp] = np.inf
        k = min(most, len(cid))
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        i, at = np.nonzero(np.isfinite(np.take_along_axis(d, near, 1)))
        more = np.isfinite(d).sum(1) > k
        return _pairs(cid, i, near[i, at], more=pa.array(more[i]))

    return offers


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all of ``documents``."""
    return near_duplicates(shared.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
