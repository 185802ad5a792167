"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  The automaton holds all items
of a shard as word sequences.  A document's words are streamed through it; at each word it knows the
longest suffix that occurs in some item.  A length of ``window`` words or more, or a whole item that is
shorter, is an occurrence; its words are hit.

An automaton is flat sorted arrays.  It is broadcast, and its size is checked in bytes: items are dealt
to shards of about ``SHARD_WORDS`` words, a pass over the documents takes the shards that fit into
``PASS_BYTES``, and more shards take more passes over what the one before has written.  Documents are never
shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, textbuf

WINDOW = 10
#: Words of test items in one automaton, and bytes of the automata that a worker holds at once.
SHARD_WORDS, PASS_BYTES = 1_000_000, 256 << 20
#: Words of a document that are streamed as one lane; lanes of a document overlap by less than a window.
LANE = 256
WORD = textbuf.byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_HITS = "array<struct<first:long,last:long,start:long,end:long>>"


def words_of(text: str) -> list[bytes]:
    raw = text.encode().translate(bytes(b if WORD[b] else 0x20 for b in textbuf.LOWER))
    return raw.split()


class _Builder:
    """The automaton while items are added: of most states one transition is all there is, and it lies in arrays."""

    def __init__(self):
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {0: {}}
        self.link, self.len = array("i", [-1]), array("i", [0])

    def get(self, v: int, w: int) -> int:
        if self.word[v] == w:
            return self.to[v]
        more = self.more.get(v)
        return -1 if more is None else more.get(w, -1)

    def put(self, v: int, w: int, to: int) -> None:
        if self.word[v] in (-1, w):
            self.word[v], self.to[v] = w, to
        else:
            self.more.setdefault(v, {})[w] = to

    def new(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def split(self, p: int, q: int, w: int) -> int:
        """The part of *q* that is reached from *p* by *w* as a state of its own."""
        if self.len[q] == self.len[p] + 1:
            return q
        part = self.new(self.len[p] + 1, self.link[q])
        self.word[part], self.to[part] = self.word[q], self.to[q]
        if q in self.more:
            self.more[part] = dict(self.more[q])
        self.link[q] = part
        while p >= 0 and self.get(p, w) == q:
            self.put(p, w, part)
            p = self.link[p]
        return part

    def extend(self, last: int, w: int) -> int:
        there = self.get(last, w)
        if there >= 0:  # another item has this prefix of a suffix already
            return self.split(last, there, w)
        new = self.new(self.len[last] + 1, 0)
        p, q = last, -1
        while p >= 0 and (q := self.get(p, w)) < 0:
            self.put(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self.split(p, q, w)
        return new


class Automaton:
    """A generalised suffix automaton over word numbers, in arrays, with the items of its windows.

    ``key`` has the transitions, state and word, sorted, and ``to`` their targets; ``link`` and ``len`` are
    as usual.  ``full`` is the state at or above each one whose strings include one of exactly *window* words
    (-1: none), ``short`` the nearest at or above that is a whole item of fewer words (0: none).
    ``of`` and ``items`` list the items, by number, of full and short states.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        number: dict[bytes, int] = {}
        b, coded = _Builder(), []
        for _, words in items:
            ids = [number.setdefault(w, len(number)) for w in words]
            coded.append(ids)
            last = 0
            for w in ids:
                last = b.extend(last, w)
        self.names = [item for item, _ in items]
        self.link, self.len = np.array(b.link, np.int32), np.array(b.len, np.int32)
        self.link[0] = 0
        one = np.flatnonzero(np.array(b.word) >= 0)
        n_more = sum(map(len, b.more.values()))
        state = np.concatenate([one, np.fromiter((v for v, m in b.more.items() for _ in m), np.int64, n_more)]).astype(np.int64)
        word = np.concatenate([np.array(b.word, np.int64)[one], np.fromiter((w for m in b.more.values() for w in m), np.int64, n_more)])
        to = np.concatenate([np.array(b.to, np.int32)[one], np.fromiter((t for m in b.more.values() for t in m.values()), np.int32, n_more)])
        del b
        key = state << 32 | word
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]
        # the first ancestor, itself included, that is not longer than a window below its link
        self.full = self._climbed(self.len[self.link] < window)
        self.full[self.len[self.full] < window] = -1
        ranges, vocabulary = textbuf.Ranges(303), list(number)
        at = np.concatenate([[0], np.cumsum([len(w) for w in vocabulary])]).astype(np.int64)
        h = ranges.over(np.frombuffer(b"".join(vocabulary), np.uint8)).hash(at[:-1], at[1:])
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order.astype(np.int32)
        # the items' own words through the automaton give the items of each window
        flat = np.fromiter((w for ids in coded for w in ids), np.int64)
        size = np.array([len(ids) for ids in coded], np.int64)
        self.least = int(np.minimum(size[size > 0], window).min()) if (size > 0).any() else 0
        begin = np.cumsum(size) - size
        v, length = self.stream(flat, begin, begin + size)
        owner = np.repeat(np.arange(len(size)), size)
        ends = (begin + size - 1)[(size > 0) & (size < window)]
        on = length >= window
        pairs = np.unique(np.stack([np.concatenate([self.full[v[on]], v[ends]]), np.concatenate([owner[on], owner[ends]])], 1).astype(np.int64), axis=0)
        self.of, self.items = pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32)
        whole = np.zeros(len(self.len), bool)
        whole[v[ends]] = True
        whole[0] = True
        self.short = self._climbed(whole)

    def _climbed(self, stop: np.ndarray) -> np.ndarray:
        """The nearest state at or above each one where *stop* holds; the root's link is the root."""
        f = np.where(stop, np.arange(len(stop), dtype=np.int32), self.link)
        while True:
            g = f[f]
            if (g == f).all():
                return f
            f = g

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def code(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of word hashes, -1 for words that no item has."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], -1).astype(np.int64)

    def stream(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and matching length after each word of the stretches ``words[begin:end]`` of known words.

        A long stretch is cut into lanes that run side by side; a lane begins early enough to know each
        of its own words' length up to a window.
        """
        state, length = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        size = end - begin
        many = np.maximum(-(-size // LANE), 1)
        lane = np.repeat(begin, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * LANE
        first, stop = np.repeat(begin, many), np.minimum(lane + LANE, np.repeat(end, many))
        start = np.maximum(lane - (self.window - 1), first)
        n = stop - start
        order = np.argsort(-n, kind="stable")
        start, lane, n = start[order], lane[order], n[order]
        v, m = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        live = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), "left")
        for t, k in enumerate(live.tolist()):
            at = start[:k] + t
            w = words[at]
            some = np.arange(k)
            while len(some):
                place = np.minimum(np.searchsorted(self.key, key := v[some].astype(np.int64) << 32 | w[some]), len(self.key) - 1)
                found = self.key[place] == key
                done = some[found]
                v[done] = self.to[place[found]]
                m[done] += 1
                some = some[~found]
                m[some[v[some] == 0]] = 0
                some = some[v[some] != 0]
                v[some] = self.link[v[some]]
                m[some] = self.len[v[some]]
            own = at >= lane[:k]
            state[at[own]], length[at[own]] = v[:k][own], m[:k][own]
        return state, length

    def listed(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into *state* and items, one for each item of each state."""
        a, b = np.searchsorted(self.of, state), np.searchsorted(self.of, state, "right")
        n = b - a
        return np.repeat(np.arange(len(state)), n), self.items[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def occurrences(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hit stretches (first word and end, not united), and pairs of text and item, in texts whose words begin at *first*."""
        none = np.zeros(0, np.int64)
        if not self.least or not len(code):
            return none, none, none, none
        # stretches of known words inside one text, long enough for a window
        known = np.concatenate([[False], code >= 0, [False]])
        cut = np.zeros(len(code) + 1, bool)
        cut[first] = True
        begin = np.flatnonzero(known[1:] & (~known[:-1] | cut))
        begin = begin[begin < len(code)]
        end = np.flatnonzero(known[:-1] & (~known[1:] | cut))
        keep = end - begin >= self.least
        state, length = self.stream(code, begin[keep], end[keep])
        text = lambda at: np.searchsorted(first, at, "right") - 1
        at = np.flatnonzero(length >= self.window)
        starts, ends, texts, items = [at + 1 - self.window], [at + 1], [], []
        # a passage has its windows' states again and again
        pair = np.unique(text(at) << 32 | self.full[state[at]])
        row, item = self.listed((pair & 0xFFFFFFFF).astype(np.int32))
        texts.append(pair[row] >> 32)
        items.append(item)
        at = np.flatnonzero(length)
        v = self.short[state[at]]
        while len(at := at[v > 0]):
            v = v[v > 0]
            n = self.len[v]
            fits = n <= length[at]
            starts.append(at[fits] + 1 - n[fits])
            ends.append(at[fits] + 1)
            row, item = self.listed(v[fits])
            texts.append(text(at[fits])[row])
            items.append(item)
            v = self.short[self.link[v]]
        return tuple(np.concatenate(x).astype(np.int64) for x in (starts, ends, texts, items))


def _shards(benchmark: DataFrame, id_col: str, text_col: str, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items, a shard at a time; the driver never holds more than about *shard_words* words and one item."""
    rows = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    some: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if words:
            some.append((row["item"], words))
            size += len(words)
        if size >= shard_words:
            yield some
            some, size = [], 0
    if some:
        yield some


def _passes(benchmark: DataFrame, window: int, id_col: str, text_col: str, shard_words: int, pass_bytes: int) -> Iterator[list]:
    """Broadcast automata, those of a pass together: as many as fit into *pass_bytes*, and one at least."""
    spark = benchmark.sparkSession
    some, held = [], 0
    for shard in _shards(benchmark, id_col, text_col, shard_words):
        automaton = Automaton(shard, window)
        size = automaton.bytes
        if some and held + size > pass_bytes:
            yield some
            some, held = [], 0
        some.append(spark.sparkContext.broadcast(automaton))
        held += size
    if some:
        yield some


def _united(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that overlap or touch as one, in order."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    begin = np.flatnonzero(new)
    return first[begin], last[np.append(begin[1:], len(first)) - 1] if len(first) else last


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, hits, items`` for each row of *docs*, its text if *with_text*, and the columns *carry* in a struct ``rest``.

    ``hits`` are the maximal stretches of hit words, as word numbers and as code points of the text, ends
    exclusive; ``items`` the ids of items with an occurrence, sorted as strings.  A null or empty text has
    no words; items that are null or have no id hit nothing, and items with the same id count once.
    Rows are looked at one by one: ids may be null or repeat.  Without items nothing is hit.
    """
    now = shared.keyed(docs, id_col, text_col, carry, nulls=True).withColumns({"hits": F.lit(None).cast(_HITS), "items": F.lit(None).cast("array<string>")})
    done = None
    parts = list(_passes(benchmark, window, item_col, item_text_col, shard_words, pass_bytes)) or [[]]
    for number, automata in enumerate(parts):
        final = number == len(parts) - 1
        out = (["text"] if with_text or not final else []) + (["rest"] if carry else [])
        kind = T.StructType([*T.StructType.fromDDL(f"doc_id long, n_words long, hits {_HITS}, items array<string>").fields, *(now.schema[c] for c in out)])
        now = now.mapInArrow(shared.frugal(_stream(automata, out, number > 0)), kind)
        if not final:  # the next pass reads what this one has found
            now = shared.stored(now)
            if done is not None:
                shared.dropped(done)
            done = now
    return now


def _stream(automata: list, out: list[str], again: bool):
    """Arrow batches with hits and items; with *again*, those of earlier passes are in the batches."""
    hit = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])

    def run_over(batch: pa.RecordBatch, run: textbuf.Run, ranges: textbuf.Ranges) -> tuple[np.ndarray, pa.Array, pa.Array]:
        n = len(run)
        lower = textbuf.LOWER[run.data] if len(run.data) else run.data
        s, e, first = textbuf.spans(textbuf.Run(lower, run.at, 0), WORD)
        h = ranges.over(lower).hash(s, e)
        starts, ends, names = [], [], [set() for _ in range(n)]
        for sent in automata:
            a = sent.value
            x, y, texts, items = a.occurrences(a.code(h), first)
            starts.append(x)
            ends.append(y)
            for d, item in zip(texts.tolist(), items.tolist(), strict=True):
                names[d].add(a.names[item])
        if again:
            for name, field in ((starts, "first"), (ends, "last")):
                found = batch.column(batch.schema.get_field_index("hits")).slice(run.first, n)
                size = np.diff(np.asarray(found.offsets))
                name.append(found.flatten().field(field).to_numpy().astype(np.int64) + np.repeat(first[:-1], size))
            for d, old in enumerate(batch.column(batch.schema.get_field_index("items")).slice(run.first, n).to_pylist()):
                names[d].update(old)
        x = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        y = np.concatenate(ends) if ends else x
        # texts don't touch: a gap of a word after each keeps their stretches apart
        text = np.searchsorted(first, x, "right") - 1
        x, y = _united(x + text, y + text)
        text = np.searchsorted(first + np.arange(n + 1), x, "right") - 1
        x, y = x - text, y - text
        heads = np.concatenate([[0], np.cumsum((run.data & 0xC0) != 0x80)])
        at = heads[run.at[text]]
        columns = [x - first[text], y - first[text], heads[s[x]] - at, heads[e[y - 1]] - at] if len(x) else [x] * 4
        hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], fields=list(hit)))
        return np.diff(first), hits, pa.array([sorted(x) for x in names], pa.list_(pa.string()))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = textbuf.Ranges(303)
        for batch in batches:
            parts = [run_over(batch, run, ranges) for run in textbuf.runs(textbuf.string_column(batch, "text"))]
            if not parts:
                continue
            count, hits, items = zip(*parts, strict=True)
            kept = [batch.column(batch.schema.get_field_index(name)) for name in out]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.concatenate(count)), pa.concat_arrays(hits), pa.concat_arrays(items), *kept], names=["doc_id", "n_words", "hits", "items", *out])

    return stream


def n_hit() -> F.Column:
    """The number of hit words, from ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, **columns: str) -> DataFrame:
    """``doc_id, text`` without the hit stretches; documents of which more than *max_coverage* is hit go.

    Nulls, empty tables and repeated rows: as :func:`find_hits`.
    """
    found = find_hits(docs, benchmark, window, with_text=True, **columns).withColumn("text", F.coalesce("text", F.lit("")))
    kept = found.where(n_hit() <= F.col("n_words") * max_coverage)
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("hits")),
        lambda i: F.substring(
            F.col("text"),
            F.when(i == 0, F.lit(1)).otherwise((F.get("hits", i - 1)["end"] + 1).cast("int")),
            F.when(i == F.size("hits"), F.length("text")).otherwise((F.get("hits", i)["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("hits", i - 1)["end"])).cast("int")),
        ),
    )
    return kept.select("doc_id", F.when(F.size("hits") == 0, F.col("text")).otherwise(F.array_join(gaps, "")).alias("text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of :func:`find_hits` over all of ``documents`` and ``benchmark``."""
    found = find_hits(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
