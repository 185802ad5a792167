"""Source divergence audit: how far each source's words are from those of the other sources of its language.

1. Tasks count terms by language and source where the texts lie, and combine before they shuffle.
2. Terms of enough documents are kept, dealt to chunks of the vocabulary by their hash, and numbered within
   a chunk; each group's counts of a chunk are packed into one row.
3. Groups are dealt to blocks.  A task is a tile, a block by a block, over a slab of successive chunks: packed
   vectors are replicated to the tiles of their block, and a tile has one chunk of its vectors in memory at a
   time.  A pair's terms that neither group has are all alike, and are added by their number.
4. Slabs of a pair are summed, and partners and terms ranked.

All arithmetic is on integers.  Counts of a language may reach 2.8e14 and its kept terms 2e9.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textbuf

MIN_DOCS = 3
#: Ranks of terms that are returned.
TERMS = 200
#: Groups of a block, terms of a chunk and rows of a chunk (about), and chunks of a slab.
BLOCK, CHUNK, CHUNK_ROWS, SLAB = 64, 4096, 1 << 18, 16
#: Rows that a task combines before it hands them on.
COMBINED = 400_000

_TERM = ~textbuf.byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_COUNTS = "lang string, source string, term string, n long, docs long"
_PAIRS = "lang string, source string, item string, value long, terms long"


def _merged(tables: list[pa.Table]) -> pa.Table:
    grouped = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return grouped.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def _counted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Counts of terms, and documents with them, by group; and each group once with a null term."""
    import pyarrow.compute as pc

    lang, source = (pc.dictionary_encode(textbuf.string_column(batch, c)) for c in ("lang", "source"))
    of = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    pairs, group = np.unique(of, return_inverse=True)
    names = [d.dictionary.take(pa.array(k)) for d, k in ((lang, pairs // max(1, len(source.dictionary))), (source, pairs % max(1, len(source.dictionary))))]
    zero = pa.array(np.zeros(len(pairs), np.int64))
    yield pa.table({"lang": names[0], "source": names[1], "term": pa.nulls(len(pairs), pa.string()), "n": zero, "docs": zero})
    for run in textbuf.runs(textbuf.string_column(batch, "text"), 4 << 20):
        start, end, first = textbuf.spans(run, _TERM)
        if not len(start):
            continue
        at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        letters = textbuf.LOWER[run.data[_TERM[run.data]]]
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(letters)).dictionary_encode()
        m = len(words.dictionary)
        held, n = np.unique(np.repeat(np.arange(len(run)), np.diff(first)) * m + words.indices.to_numpy(), return_counts=True)
        key = group[run.first + held // m] * m + held % m
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[begin]
        g = pa.array(key // m)
        yield pa.table({"lang": names[0].take(g), "source": names[1].take(g), "term": words.dictionary.take(pa.array(key % m)), "n": pa.array(np.add.reduceat(n[order], begin)), "docs": pa.array(np.diff(np.append(begin, len(order))).astype(np.int64))})


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some, rows = [], 0
    for batch in batches:
        for table in _counted(batch):
            some.append(table)
            rows += len(table)
            if rows > COMBINED:
                some = [_merged(some)]
                rows = len(some[0])
                if rows > COMBINED // 2:
                    yield from some[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                    some, rows = [], 0
    if some:
        yield from _merged(some).combine_chunks().to_batches(max_chunksize=1 << 16)


def kept_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n`` of kept terms, with ``total`` in the language and ``first`` (once for each term); and each group with a null term."""
    shared.in_batches(docs.sparkSession)
    base = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = base.mapInArrow(shared.frugal(_combined), _COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    known = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"), F.min("source").over(of_term).alias("one"))
    return known.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "source", "term", "n", "total", (F.col("term").isNotNull() & (F.col("source") == F.col("one"))).alias("first"))


def _share(count: str, total: str) -> str:
    """``1 + floor(1000000000 * (count + 1) / total)`` in two steps, so that no product is too long."""
    return f"1 + (({count} + 1) * 32000) div {total} * 31250 + ((({count} + 1) * 32000) % {total} * 31250) div {total}"


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of a matrix, a row's total beside it."""
    a = (counts + 1) * 32000
    return 1 + a // total * 31250 + a % total * 31250 // total


class _Tile:
    """Sums of one tile over the chunks of a slab."""

    def __init__(self, lang: str, same: bool, sides: list[dict[str, int]]):
        self.lang, self.same = lang, same
        self.names = [list(s) for s in sides]
        self.place = [{name: k for k, name in enumerate(names)} for names in self.names]
        self.total = [np.array(list(s.values()), np.int64)[:, None] for s in sides]
        # what either side's groups are to the other's, and the terms looked at
        self.value = [np.zeros((len(sides[0]), len(sides[1])), np.int64) for _ in range(2)]
        self.terms = 0

    def add(self, vectors: list[tuple[int, str, np.ndarray, np.ndarray]]) -> None:
        """One chunk's packed vectors: the side, the source, places and counts."""
        if not vectors:
            return
        places = np.unique(np.concatenate([v[2] for v in vectors]))
        shares = []
        for side in range(2 - self.same):
            counts = np.zeros((len(self.names[side]), len(places)), np.int64)
            for s, name, at, n in vectors:
                if s == side:
                    counts[self.place[side][name], np.searchsorted(places, at)] = n
            shares.append(_shares(counts, self.total[side]))
        self.terms += len(places)
        left, right = shares[0], shares[-1]
        for i, p in enumerate(left):
            square = (right - p) ** 2
            self.value[0][i] += (square // right).sum(1)
            if not self.same:
                self.value[1][i] += (square // p).sum(1)

    def rows(self) -> pa.RecordBatch:
        a, b = (np.array(x, object) for x in self.names)
        i, j = (x.ravel() for x in np.indices(self.value[0].shape))
        if self.same:
            apart = i != j
            source, item, value = a[i[apart]], b[j[apart]], self.value[0].ravel()[apart]
        else:
            source, item, value = np.concatenate([a[i], b[j]]), np.concatenate([b[j], a[i]]), np.concatenate([self.value[0].ravel(), self.value[1].ravel()])
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value), pa.array(np.full(n, self.terms, np.int64))], names=["lang", "source", "item", "value", "terms"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        plain = zip(*(column[c].to_pylist() for c in ("lang", "left", "right", "slab", "chunk", "side", "source", "total")), strict=True)
        for k, row in enumerate(plain):
            yield *row, column["at"][k].values, column["n"][k].values


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile come together, first its groups (chunk -1), then one chunk after the other."""
    for (lang, left, right, _), rows in groupby(_rows(batches), key=lambda r: r[:4]):
        tile, sides = None, [{}, {}]
        for chunk, some in groupby(rows, key=lambda r: r[4]):
            if chunk < 0:
                for r in some:
                    sides[r[5]][r[6]] = r[7]
                tile = _Tile(lang, left == right, [sides[0], sides[0] if left == right else sides[1]])
            else:
                tile.add([(r[5], r[6], r[8].to_numpy(), r[9].to_numpy()) for r in some])
        yield tile.rows()


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, terms: int = TERMS, block: int = BLOCK, chunk: int = CHUNK, slab: int = SLAB) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's other sources (``pair``) and most telling terms (``term``).

    A null language, source or text counts as empty.  Each row is a document, also rows that are alike or
    share an id; other columns aren't read.  A group without terms has its pairs; a language of one source
    has none.  Ties go by the item's bytes.  No rows in, no rows out.
    """
    known = shared.stored(kept_terms(docs, lang_col, source_col, text_col, min_docs))
    groups = known.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    langs = known.groupBy("lang").agg(F.sum("n").alias("held_lang"), F.count_if("first").alias("v"), F.count_if(F.col("term").isNotNull()).alias("rows"), F.count_if(F.col("term").isNull()).alias("groups"))
    sizes = langs.select(
        "lang",
        "v",
        F.col("held_lang"),
        F.ceil(F.col("groups") / block).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.col("v") / chunk), F.ceil(F.col("rows") / CHUNK_ROWS), F.lit(1)).cast("int").alias("chunks"),
    )
    of = shared.stored(groups.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))
    terms_of = known.where(F.col("term").isNotNull()).join(of, ["lang", "source"])

    ranked = terms_of.withColumns({"p": F.expr(_share("n", "(held + v)")), "q": F.expr(_share("total", "(held_lang + v)"))}).where("p > q")
    ranked = ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = ranked.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= terms)

    numbered = terms_of.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    vectors = numbered.groupBy("lang", "chunk", "source").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("counts"), *(F.first(c).alias(c) for c in ("block", "blocks")))
    slabs = F.explode(F.sequence(F.lit(0), ((F.col("chunks") - 1) / slab).cast("int"))).alias("slab")
    heads = of.select("lang", F.lit(-1).alias("chunk"), "source", (F.col("held") + F.col("v")).alias("total"), F.array().cast("array<int>").alias("at"), F.array().cast("array<bigint>").alias("n"), "block", "blocks", slabs)
    packed = vectors.select("lang", "chunk", "source", F.lit(0).cast("bigint").alias("total"), F.col("counts.at").alias("at"), F.col("counts.n").alias("n"), "block", "blocks", (F.col("chunk") / slab).cast("int").alias("slab"))
    copies = heads.unionByName(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = copies.select("lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "slab", "chunk", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "source", "total", "at", "n")
    tile = ["lang", "left", "right", "slab"]
    parts = dealt.repartition(*tile).sortWithinPartitions(*tile, "chunk", "side", "source").mapInArrow(shared.frugal(_tiles), _PAIRS)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    # terms that neither has
    one, two = (of.select("lang", F.col("source").alias(name), (F.col("held") + F.col("v")).alias(total), *extra) for name, total, extra in (("source", "total", ["v"]), ("item", "other_total", [])))
    none = pairs.join(one, ["lang", "source"]).join(two, ["lang", "item"]).withColumns({"p": F.expr(f"if(v = 0, 1, {_share('0L', 'nullif(total, 0)')})"), "q": F.expr(f"if(v = 0, 1, {_share('0L', 'nullif(other_total, 0)')})")})
    pair = none.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("value + (v - terms) * ((p - q) * (p - q) div q)").alias("value")).withColumn("rank", F.row_number().over(by_value))
    return pair.unionByName(ranked)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all groups of ``documents``."""
    return divergence(shared.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS held FROM k GROUP BY lang),
h AS (SELECT c.lang, c.source, c.term, c.n, k.total FROM c JOIN k ON c.lang = k.lang AND c.term = k.term),
g AS (SELECT d.lang, d.source, coalesce(max(s.held), 0) AS held FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS held FROM h GROUP BY lang, source) s ON d.lang = s.lang AND d.source = s.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, 1 + (1000000000 * (coalesce(h.n, 0) + 1)) // (g.held + v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT h.lang, h.source, h.term, 1 + (1000000000 * (h.n + 1)) // (g.held + v.v) AS p, 1 + (1000000000 * (h.total + 1)) // (v.held + v.v) AS q
  FROM h JOIN g ON h.lang = g.lang AND h.source = g.source JOIN v ON h.lang = v.lang),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM q WHERE p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
