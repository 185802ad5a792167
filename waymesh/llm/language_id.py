"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, from expected piece counts
in its training texts.  A word's probability in a language is the sum over all its segmentations (forward
algorithm), a text's the product over its words; the language with the largest one is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lattice, shared, textbuf

#: The model is fitted on about so many training texts of each language, chosen by hash; nothing else is sampled.
TEXTS_PER_LANGUAGE = 250
#: Passes of expectation and maximisation, and the weight of the vocabulary's own scores in counts.
PASSES, PRIOR = 2, 200.0
#: Evidence counts as from so many words at most when it becomes a score.
SCORE_WORDS = 12
UNKNOWN = "und"
#: More languages are an error: the model, which is broadcast, has about 200 kB for each.
MOST_LANGUAGES = 512
WORD = textbuf.byte_set((0x61, 0x7A), (0x80, 0xFF))


def _words(run: textbuf.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lower = textbuf.LOWER[run.data] if len(run.data) else run.data
    s, e, first = textbuf.spans(textbuf.Run(lower, run.at, 0), WORD)
    return lower, s, e, first


class Model:
    """Languages, sorted, and a column of piece probabilities for each."""

    def __init__(self, languages: list[str], probability: np.ndarray, pieces: list[bytes]):
        self.languages, self.probability, self.pieces = languages, probability, pieces


def fit(docs: DataFrame, lang_col: str = "lang", train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Fits the model to rows where *train* holds and text and language aren't null.

    About *per_language* texts of each language are used, those with the smallest hashes of id and text; rows
    alike in both count once.  Each language is fitted in a task of its own.  Without any such row the
    model has no language.
    """
    pieces, prior = lattice.vocabulary(vocabulary)
    rows = docs.where(F.lit(True) if train is None else train).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"), F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(1 << 30)).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Model([], np.zeros((len(pieces) + 256, 0)), pieces)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, per_language / n) * (1 << 30)) + 1)))
    sample = rows.where(F.col("h") < share[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def learn(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        grid = lattice.Lattice(pieces)
        table = table.sort_by([("h", "ascending"), ("text", "ascending")]).slice(0, 2 * per_language)
        text = table.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0)
        total: dict[bytes, int] = {}
        for run in textbuf.runs(text):
            lower, s, e, _ = _words(run)
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                w = lower[a:b].tobytes()
                total[w] = total.get(w, 0) + 1
        start = np.concatenate([[*prior * 0.99], np.full(256, 0.01 / 256)])
        p = start
        if total:
            raw = np.frombuffer(b"".join(b" " + w for w in total), np.uint8)
            stop = np.cumsum([len(w) + 1 for w in total])
            begin = np.concatenate([[0], stop[:-1]])
            count = np.array(list(total.values()), float)
            for _ in range(PASSES):
                uses = grid.expected(raw, begin, stop, count, grid.scaled(p)) + PRIOR * start
                p = uses / uses.sum()
        return pa.table({"lang": [lang], "p": pa.array([p.tolist()], pa.list_(pa.float64()))})

    fitted = sorted((r["lang"], np.array(r["p"])) for r in sample.groupBy("lang").applyInArrow(learn, "lang string, p array<double>").collect())
    return Model([lang for lang, _ in fitted], np.stack([p for _, p in fitted], 1) if fitted else np.zeros((len(pieces) + 256, 0)), pieces)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of *docs*; with *carry*, also its ``text`` as it is and those columns in a struct ``rest``.

    A text that is null or has no letter, or any text under a model without languages, is ``und`` with score
    0.  Ties go to the first language in sorting order.  Ids may be null or repeat; other columns aren't read.
    """
    base = shared.keyed(docs, id_col, text_col, carry or (), nulls=True)
    more = [f.name for f in base.schema.fields[1:]] if carry is not None else []
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = [*m.languages, UNKNOWN]
        grid = lattice.Lattice(m.pieces)
        memo = lattice.Memo(grid, grid.scaled(m.probability)) if m.languages else None
        ranges = textbuf.Ranges(808)
        for batch in batches:
            which, score = [], []
            for run in textbuf.runs(textbuf.string_column(batch, "text")):
                lower, s, e, first = _words(run)
                letters = np.diff(first) > 0
                # words of other bytes than a-z may have no letter in them
                ascii_letter = np.concatenate([[0], np.cumsum((lower >= 0x61) & (lower <= 0x7A))])
                for d in np.flatnonzero(letters & (ascii_letter[run.at[1:]] == ascii_letter[run.at[:-1]])):
                    letters[d] = any(c.isalpha() for c in run.text(d).decode())
                if memo is None:
                    letters[:] = False
                best, value = np.full(len(run), len(m.languages)), np.zeros(len(run))
                if letters.any():
                    each = memo.sums(lower, s, e, ranges.over(lower).hash(s, e))
                    total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, 0)])
                    log = (total[first[1:]] - total[first[:-1]])[letters]
                    log *= np.minimum(1, SCORE_WORDS / np.diff(first)[letters])[:, None]
                    p = np.exp(log - log.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best[letters], value[letters] = p.argmax(1), p.max(1)
                which.append(best)
                score.append(value)
            which = np.concatenate(which) if which else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(names).take(pa.array(which.astype(np.int64))), pa.array(np.concatenate(score) if score else [], pa.float64()), *(batch.column(batch.schema.get_field_index(c)) for c in more)], names=["doc_id", "lang_pred", "score", *more])

    kind = T.StructType([*T.StructType.fromDDL("doc_id long, lang_pred string, score double").fields, *(base.schema[c] for c in more)])
    return base.mapInArrow(shared.frugal(predict), kind)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all of ``documents``, learnt from four fifths of them."""
    docs = shared.table(spark, sf_dir, "documents")
    held_out = shared.fold(F.col("doc_id"), 5) == 0
    found = identify(docs, fit(docs, train=~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
