"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

Language ID drops documents without a recognisable language; line dedup takes out lines that three or more
documents repeat; the n-gram join keeps the smallest id of each near-duplicate component;
decontamination drops documents with a benchmark passage; packing lays out what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.llm import bloom, decontaminate, jaccard_join, language_id, line_dedup, packing, shared

#: The least score of a prediction that language ID accepts; a guess among four languages has 0.25.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognisable language; each row is judged by its own text, whatever its id."""
    model = language_id.fit(docs, train=shared.fold(F.col("doc_id"), 5) != 0)
    found = language_id.identify(docs, model, carry=shared.carried(docs))
    return shared.unpacked(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines."""
    rebuilt = line_dedup.dedup_lines(docs, carry=shared.carried(docs))
    out = shared.unpacked(rebuilt, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component.

    A row is known by its id and its text, so of rows that share an id each has its own fate; rows alike in
    both stay or go together.  A row without an id is in no component and stays.
    """
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    found = jaccard_join.near_duplicates(docs.withColumn("near_tag", tag), carry=("near_tag",))
    gone = shared.stored(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone_id"), F.col("rest.near_tag").alias("gone_tag")))
    # texts whose ids a filter doesn't have stay where they are
    some, others = bloom.parted(docs, gone.select("gone_id"))
    return some.join(gone, (some["doc_id"] == gone["gone_id"]) & (tag == gone["gone_tag"]), "left_anti").unionByName(others)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; each row is judged by its own text, whatever its id."""
    found = decontaminate.find_hits(docs, shared.table(spark, sf_dir, "benchmark"), carry=shared.carried(docs), with_text=True)
    return shared.unpacked(found.where(F.size("hits") == 0), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near), ("benchmark decontamination", leaks), ("best-fit packing", packed)]

#: Language ID and the near-duplicate join can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again as the next one's input."""
    docs = shared.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = shared.stored(docs)
    return docs
