"""The corpus pipeline: quality, exact and near deduplication, mixing and packing; each stage's result is written before the next.

All stages take the columns of documents, whatever further ones there are, and all but the last give exactly those. Null and empty texts, very long texts,
repeated rows, null ids and empty tables are defined for each: see the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laneatlas.llm import common, exact, mixing, packing, quality, similar

#: Columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier (op 10) accepts. It learns from labelled documents of the input alone.
    Null texts count as empty and have the score of a text without evidence; repeated rows are kept or dropped together; with no labels, or those of one class, all
    scores are that class's share; an empty table stays empty."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).where("predicted = 1").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies that differ in blanks at most (op 4): the longest, then the smallest doc_id (null last); of repeated rows one.
    Null, empty and blank texts are one group."""
    return exact.drop_exact_duplicates(docs).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, on shingles of five words: all pairs with a Jaccard similarity of 0.8 or more are linked.
    Of a component the smallest doc_id stays. Texts of fewer than five words are compared as a whole; texts without words are one group.
    The multi-index hashing of op 5 joins the close copies; as SimHashes differ in some 10 bits at 0.8, bands of MinHash name the rest. All are verified."""
    return similar.drop_similar(docs, words=5, least=0.8).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (op 6). A null source is one of its own, the last; repeated rows are rows of their own; an empty table
    stays empty. Nulls and ties within a source are as mixing.mix() has them."""
    return mixing.repeat_to_mix(docs).select(COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens (op 9). A null or empty text is its end id alone; repeated documents are packed once for each row."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training, hashing and packing cannot be expressed in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(common.work_tables())
    for _, stage in STAGES[:-1]:
        path = common.shared_dir(spark)
        docs = common.written(stage(spark, docs, sf_dir), path)
        for old in set(common.work_tables()) - others - {path}:  # also what the stage before has written
            common.remove(spark, old)
    return STAGES[-1][1](spark, docs, sf_dir)
