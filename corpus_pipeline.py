"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows that the one before it kept, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm import jaccard, packing, queries, ranking, repeats, secrets
from echolens.llm.common import Scratch, release


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the pairwise quality ranking puts below its cut; it learns from labelled rows that are not held out.

    Null and empty texts are judged like others, equal rows alike; an empty table stays empty; all columns are kept.
    """
    model = ranking.train(docs, queries.read(spark, sf_dir, "labels"), where=f"not ({queries.HELD_OUT})")
    return ranking.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that the n-gram Jaccard join links.

    The smallest id stays; documents without words are in no group and stay; of rows that repeat id and text one stays.
    """
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 50 words or more that occurs elsewhere too, all copies of it; null and empty texts stay as they are."""
    return _counted(repeats.without_repeats(docs, repeats.WORDS))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; null and empty texts stay as they are."""
    return _counted(secrets.masked(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequence and offset of each; a null or empty text has its closing id, an empty table gives no rows."""
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"))


#: (name, function) pairs; each function takes (spark, docs, sf_dir).
STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scan", secret_masks),
    ("cutting_stock_packing", packed),
]

#: Learned scores, sorted suffixes and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read back.

    When a stage's table is written, that of the stage before and what its
    operator has left are deleted.
    """
    docs, before = queries.read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        mark = len(Scratch.made)
        docs = scratch.table(stage(spark, docs, sf_dir))
        release(mark)
        if before is not None:
            before.clear()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
