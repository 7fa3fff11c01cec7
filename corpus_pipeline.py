"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes null ids and texts, empty and blank texts, texts of any length,
repeated rows and empty tables; other columns than COLUMNS are not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import jaccard, mixing, pieces, quality_rules, toxicity
from panelforge.llm.common import delete_path, fresh_path, shuffles_removed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null, empty and blank texts fail; repeated rows share one fate; an empty table stays empty."""
    return quality_rules.filter_documents(docs).select(COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; the lexicon is learnt from the table of labels. Null and empty texts are not toxic; without labels the seed words decide."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_documents(docs, lexicon).select(COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest id stays, of its texts the first by hash; another text of the same id
    is a document of its own. Rows without words or without an id all stay.
    """
    return jaccard.keep_one(docs, shingle=5, percent=80).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in a global random order. A null source is one source; a null id draws as the text "null"; equal ids draw alike."""
    return mixing.mix_sources(docs).select(COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; none for null and empty texts. Long texts are cut into chunks and put together again."""
    return pieces.encode_documents(docs.select(COLUMNS))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.lower().replace(" ", "-"))
        with shuffles_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs


#: The learnt lexicon and the encoding have no SQL form; a test works out the rows of a run one by one.
ORACLE_SQL = None
