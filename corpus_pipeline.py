"""From raw documents to a training mix: five stages, each over all rows that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them back for the next.

All columns of a row travel as one struct beside what a stage works on, so they come back as they were, whatever
their names. Repeated rows are judged one by one and alike, texts of any length whole, an empty table gives no rows.
What a stage does with NULL and empty texts is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import text_or_empty, written
from tidegrid.llm.decontaminate import contamination
from tidegrid.llm.language import UNDETERMINED, identify_languages, learn_languages
from tidegrid.llm.mixing import mix_sources, with_size
from tidegrid.llm.near_dedup import near_duplicates
from tidegrid.llm.quality import MODEL_BUCKETS, quality_rules

#: A document is rejected when its language's filter holds a smaller share of its n-grams.
LEAST_COVERAGE = 0.5


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns as the struct ``row``."""
    return docs.select(*names, F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; NULL, empty and short texts go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules(_packed(docs, "doc_id", "text"), labels, buckets=MODEL_BUCKETS, threshold=None)
    return judged.where("kept").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the filters learn from the text and ``lang`` of the rows the stage is given.

    NULL and empty texts and those without a letter go.
    """
    judged = identify_languages(_packed(docs, "text"), learn_languages(docs.select("text", "lang")), "coverage")
    kept = (F.col("lang_pred") != UNDETERMINED) & (F.col("coverage") >= LEAST_COVERAGE)
    return judged.where(kept).select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with their id and a hash of their text, which tells rows of equal ids apart."""
    return _packed(docs, "doc_id", F.xxhash64(text_or_empty(F.col("text"))).alias("text_key"))


def _judged(docs: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that occur in ``named`` (``doc_id, text_key``), or do not."""
    others = named.select(F.col("doc_id").alias("other_id"), F.col("text_key").alias("other_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_key") == F.col("other_key"))
    return _keyed(docs).join(others.hint("merge"), same, how).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group; NULL and empty texts are alone in theirs."""
    return _judged(docs, near_duplicates(docs).where("kept"), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by ``benchmark``; NULL and empty texts have none."""
    found = contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _judged(docs, found.where("contaminated"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document taken, with the number of ``copies`` and the words ``taken``.

    The columns this adds replace those of the same name. NULL and empty texts have no words and are taken for none.
    """
    return mix_sources(with_size(docs)).where("copies > 0")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language ID, near-duplicate search and the hashed likelihood ratio have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
