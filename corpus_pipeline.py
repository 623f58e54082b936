"""A training-corpus pipeline: five stages over whole documents, each written and reread by the next.

Every stage but the last takes and returns the columns of documents; what a stage drops or changes is gone for those after it.

Defined results: a null text is an empty one (the classifier gives it the score of the bias alone, which decides on it; the other
stages keep it as it is, and packing makes one end mark of it); an empty table runs through and gives no pieces; columns beyond those
of documents end with the first stage, so their names cannot clash; rows of one doc_id with different texts are judged each by its own
text in every stage; of equal rows one stays after the near-duplicates, as of any other copies (rows without a doc_id or without words are no
copies and all stay).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.common import remove, scratch, shared_dir, table
from freshet.llm.minhash_dedup import deduplicated
from freshet.llm.packing import pack
from freshet.llm.quality_classifier import accepted
from freshet.llm.secret_scan import masked
from freshet.llm.suffix_dedup import cleaned

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too."""
    return cleaned(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret replaced."""
    return masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, packed into sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("near-duplicates", near_unique),
    ("repeated passages", without_repeats),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; a test follows run() stage by stage with plain Python on a small fixture.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage leaves in the shared folder goes once the next one's output is whole."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/freshet/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
