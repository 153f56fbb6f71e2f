"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each one's result as Parquet under ``spark.checkpoint.dir`` and reads it again
for the next. All but the last return the columns of ``documents``.

* quality: documents that the factorisation machine scores below 0.7 go. It is
  trained on the labelled ones among the documents.
* language: documents without a letter, or whose predicted language scores
  below 0.5, go.
* near duplicates: of each class of documents with a Jaccard similarity of 0.8 or
  more on five-word shingles, the one with the smallest id stays.
* decontamination: windows of benchmark items are cut out of the texts;
  documents with more than half of their words hit go.
* packing: the place of every piece in sequences of 2048 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kipmart.llm import common
from kipmart.llm import op3_packing as packing
from kipmart.llm import op4_language_id as language_id
from kipmart.llm import op5_decontamination as benchmark
from kipmart.llm import op8_jaccard_join as jaccard
from kipmart.llm import op9_quality_classifier as quality_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that Spark hands to a Python worker at once: whole documents, held in both
#: processes, in and out.
BATCH_ROWS = 2000


def _prepare(spark: SparkSession) -> None:
    common.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    labels = common.read(spark, sf_dir, "labels")
    return quality_model.keep_good(docs, quality_model.train(docs, labels, quality_model.learn_rows()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return language_id.keep_known(docs, language_id.train(docs, language_id.learn_rows()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return jaccard.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return benchmark.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: Trained models decide in two of the stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
