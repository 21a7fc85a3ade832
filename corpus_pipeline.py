"""From raw documents to a training mix: quality, repeated lines, near-duplicates, benchmark passages, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last one adds what the
mix takes. ``run`` writes every stage's result to the work folder and reads it again, so that a lost executor or a failed
stage costs that stage only. Labels and benchmark items come from the tables beside documents.

The stages keep what they do not reject: quality drops documents whose predicted label is 0; line dedup cuts later
copies of line runs and keeps every document; near-dedup keeps the smallest id of each group; decontamination drops
documents with a benchmark window; the mix drops documents of which it takes no word (empty ones included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import decontaminate, line_runs, mixing, near_duplicates, quality_classifier
from tidegauge.llm.common import stored, table

#: The classifier's learned weights can't be computed in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_runs.remove_runs(docs).drop("__deleted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_free),
    ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, stage by stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
