"""From raw documents to a training mix, in five stages.

Every stage takes the documents that the one before has kept, and all but the
last return the columns of ``documents``.  Rejected ids are removed by an
anti-join on the id, which is spread evenly whatever the sources are.

Defined results: a row whose id is null cannot be named by a verdict, so no
stage removes or cuts it; rows that repeat an id go, stay and are cut together;
null and empty texts are judged by the quality classifier like any other, and
share nothing; texts of any length are worked on whole; ties (copies) leave the
smallest id; an empty table gives an empty result; columns beyond those of
``documents`` are handed on by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontamination, minhash, mixing, quality_bayes, substring_dedup
from terrane.workspace import Workspace, opened, release


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    verdict = quality_bayes.judge(docs, _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return _without(docs, verdict.filter(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    groups = minhash.near_duplicates(docs)
    return _without(docs, groups.filter(~F.col("kept")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out of the texts."""
    return substring_dedup.cut_texts(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontamination.contaminated(docs, _table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("mixing", mix),
]

#: No stage but the last is SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    before = opened()
    ws = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = ws.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        release(ws, *before)  # the stage's own tables
        if i:
            ws.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
