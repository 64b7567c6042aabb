"""From raw documents to a training mix: five stages, each working on what the one before it kept.

A stage takes the session, its input documents and the folder of the other tables, and returns the rows that stay, with the columns of its
input; the last one adds a `rate`. Stages are written as Parquet and read again, so a lost executor costs at most one stage.

Null, empty and blank texts are equal, so one of them (the longest, then the smallest id) stays; it is never toxic unless most such
labelled texts are, never a near copy and never contaminated. Of rows that repeat an id and a text one stays; rows that share an id only
are judged each by its own text. A row without an id is judged like any other and comes last among equals. Without labels no document is
toxic and every rate is 1; without benchmark items none is contaminated. Empty tables give an empty result. Further columns of
documents, whatever their names, are passed through; one that is called `rate` is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hireatlas.llm import decontamination, exact_dedup, mixing, near_dedup, toxicity
from hireatlas.llm.common import store, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn toxicity from the labelled rows and drop documents that score 0.3 or more."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group linked by a similarity of 0.75 or more over five-word shingles, the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words lies in windows of benchmark items."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document the rate at which the expected domain shares meet the targets."""
    return mixing.mixed(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", copies_out),
    ("near dedup", near_copies_out),
    ("decontamination", benchmark_out),
    ("mixing", mix),
]

#: Classifiers, links over signatures and the rates have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
