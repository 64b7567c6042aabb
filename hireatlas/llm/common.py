"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Task functions travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: `[\x20\x09-\x0D]`, as a set of characters.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a narrow table (ids, hashes, counters: at most a few dozen bytes each) that may be sent to every executor.
BROADCAST_ROWS = 2_000_000


#: Bytes of texts that go to a Python worker at once; a task holds a few such batches beside its heap.
ARROW_BATCH = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame into the shared folder and read it back, which cuts its lineage."""
    return materialize(df, purpose)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; no other character changes."""
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored narrow table for broadcast if its counted rows allow it; otherwise it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def body(text: str) -> Column:
    """Tells apart the texts of rows that share an id; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def same_row(docs: DataFrame, marks: DataFrame, doc_id: str, text: str) -> Column:
    """Whether a row of docs has the `doc_id, body` of a row of marks; other columns of docs may have any names."""
    return docs[doc_id].eqNullSafe(marks["doc_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == marks["body"])


def without(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id and text are not among the stored `doc_id, body`."""
    gone = small(dropped.select("doc_id", "body"))
    return docs.join(gone, same_row(docs, gone, doc_id, text), "left_anti")


def crc_mod(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % by


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """docs with a 0/1 column `label`; of repeated label rows of an id the highest value counts, null labels are left out."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("label"))
    return docs.join(small(store(marks, "labels")), doc_id)


def fit_rows(rows: DataFrame, doc_id: str, limit: int) -> DataFrame:
    """About `limit` of the stored labelled rows, chosen by a hash of the id; all of them if there are no more."""
    count = rows.count()
    if count <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(doc_id, F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * limit / count))
