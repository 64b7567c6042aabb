"""Exact duplicates through a two-pass Bloom filter: only rows whose hash may repeat are shuffled.

Texts are equal when they are identical after all `[\\x20\\x09-\\x0D]` are deleted. Of equal texts the longest original stays,
then the smallest id (a null id last). A null text counts as empty, so all null, empty and blank texts are one group. A row that
repeats an id and a text counts as one more copy. An empty table gives an empty result. Columns other than the id and the text are
not read by the report.

Pass 1 sets two bits per row in 64-bit words and keeps the bits that two rows have set. Pass 2 tests each row against these words:
a row with an unshared bit has a text of its own and passes straight through. The filter has `BITS_PER_ROW` bits per row. It is sent
to all executors when its counted words allow that, and joined by word number otherwise; either way the groups are exact, because
candidates are compared by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, body, same_row, small, store, table, without

BITS_PER_ROW = 16


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        body(text).alias("body"),
        F.length(whole).cast("long").alias("length"),
        F.unhex(F.sha2(F.translate(whole, SPACES, ""), 256)).alias("sha"),
    )


def _with_bits(prints: DataFrame, words: int) -> DataFrame:
    """Word number and the two bits of each row, from the 64-bit hash of its digest."""
    value = F.xxhash64("sha")
    return prints.select(
        "*",
        F.pmod(F.shiftright(value, 12), F.lit(words)).alias("word"),
        F.array((value.bitwiseAND(63)).cast("int"), (F.shiftright(value, 6).bitwiseAND(63)).cast("int")).alias("bits"),
    )


def _bit(position):
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def repeated_bits(prints: DataFrame, words: int) -> DataFrame:
    """Pass 1: `word, mask` with the bits that at least two rows have set."""
    return (
        _with_bits(prints, words)
        .select("word", F.explode(F.array_distinct("bits")).alias("bit"))
        .groupBy("word", "bit")
        .count()
        .where("count > 1")
        .groupBy("word")
        .agg(F.bit_or(_bit(F.col("bit"))).alias("mask"))
    )


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, body, keep_id, group_size, kept, text_sha256` for every row."""
    prints = store(fingerprints(docs, doc_id, text), "exact-prints")
    words = max(64, prints.count() * BITS_PER_ROW // 64)
    repeated = store(repeated_bits(prints, words), "exact-bits")
    probed = (
        _with_bits(prints, words)
        .join(small(repeated), "word", "left")
        .select(
            "doc_id",
            "body",
            "length",
            "sha",
            F.coalesce(
                (F.getbit("mask", F.col("bits")[0]) == 1) & (F.getbit("mask", F.col("bits")[1]) == 1), F.lit(False)
            ).alias("maybe"),
        )
    )
    maybe = probed.where("maybe").select("doc_id", "body", "length", "sha")
    alone = probed.where("NOT maybe").select("doc_id", "body", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    # Counted and reduced before the shuffle, so that a group of any size sends one row per task.
    groups = store(maybe.groupBy("sha").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("without"), F.col("doc_id"))).alias("best"),
    ), "exact-groups")
    # Stored, so that the join with the rows of a large group can be dealt out anew, or needs no shuffle at all.
    grouped = maybe.join(small(groups), "sha").select("doc_id", "body", "sha", F.col("best.doc_id").alias("keep_id"), "group_size")
    return grouped.unionByName(alone).select(
        "doc_id",
        "body",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of `docs`. Of rows that repeat an id and a text, one stays."""
    report = store(exact_duplicates(docs, doc_id, text), "exact-report")
    rest = without(docs, store(report.where("NOT kept").select("doc_id", "body"), "exact-dropped"), doc_id, text)
    again = report.where("kept AND group_size > 1").groupBy("doc_id", "body").count().where("count > 1").select("doc_id", "body")
    again = store(again, "exact-again")
    if again.isEmpty():
        return rest
    twice = small(again)
    same = same_row(rest, twice, doc_id, text)
    return rest.join(twice, same, "left_anti").unionByName(rest.join(twice, same, "left_semi").dropDuplicates([doc_id, text]))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("body")


QUERIES = {"op9_exact_dedup": op9_exact_dedup}

ORACLES = {
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, s AS text_sha256
FROM d WINDOW g AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""
}
