"""Lines that many documents share, found by sorting hashes and dropped through per-document bitmaps.

A text is split at \\n; a null or empty text is one empty line. The key of a line is the line without `[\\x20\\x09-\\x0D]` at both
ends and with A-Z in lower case. Empty keys are never counted and never dropped. Line hashes are range-partitioned with a
sub-key made from the document, so that a key held by a third of all documents is spread over `SPLITS` ranges, and sorted by
document and position; the first occurrence of a key in a document is the one whose predecessor belongs to another document. Only
these are counted. What comes back to the texts is no text but, per document, the 64-bit words of a keep bitmap in which some
line is dropped (bit set: the line stays); words that are not listed keep all of their lines.

Rows with the same id and different texts are different documents; rows that repeat both are one. A null id is an id of its own.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, small, store, table

MIN_CHARS, MIN_DOCS = 1, 10
#: Sub-keys per line hash.
SPLITS = 64


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """`doc_id, body, pos, h1, h2`: one row per line with a key; body tells apart texts that share an id."""
    whole = _text(text)
    lines = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("body"), F.posexplode(F.split(whole, "\n")).alias("pos", "line")
    )
    key = F.col("key")
    return (
        lines.select("doc_id", "body", "pos", ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key"))
        .where(F.length(key) >= min_chars)
        .select("doc_id", "body", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))
    )


def shared_keys(lines: DataFrame, min_docs: int = MIN_DOCS, splits: int = SPLITS) -> DataFrame:
    """`h1, h2` of the keys found in at least min_docs documents."""
    # A range partitioning over exactly the window's keys needs no second exchange.
    spread = lines.withColumn("part", F.pmod("body", F.lit(splits))).repartitionByRange("h1", "h2", "part")
    order = Window.partitionBy("h1", "h2", "part").orderBy("doc_id", "body", "pos")
    document = F.struct("doc_id", "body")
    first = ~F.lag(document).over(order).eqNullSafe(document)
    return (
        spread.select("h1", "h2", first.alias("first"))
        .where("first")
        .groupBy("h1", "h2")
        .count()
        .where(F.col("count") >= min_docs)
        .select("h1", "h2")
    )


def keep_bitmaps(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    splits: int = SPLITS,
) -> DataFrame:
    """`doc_id, body, n_dropped, keep` for documents that lose lines; keep maps a word number to its bits."""
    lines = store(line_hashes(docs, doc_id, text, min_chars), "line-hashes")
    # Stored, so that the join with a key that a third of all documents share can be dealt out anew, or needs no shuffle at all.
    keys = small(store(shared_keys(lines, min_docs, splits), "line-keys"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))
    words = (
        lines.join(keys, ["h1", "h2"], "left_semi")
        .groupBy("doc_id", "body", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(bit).alias("drop"))
    )
    return words.groupBy("doc_id", "body").agg(
        F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("drop")))).alias("keep"),
    )


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`doc_id, n_lines, n_dropped, kept_text` for every row of docs."""
    maps = keep_bitmaps(docs, doc_id, text, **options).select(
        F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "n_dropped", "keep"
    )
    whole = docs.select(F.col(doc_id).alias("doc_id"), _text(text).alias("whole"))
    joined = whole.join(maps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("whole") == F.col("_body")), "left")
    stays = lambda line, i: F.coalesce(F.getbit(F.col("keep")[F.shiftright(i, 6)], i.bitwiseAND(63)), F.lit(1)) == 1
    kept = F.when(F.col("keep").isNull(), F.col("whole")).otherwise(
        F.array_join(F.filter(F.split("whole", "\n"), stays), "\n")
    )
    return joined.select(
        "doc_id",
        F.size(F.split("whole", "\n")).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        kept.alias("kept_text"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}

ORACLES = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (
  SELECT doc_id, line, p,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
}
