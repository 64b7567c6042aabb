"""Benchmark decontamination: a prefix-filtered set join of item windows with document positions.

Words are runs of characters other than `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z went to lower case. A window is `WINDOW` consecutive words of an item;
a shorter item with words is one window. The elements of a window are its word pairs (a one-word window has its word); a window lies in a
document only if all of its elements do, at the right distances. So one necessary element is enough to find candidates: the rarest in
all documents. One scan of the documents keeps the positions of those elements that any window has, with a row that tells the
document's length. Counting these positions gives the order by rarity; the positions of each window's rarest element, shifted by its
offset, are the candidate starts; starts before the first word or windows beyond the last one go; and a candidate is a
hit if every element of the window stands at its place.

A document's element positions are joined with the elements of the windows; these are sent to all executors if their counted rows
allow it, and joined by a shuffle otherwise. Null and empty texts have no words; documents without hits have no items. Repeated rows get
the same answer each. Items with null id count as an item without a name in the number of items. Empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, body, small, store, table, without

WINDOW = 13
_ASCII = [chr(i) for i in range(128)]
_SEPARATORS = "".join(c for c in _ASCII if not c.isalnum())


def words(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + _SEPARATORS, LOWER + " " * len(_SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def _pair(one: Column, two: Column) -> Column:
    return F.xxhash64(one, two)


def _single(one: Column) -> Column:
    return F.xxhash64(F.lit("single"), one)


#: Marks the position after the last word.
_LENGTH = 0


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """`win, item_id, words`: the windows of every item; win is the same for the same words."""
    listed = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - size, F.lit(0))))
    cut = listed.select("item_id", "ws", starts.alias("at")).select("item_id", F.slice("ws", F.col("at") + 1, size).alias("words"))
    joined = F.array_join("words", " ")
    return cut.select(F.concat(F.hex(F.xxhash64(joined)), F.hex(F.xxhash64(F.lit("second"), joined))).alias("win"), "item_id", "words").distinct()


def elements(listed: DataFrame) -> DataFrame:
    """`win, size, place, element` of every distinct window."""
    once = listed.groupBy("win").agg(F.first("words").alias("words"))
    single = F.size("words") == 1
    places = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0))))
    at = F.col("place")
    return once.select("win", "words", places.alias("place")).select(
        "win",
        F.size("words").alias("size"),
        "place",
        F.when(single, _single(F.col("words")[0])).otherwise(_pair(F.col("words")[at], F.col("words")[at + 1])).alias("element"),
    )


def positions(docs: DataFrame, parts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`doc_id, body, pos, element` of the given elements, and per document a row with its number of words as position."""
    # An empty word follows the last one; it has no successor itself.
    listed = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"), F.concat(words(F.col(text)), F.array(F.lit(""))).alias("ws"))
    rows = listed.select("doc_id", "body", F.posexplode(F.arrays_zip(F.col("ws").alias("one"), F.slice("ws", 2, F.size("ws")).alias("two"))).alias("pos", "w"))
    pair = F.when(F.col("w.one") == "", F.lit(_LENGTH).cast("long")).otherwise(_pair(F.col("w.one"), F.col("w.two")))
    if parts.where("size = 1").isEmpty():
        rows = rows.select("doc_id", "body", "pos", pair.alias("element"))
    else:
        rows = rows.select("doc_id", "body", "pos", F.explode(F.array(pair, _single(F.col("w.one")))).alias("element"))
    wanted = store(parts.select("element").distinct().union(docs.sparkSession.range(1).select(F.lit(_LENGTH).cast("long"))), "decon-elements")
    return rows.join(small(wanted), "element", "left_semi")


def find_windows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", size: int = WINDOW):
    """Stored frames: `doc_id, body, n_words` of every document, `doc_id, body, start, size, win` of every hit, and the windows."""
    listed = store(windows(items, item_id, "text", size), "decon-windows")
    parts = store(elements(listed), "decon-parts")
    found = store(positions(docs, parts, doc_id, text), "decon-positions")
    lengths = found.where(F.col("element") == _LENGTH).select("doc_id", "body", F.col("pos").alias("n_words")).distinct()
    found = found.where(F.col("element") != _LENGTH).distinct()  # repeated rows say the same
    # Windows of which an element occurs nowhere cannot occur.
    rarity = found.groupBy("element").agg(F.count(F.lit(1)).alias("times"))
    ranked = parts.join(rarity, "element", "left")
    prefix = (
        ranked.groupBy("win", "size")
        .agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "element", "place")).alias("rarest"))
        .where("rarest.times > 0")
        .select("win", "size", "rarest.element", "rarest.place")
    )
    prefix = small(store(prefix, "decon-prefix"))
    candidates = (
        found.join(prefix, "element")
        .select("doc_id", "body", "win", "size", (F.col("pos") - F.col("place")).alias("start"))
        .join(lengths.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "n_words"), _same_document())
        .where("start >= 0 AND start + size <= n_words")
        .drop("_id", "_body", "n_words")
    )
    candidates = store(candidates, "decon-candidates")
    steps = candidates.join(small(parts.select("win", "place", "element")), "win").withColumn("pos", F.col("start") + F.col("place"))
    there = found.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "pos", "element")
    hits = (
        steps.join(there, [steps["pos"] == there["pos"], steps["element"] == there["element"], *_same_document()])
        .groupBy("doc_id", "body", "win", "size", "start")
        .count()
        .where(F.col("count") == F.greatest(F.col("size") - 1, F.lit(1)))
        .drop("count")
    )
    return lengths, store(hits, "decon-hits"), listed


def _same_document() -> list[Column]:
    return [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("body") == F.col("_body")]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """`doc_id, body, n_words, n_hit, items` of every row; items is the sorted list of the items with windows in the text."""
    lengths, hits, listed = find_windows(docs, items, doc_id, text, item_id, size)
    covered = (
        hits.select("doc_id", "body", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
        .distinct()
        .groupBy("doc_id", "body")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        hits.select("doc_id", "body", "win")
        .distinct()
        .join(small(listed.select("win", "item_id")), "win")
        .groupBy("doc_id", "body")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    both = covered.join(named.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "items"), _same_document()).drop("_id", "_body")
    both = store(both, "decon-covered").select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "n_hit", "items")
    # One row per row of docs, also where rows repeat an id and a text.
    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"))
    counted = lengths.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "n_words")
    every = rows.join(counted, _same_document()).drop("_id", "_body")
    return every.join(both, _same_document(), "left").select(
        "doc_id",
        "body",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs of which less than a twentieth of the words is hit."""
    found = contamination(docs, items, doc_id, text, item_id).where(is_contaminated())
    return without(docs, store(found.select("doc_id", "body").distinct(), "decon-dropped"), doc_id, text)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


QUERIES = {"op4_decontamination": op4_decontamination}

ORACLES = {
    "op4_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n FROM s),
sizes AS (SELECT DISTINCT n FROM x),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM p),
h AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM g JOIN x ON g.win = x.win AND g.n = x.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
