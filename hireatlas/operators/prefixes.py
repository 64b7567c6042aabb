"""Prefix rules looked up in sorted order: no array of rules, no pair of a rule and a target that do not belong together.

In the order of bytes everything between a prefix and a text that begins with it begins with it too. So the last rule at or before a text is
either a prefix of the text, or shares with it every prefix rule the text has: they all lie on that rule's own path of shorter
rules (a path in a trie). Rules and texts are dealt out by ranges, each text takes the path of the last rule before it, and only the
last rule of a range crosses its border. A host with a third of all texts or rules is cut into ranges like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hireatlas.session import materialize


def paths(rules: DataFrame) -> DataFrame:
    """``host, prefix, path`` from ``host, prefix, ord, allow``: the rules of a host that are prefixes of a rule, shortest first.

    Each entry ``length, first<ord, allow, empty>`` holds the first listed rule among those up to its length. Rules are only looked
    up at lengths that occur on their host.
    """
    nodes = rules.groupBy("host", "prefix").agg(F.min(F.struct("ord", "allow")).alias("r"))
    nodes = nodes.select("host", "prefix", F.struct("r.ord", "r.allow", (F.col("prefix") == "").alias("empty")).alias("first"))
    lengths = nodes.groupBy("host").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))  # at most the longest address
    shorter = nodes.join(lengths, "host").select(
        "host", "prefix", F.explode(F.filter("lengths", lambda n: n <= F.length("prefix"))).alias("length")
    )
    on_path = shorter.withColumn("own", F.expr("left(prefix, length)")).join(
        nodes.select("host", F.col("prefix").alias("own"), "first"), ["host", "own"]
    )
    listed = on_path.groupBy("host", "prefix").agg(F.array_sort(F.collect_list(F.struct("length", "first"))).alias("path"))
    best = F.transform(
        "path", lambda e, i: F.struct(e["length"].alias("length"), F.array_min(F.transform(F.slice("path", 1, i + 1), lambda p: p["first"])).alias("first"))
    )
    return listed.select("host", "prefix", best.alias("path"))


def first_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, text, first`` of distinct ``host, text``: the first listed rule that the text begins with, null without one."""
    rule = F.struct("host", "prefix", "path")
    known = paths(rules).select("host", F.col("prefix").alias("text"), F.lit(0).alias("kind"), rule.alias("rule"))
    asked = texts.select("host", "text", F.lit(1).alias("kind"), F.lit(None).cast(known.schema["rule"].dataType).alias("rule"))
    order = ["host", "text", "kind"]
    dealt = materialize(known.unionByName(asked).repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "prefix-ranges")
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumn("_last", F.last("rule", ignorenulls=True).over(inside)).where("kind = 1")
    # The last rule of every range, and the one before each range: one row per range.
    ends = dealt.groupBy("_b").agg(F.max_by("rule", F.when(F.col("rule").isNotNull(), F.struct("host", "text"))).alias("_end"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_b", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    rows = rows.join(ends, "_b").withColumn("_rule", F.coalesce("_last", "_before"))
    begins = F.filter("_rule.path", lambda e: F.startswith(F.col("text"), F.left(F.col("_rule.prefix"), e["length"])))
    found = F.when(F.col("_rule.host") == F.col("host"), F.try_element_at(begins, F.lit(-1))["first"])
    return rows.select("host", "text", found.alias("first"))
