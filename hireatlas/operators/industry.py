"""Longest-prefix classification of industry codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def classify(code: Column, groups: dict[str, list[str]], default: str = "other") -> Column:
    """Group of the longest matching prefix, compiled into one CASE; the first listed group wins ties."""
    entries = []
    for position, (group, prefixes) in enumerate(groups.items()):
        for prefix in prefixes:
            clean = "".join(ch for ch in str(prefix) if ch.isdigit())
            if clean:
                entries.append((-len(clean), position, clean, group))
    norm = digits(code)
    out = None
    for _, _, prefix, group in sorted(entries):
        hit = F.startswith(norm, F.lit(prefix))
        out = F.when(hit, F.lit(group)) if out is None else out.when(hit, F.lit(group))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def classify_by_table(df: DataFrame, code: str, prefixes: DataFrame, default: str = "other") -> DataFrame:
    """The same for a rule table of any size: equi-joins on the distinct codes, one per prefix length.

    ``prefixes`` has ``group, ord, prefix``. Only the distinct codes meet the rules; the rows then
    look their group up by code.
    """
    rule = prefixes.select("group", "ord", digits(F.col("prefix")).alias("prefix")).where("prefix <> ''")
    rule = rule.groupBy("prefix").agg(F.min_by("group", "ord").alias("group"))
    codes = df.select(digits(F.col(code)).alias("_code")).where("_code <> ''").distinct()
    lengths = F.sequence(F.lit(1), F.length("_code"))
    pieces = codes.select("_code", F.explode(F.transform(lengths, lambda n: F.left("_code", n))).alias("prefix"))
    best = pieces.join(rule, "prefix").groupBy("_code").agg(F.max_by("group", F.length("prefix")).alias("_group"))
    return (
        df.withColumn("_code", digits(F.col(code)))
        .join(best, "_code", "left")
        .withColumn("industry", F.coalesce("_group", F.lit(default)))
        .drop("_code", "_group")
    )
