"""Exact medians per group that never gather a whole group in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from hireatlas.session import materialize

_ACCURACY = 10_000
# The sketch is off by about 1 / _ACCURACY of the ranks on either side. A group whose median lies outside the bracket is
# counted again with a wider one; the last holds every value.
_MARGINS = (3.0 / _ACCURACY, 100.0 / _ACCURACY, 0.5)


def grouped_median(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """One row per key with the interpolated median of each value column (``{output: input}``).

    A mergeable sketch first brackets the middle of every group. Rows below the bracket are only counted, and values inside it are
    counted per distinct value, so what is shuffled and sorted is a small share of the group. The rows are read once for the
    sketches and once for the counts, and never written in another form: hand in stored, narrow rows. Nulls and NaN are skipped; a group
    without values gives null.
    """
    names = list(values)
    numbers = [F.col(values[n]).cast("double") for n in names]
    rows = df.select(*keys, *(F.when(~F.isnan(v), v).alias(f"_v{i}") for i, v in enumerate(numbers)))
    found, open_ = [], None
    for margin in _MARGINS:
        medians = materialize(_bracketed(rows, keys, len(names), margin, open_), "medians")
        found.append(medians.where("_m IS NOT NULL"))
        missed = medians.where("_m IS NULL").drop("_m")
        if missed.isEmpty():
            break
        open_ = missed
    return reduce(DataFrame.unionByName, found).groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_m"))).alias(n) for i, n in enumerate(names)])


def _bracketed(rows: DataFrame, keys: list[str], columns: int, margin: float, only: DataFrame | None) -> DataFrame:
    """``keys, _i, _m``: the median of column ``_v<i>`` per key, null where it lies outside the sketched bracket.

    ``only`` (``keys, _i``) says which medians are still looked for.
    """
    if only is not None:
        rows = rows.join(only.select(*keys).distinct(), keys, "left_semi")
    sketches = rows.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(F.count(f"_v{i}").alias("n"), F.percentile_approx(f"_v{i}", [0.5 - margin, 0.5 + margin], _ACCURACY).alias("p"))
                for i in range(columns)
            ]
        ).alias("_s")
    )
    sketches = materialize(sketches, "median-brackets")
    bracketed = rows.join(sketches, keys)
    # All values below a bracket fall into one null entry, which only carries their count; those above it leave the row here.
    entries = [
        F.when(
            F.col(f"_v{i}") <= F.col("_s")[i]["p"][1],
            F.struct(F.lit(i).alias("i"), F.col("_s")[i]["n"].alias("n"), F.when(F.col(f"_v{i}") >= F.col("_s")[i]["p"][0], F.col(f"_v{i}")).alias("x")),
        )
        for i in range(columns)
    ]
    inside = bracketed.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("_e"))
    counted = inside.groupBy(*keys, F.col("_e.i").alias("_i"), F.col("_e.n").alias("_n"), F.col("_e.x").alias("_x")).agg(F.count("*").alias("_c"))
    if only is not None:
        counted = counted.join(only, [*keys, "_i"], "left_semi")
    group = [*keys, "_i"]
    running = Window.partitionBy(*group).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_c").over(running))
    low_rank, high_rank = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1

    def at(rank):
        held = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
        return F.max(F.when(held, F.col("_x")))

    return ranked.groupBy(*group).agg(((at(low_rank) + at(high_rank)) / 2).alias("_m"))
