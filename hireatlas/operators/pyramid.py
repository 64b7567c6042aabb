"""Nearest of many points through a pyramid of cells, for lists of any length.

Space is the cube around the unit sphere; a cell of depth d has an edge of 2 / 2^d. Every cell that holds points knows how many, and one of
them, its representative. A location first measures the representative of the deepest cell it lies in: no point farther than that matters.
From the cells of that size around it, it goes down cell by cell, drops those whose nearest corner or face is farther than the best
representative seen, and stops at cells of few points, whose points it measures. So a location far from everything meets a few cells a
level, never all points, and one in a crowd meets the few points of its small cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hireatlas.functions.geo import haversine_km, unit_vector
from hireatlas.session import materialize

#: A cell of depth 22 has an edge of about 3 m.
MAX_DEPTH = 22
#: Cells of so many points are not divided further.
FEW = 16
AXES = ("x", "y", "z")
CELL = ["depth", "cx", "cy", "cz"]


def _place(value: Column, depth: Column) -> Column:
    """Number of the cell along an axis."""
    cells = F.pow(F.lit(2.0), depth)
    return F.least(F.floor((value + 1) / 2 * cells), cells - 1).cast("long")


def _chord2(there: Column) -> Column:
    """Square of the straight line from the location to a point."""
    return sum(((F.col(a) - there[a]) * (F.col(a) - there[a]) for a in AXES), F.lit(0.0))


def _gap2() -> Column:
    """Square of the straight line from the location to the nearest point of the cell."""
    edge = F.lit(2.0) / F.pow(F.lit(2.0), F.col("depth"))

    def gap(axis: str) -> Column:
        low = F.col(f"c{axis}") * edge - 1
        return F.greatest(low - F.col(axis), F.col(axis) - (low + edge), F.lit(0.0))

    return sum((gap(a) * gap(a) for a in AXES), F.lit(0.0))


def build(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with count and representative, and the points of each cell, from ``ord, station_name, lat, lon``.

    Of points in one place the first listed one stands for all.
    """
    first = points.groupBy("lat", "lon").agg(F.min(F.struct(F.col("ord").cast("long").alias("ord"), "station_name")).alias("s"))
    vector = unit_vector(F.col("lat"), F.col("lon"))
    at = first.select("s.ord", "s.station_name", F.struct(*(v.alias(a) for v, a in zip(vector, AXES)), F.col("lat"), F.col("lon")).alias("point"))
    levels = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
    members = materialize(levels.withColumns({f"c{a}": _place(F.col(f"point.{a}"), F.col("depth")) for a in AXES}), "pyramid-members")
    cells = members.groupBy(*CELL).agg(F.count("*").alias("n"), F.min_by("point", "ord").alias("seen"))
    return materialize(cells, "pyramid-cells"), members


def nearest(locations: DataFrame, points: DataFrame) -> DataFrame:
    """``lat, lon, best<chord, ord, station_name, km>, met`` of distinct locations; ``met`` counts the cells and points compared."""
    cells, members = build(points)
    here = locations.select("lat", "lon").distinct().withColumns(dict(zip(AXES, unit_vector(F.col("lat"), F.col("lon")))))
    own = ["lat", "lon", *AXES]
    levels = here.select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
    inside = levels.withColumns({f"c{a}": _place(F.col(a), F.col("depth")) for a in AXES}).join(cells, CELL)
    deepest = inside.groupBy(*own).agg(F.max_by("seen", "depth").alias("seen")).withColumn("within", _chord2(F.col("seen")))
    # Cells at least as large as that distance: the ball around the location lies in the 27 around its own.
    depth = F.when(F.col("within") > 0, F.floor(F.log2(F.lit(2.0) / F.sqrt("within")))).otherwise(MAX_DEPTH)
    start = deepest.withColumn("depth", F.greatest(F.lit(0), F.least(depth, F.lit(MAX_DEPTH))).cast("int"))
    around = start.select(*own, "within", "depth")
    for axis in AXES:
        middle = _place(F.col(axis), F.col("depth"))
        around = around.withColumn(f"c{axis}", F.explode(F.sequence(middle - 1, middle + 1)))

    slack = F.col("within") * F.lit(1 + 1e-9) + F.lit(1e-18)  # rounding must not drop an equal one
    rounds = []
    while True:
        met = around.join(cells, CELL).withColumn("gap", _gap2())
        per_location = Window.partitionBy("lat", "lon")  # a few cells each
        met = met.withColumn("within", F.least("within", F.min(_chord2(F.col("seen"))).over(per_location)))
        met = met.withColumn("met", F.count("*").over(per_location)).where(F.col("gap") <= slack)
        leaf = (F.col("n") <= FEW) | (F.col("depth") >= MAX_DEPTH)
        met = materialize(met.withColumn("leaf", leaf).drop("seen"), "pyramid-round")
        rounds.append(met)
        inner = met.where("NOT leaf")
        if inner.isEmpty():
            break
        around = inner.select(*own, "within", (F.col("depth") + 1).alias("depth"), *(F.col(f"c{a}") * 2 for a in AXES))
        around = around.toDF(*own, "within", *CELL)
        for axis in AXES:
            around = around.withColumn(f"c{axis}", F.explode(F.array(F.col(f"c{axis}"), F.col(f"c{axis}") + 1)))

    seen = [r.withColumn("round", F.lit(i)) for i, r in enumerate(rounds)]
    every = reduce(DataFrame.unionByName, seen)
    limits = every.groupBy("lat", "lon", "round").agg(F.min("within").alias("within"), F.max("met").alias("met"))
    limits = limits.groupBy("lat", "lon").agg(F.min("within").alias("within"), F.sum("met").alias("cells"))
    leaves = every.where("leaf").drop("within", "met", "round").join(limits, ["lat", "lon"]).where(F.col("gap") <= slack)
    measured = leaves.join(members, CELL).withColumn("chord", _chord2(F.col("point")))
    km = haversine_km(F.col("point.lat"), F.col("point.lon"), F.col("lat"), F.col("lon"))
    best = F.min(F.struct("chord", "ord", "station_name", km.alias("km")))
    return measured.groupBy("lat", "lon").agg(best.alias("best"), (F.max("cells") + F.count("*")).alias("met"))
