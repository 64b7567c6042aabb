"""Nearest-station and radius joins without a cross join."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas.functions.geo import cell, haversine_km, unit_vector
from hireatlas.operators.once import compute_once
from hireatlas.operators.pyramid import nearest

# The longest station list that may be compiled into a plan.
COMPILED_STATIONS = 10_000
#: Distances to a list of so many stations are written out one by one.
WRITTEN_OUT = 100


def nearest_station(companies: DataFrame, stations: DataFrame, compiled: bool = True) -> DataFrame:
    """Add ``nearest_station`` and ``distance_km``; the first listed station wins ties.

    ``stations`` has ``ord, station_name, lat, lon``. With ``compiled`` the list becomes a literal of the plan, and the join one
    map-only pass; a list of more than COMPILED_STATIONS entries is refused. Without it, distinct company locations search a pyramid of
    cells over the stations. Both rank by the straight-line distance between points of the sphere.
    """
    usable = stations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if not compiled:
        return _nearest_by_cells(companies, usable)
    listed = usable.select("ord", "station_name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).limit(COMPILED_STATIONS + 1).collect()
    if len(listed) > COMPILED_STATIONS:
        raise ValueError(f"more than {COMPILED_STATIONS} stations: use compiled=False")
    near = F.col("_near")
    km = haversine_km(near["lat"], near["lon"], F.col("lat"), F.col("lon"))
    # The position of a company is worked out once, not once per station.
    placed = companies.withColumns(dict(zip(["_x", "_y", "_z"], unit_vector(F.col("lat"), F.col("lon")))))
    points, chords = _listed(listed)
    measured = compute_once(placed, {"_chords": chords})
    first_least = F.array_position("_chords", F.array_min("_chords")).cast("int")
    found = compute_once(measured, {"_near": F.try_element_at(points, first_least)})
    return compute_once(found, {"nearest_station": near["station_name"], "distance_km": km}).drop("_near", "_chords", "_x", "_y", "_z")


_POINTS = "array<struct<x:double,y:double,z:double,station_name:string,lat:double,lon:double>>"


def _listed(stations) -> tuple[Column, Column]:
    """A literal station list, and the squares of the straight lines from a company to its entries, null without a location.

    These are plain numbers in the order of the list, so the first least one is that of the first listed station. Those of a short
    list are written out one by one, which Spark compiles; a function over a long list is called entry by entry.
    """
    rows = []
    for s in sorted(stations, key=lambda s: [(v is not None, v) for v in (s["ord"], s["station_name"], s["lat"], s["lon"])]):
        lat, lon = math.radians(s["lat"]), math.radians(s["lon"])
        rows.append(
            {
                "x": math.cos(lat) * math.cos(lon), "y": math.cos(lat) * math.sin(lon), "z": math.sin(lat),
                "station_name": s["station_name"], "lat": s["lat"], "lon": s["lon"],
            }
        )
    points = F.from_json(F.lit(json.dumps(rows)), _POINTS)

    def chord(x: Column, y: Column, z: Column) -> Column:
        dx, dy, dz = x - F.col("_x"), y - F.col("_y"), z - F.col("_z")
        return dx * dx + dy * dy + dz * dz

    if 0 < len(rows) <= WRITTEN_OUT:
        chords = F.array(*[chord(F.lit(r["x"]), F.lit(r["y"]), F.lit(r["z"])) for r in rows])
    else:
        chords = F.transform(points, lambda p: chord(p["x"], p["y"], p["z"]))
    return points, F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), chords)


def _cells(stations: DataFrame, size_km: float) -> DataFrame:
    """Every station in each cube from which it can be within ``size_km``: its own and the 26 around."""
    rows = stations.select(
        "ord", "station_name", F.col("lat").alias("slat"), F.col("lon").alias("slon"), cell(F.col("lat"), F.col("lon"), size_km).alias("c")
    )
    for axis in ("x", "y", "z"):
        around = F.explode(F.sequence(F.col(f"c.{axis}") - 1, F.col(f"c.{axis}") + 1))
        rows = rows.withColumn(f"c{axis}", around)
    return rows.drop("c")


def _nearest_by_cells(companies: DataFrame, stations: DataFrame) -> DataFrame:
    """Nearest station over distinct locations, through a pyramid of cells."""
    located = companies.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    out = companies.join(nearest(located, stations), ["lat", "lon"], "left")
    return out.withColumns({"nearest_station": F.col("best.station_name"), "distance_km": F.col("best.km")}).select(
        *companies.columns, "nearest_station", "distance_km"
    )


def radius_join(companies: DataFrame, stations: DataFrame, radius_km: float, key: str = "business_id") -> DataFrame:
    """All company-station pairs within the radius: equal cells first, then the exact distance."""
    home = cell(F.col("lat"), F.col("lon"), radius_km)
    located = companies.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    keyed = located.select(key, "lat", "lon", home["x"].alias("cx"), home["y"].alias("cy"), home["z"].alias("cz"))
    km = haversine_km(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon"))
    return (
        keyed.join(_cells(stations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), radius_km), ["cx", "cy", "cz"])
        .withColumn("distance_km", km)
        .where(F.col("distance_km") <= radius_km)
        .select(key, "station_name", "distance_km")
    )
