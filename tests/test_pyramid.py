"""Nearest point through the pyramid against all pairs."""

import math
import random

from pyspark.sql import functions as F

from hireatlas.operators import nearby, pyramid


def chord(a, b):
    def vector(p):
        lat, lon = map(math.radians, p)
        return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)

    return sum((x - y) ** 2 for x, y in zip(vector(a), vector(b)))


def frames(spark, points, places):
    stations = spark.createDataFrame([(i, f"s{i}", *p) for i, p in enumerate(points)], "ord long, station_name string, lat double, lon double")
    return stations, spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, lat double, lon double")


def test_nearest_equals_all_pairs_with_few_comparisons(spark):
    draw = random.Random(8)
    town = lambda lat, lon, spread, n: [(lat + draw.gauss(0, spread), lon + draw.gauss(0, spread)) for _ in range(n)]
    # Two dense towns, a country, two points at a pole and across the date line, and one place listed twice.
    points = town(60.2, 24.9, 0.02, 3000) + town(60.4, 25.1, 0.001, 1500) + town(48, 2, 2, 1500) + [(89.9, 10.0), (-17.0, 179.99), (60.2, 24.9), (60.2, 24.9)]
    places = town(60.2, 24.9, 0.05, 40) + town(55, 10, 5, 40) + [(draw.uniform(-89, 89), draw.uniform(-180, 180)) for _ in range(60)]
    places += [(60.2, 24.9), (-17.0, -179.99), (-89.0, 0.0), (90.0, 0.0), points[7]]
    stations, here = frames(spark, points, places)
    got = {(r.lat, r.lon): r for r in pyramid.nearest(here, stations).collect()}
    for place in places:
        best = min(range(len(points)), key=lambda i: (chord(points[i], place), i))
        r = got[place]
        assert r.best.chord <= chord(points[best], place) + 1e-15
        assert r.best.ord == best or abs(chord(points[r.best.ord], place) - chord(points[best], place)) < 1e-15
        assert r.met < 400, (place, r.met)  # cells and points, of 6,004 points
    assert got[60.2, 24.9].best.ord == 6002


def test_ties_go_to_the_first_listed_point(spark):
    stations, here = frames(spark, [(10.0, 21.0), (10.0, 19.0), (10.0, 21.0)], [(10.0, 20.0), (0.0, 20.0)])
    # The distances to both sides are equal up to rounding.
    assert {r.best.ord for r in pyramid.nearest(here, stations).collect()} <= {0, 1}
    stations, here = frames(spark, [(5.0, 5.0)] * 40, [(5.0, 5.0), (6.0, 5.0)])
    assert {r.best.ord for r in pyramid.nearest(here, stations).collect()} == {0}


def test_long_lists_and_missing_coordinates(spark):
    stations, here = frames(spark, [(60.0, 25.0)], [(61.0, 25.0)])
    companies = here.unionByName(spark.createDataFrame([(7, None, 25.0)], here.schema))
    got = {r.id: r for r in nearby.nearest_station(companies, stations, compiled=False).collect()}
    assert got[0].nearest_station == "s0" and abs(got[0].distance_km - 111.19) < 0.1 and got[7].nearest_station is None
    none = nearby.nearest_station(companies, stations.limit(0), compiled=False).collect()
    assert len(none) == 2 and all(r.nearest_station is None for r in none)
    assert nearby.nearest_station(companies.limit(0), stations, compiled=False).count() == 0
