import math

import pytest
from pyspark.sql import functions as F

from roadspark.functions import geo, roads
from roadspark.operators import paths


def test_cells(spark):
    rows = spark.createDataFrame([(51.5, -0.1, "5221365216029179904"), (35.6, 139.7, "6924438358710026240"), (40.7128, -74.006, "9926597683747749888"), (-23.5505, -46.6333, "10722608917885485056")], "lat double, lng double, want string")
    assert all(r.got == r.want for r in rows.select("want", geo.unsigned(geo.s2_cell(F.col("lat"), F.col("lng"))).alias("got")).collect())


def test_maxspeed(spark):
    rows = spark.createDataFrame([("50", 50.0), ("50 km/h", 50.0), ("30 mph", 48.2802), ("signals", None), ("", None), (None, None), ("50.5", 50.0)], "t string, want double")
    for r in rows.select("want", roads.maxspeed_kph(F.col("t")).alias("got")).collect():
        assert r.got == pytest.approx(r.want) if r.want else r.got is None


def test_exact_search():
    assert paths.path({1: [(2, 1), (3, 4)], 2: [(3, 2)]}, 1, 3) == ([1, 2, 3], 3)
    assert paths.path({1: [(2, 1)]}, 2, 1) == (None, None)
    straddle = {"s": [("a", 2), ("m", 11)], "a": [("b", 16)], "b": [("t", 2)], "m": [("t", 11)]}
    assert paths.between(straddle, {"s": 0}, {"t": 0}) == (["s", "a", "b", "t"], 20)
    assert paths.between({1: [(2, 1)]}, {1: 0}, {2: 100})[1] == 101
    assert paths.path({1: [(2, 0)], 2: [(1, 0), (3, 5)]}, 1, 3) == ([1, 2, 3], 5)
    assert paths.between({}, {}, {1: 0}) == (None, math.inf)
