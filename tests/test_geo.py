"""The distance join: crowded cells are cut, every pair comes once."""

import random

import pytest
from pyspark.sql import functions as F

from platewise.functions.numbers import haversine
from platewise.operators import geo as G

SCHEMA = "id int, lat double, lng double"


def brute(left, right, miles):
    a = left.where("lat is not null and lng is not null").select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lng").alias("ga"))
    b = right.where("lat is not null and lng is not null").select(F.col("id").alias("b"), F.col("lat").alias("lb"), F.col("lng").alias("gb"))
    return sorted((r.a, r.b) for r in a.join(b, haversine("la", "ga", "lb", "gb") <= miles).collect())


def block(rnd, n, lat, lng, spread, first=0):
    return [(first + i, lat + rnd.uniform(-spread, spread), lng + rnd.uniform(-spread, spread)) for i in range(n)]


@pytest.mark.parametrize("most", [4, 40])
@pytest.mark.parametrize("at", [(40.7, -74.0), (0.0, 179.999), (89.97, 10.0), (-60.0, -180.0)])
def test_crowded_cells(spark, at, most):
    """Half of all points in one block, over the date line and by the pole too, some at one spot."""
    rnd = random.Random(7)
    right = block(rnd, 250, *at, 0.03) + [(900 + i, *at) for i in range(60)] + block(rnd, 200, at[0] / 2, at[1] / 2, 3.0, 400) + [(999, None, 1.0)]
    left = block(rnd, 120, *at, 0.05) + block(rnd, 60, at[0] / 2, at[1] / 2, 3.0, 400) + [(700, 1.0, None)]
    left = [(i, min(a, 90.0) if a is not None else a, g) for i, a, g in left]
    right = [(i, min(a, 90.0) if a is not None else a, g) for i, a, g in right]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = sorted((r.left_id, r.right_id) for r in G.geo_join(a, b, 1.5, most=most).collect())
    assert got == brute(a, b, 1.5) and got


@pytest.mark.parametrize("miles", [300.0, 5000.0, 9000.0])
def test_wide_cells(spark, miles):
    """Rows of one, two and three cells."""
    rnd = random.Random(11)
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(90)]
    df = spark.createDataFrame(pts, SCHEMA)
    got = sorted((r.left_id, r.right_id) for r in G.geo_join(df, df, miles, most=5).collect())
    assert got == brute(df, df, miles)


def test_work_is_dealt(spark):
    """With half of the points at one block and a tenth at one spot, no place holds many times ``most``."""
    rnd = random.Random(3)
    most = 100
    right = spark.createDataFrame(block(rnd, 4000, 40.7, -74.0, 0.01) + [(10000 + i, 40.7, -74.0) for i in range(800)] + block(rnd, 4000, 10.0, 10.0, 9.0, 20000), SCHEMA)
    left = spark.createDataFrame(block(rnd, 500, 40.7, -74.0, 0.01), SCHEMA)
    seen = G._cuts(
        right.selectExpr("cast(floor(lat) as bigint) as grow", "cast(floor(lng) as bigint) as gcol", "cast((lng - floor(lng)) * 32 as int) as x", "cast((lat - floor(lat)) * 32 as int) as y"),
        left.selectExpr("cast(floor(lat) as bigint) as grow", "cast(floor(lng) as bigint) as gcol"),
        most,
    ).where("salt = 0").collect()
    held = spark.createDataFrame([(r.grow, r.gcol, s.x, s.y, s.side, s.parts) for r in seen for s in r.squares], "grow long, gcol long, x int, y int, side int, parts long")
    pts = right.selectExpr("cast(floor(lat) as bigint) as grow", "cast(floor(lng) as bigint) as gcol", "cast((lng - floor(lng)) * 32 as int) as px", "cast((lat - floor(lat)) * 32 as int) as py")
    inside = pts.join(held, ["grow", "gcol"]).where("px >= x and px < x + side and py >= y and py < y + side")
    crowded = pts.groupBy("grow", "gcol").count().where(F.col("count") > most).join(pts, ["grow", "gcol"]).count()
    assert inside.count() == crowded  # each point of a crowded cell is in one square
    per = inside.groupBy("grow", "gcol", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts")).where(f"n / parts > {most}")
    assert per.count() == 0
    assert max(r.lparts for r in seen) >= 3


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1.0, 1.0)], SCHEMA)
    assert G.geo_join(none, some, 1.0).count() == 0 and G.geo_join(some, none, 1.0).count() == 0
