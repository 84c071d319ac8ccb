"""Findings of round 3, third part."""

from pyspark.sql import functions as F

from platewise.functions import numbers as N
from platewise.operators import geo as G
from platewise.operators import rank as R
from platewise.sources import feeds as FE


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_source_ranks_and_joins_nothing(spark):
    rows = [(1, 2, "b"), (1, 2, "c"), (1, 3, "d"), (2, 9, "e"), (None, 1, "f"), (3, None, "g"), (4, None, "h"), (4, 8, "i")]
    df = spark.createDataFrame(rows, "k bigint, line int, v string")
    one = FE.first_source(df, "k", "line")
    assert one.columns == df.columns and sorted(r.v for r in one.collect()) == ["b", "c", "e", "i"]
    many = FE.first_nonempty_source([df.where(F.col("line") == n) for n in (2, 3, 8, 9)], "k")
    assert sorted((r.v, r.source_no) for r in many.collect()) == [("b", 0), ("c", 0), ("e", 3), ("i", 2)]
    for out in (one, many):  # a semi-join with the least sources went into every source
        assert "Join" not in plan_of(out)


def test_similar_writes_the_vector_once(spark):
    rows = [(1, 1, [1.0, 2.0]), (2, 2, [2.0, 4.1]), (3, 3, [0.0, 0.0]), (4, 4, None), (5, 5, [1.0]), (6, 6, [1.0, 2.0, 3.0]), (7, 7, [1.0, None]), (8, 8, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "dish_id bigint, restaurant_id bigint, vec array<double>")
    source = [1.0, 2.0]
    old = N.cosine("vec", F.array(*[F.lit(v) for v in source]))
    assert all(r.a == r.b for r in df.select(old.alias("a"), N.cosine_to("vec", source).alias("b")).collect())
    assert {r.x for r in df.select(N.cosine_to("vec", [0.0, 0.0]).alias("x")).collect()} == {0.0, None}
    dishes = spark.range(100).selectExpr("id as dish_id", "id % 9 as restaurant_id", "cast(200 + id * 13 % 607 as int) as a", "id * 7 % 41 / 1d as b", "id * 11 % 71 / 1d as c", "id * 17 % 31 / 1d as d")
    dishes = dishes.withColumn("vec", N.macro_vector("a", "b", "c", "d"))
    at = {"vec": [0.5, 0.5, 0.5, 0.5], "restaurant_id": 3}
    every = R.similar(dishes, at, min_similarity=0.2, n=None)
    assert "aggregate(" not in plan_of(every) and plan_of(every).count("SQRT") <= 12
    want = sorted((-r.s, r.dish_id) for r in dishes.where("restaurant_id <> 3").select("dish_id", N.cosine("vec", F.array(*[F.lit(0.5)] * 4)).alias("s")).collect() if r.s > 0.2)
    assert sorted((-r.similarity, r.dish_id) for r in every.collect()) == want and want
    assert [r.dish_id for r in R.similar(dishes, at, min_similarity=0.2, n=7).collect()] == [d for _, d in want[:7]]


def test_geo_join_finds_a_distance_once_a_place(spark):
    """A crowded cell of few places: rows of a place meet, and pairs come out whole."""
    left = spark.range(400).selectExpr("id", "40.7 + id % 50 / 4000d as lat", "-74 + id % 7 / 3000d as lng")
    right = spark.range(3000).selectExpr("id + 10000 as id", "40.7 + id % 5 / 900d as lat", "-74 + id % 3 / 700d as lng")
    got = G.geo_join(left, right, 0.5, most=64, digits=6)
    plan = plan_of(got)
    assert plan.index("explode(right_ids") < plan.index("ASIN")  # ids come apart after the distance
    pairs = left.selectExpr("id as l", "lat as la", "lng as ga").crossJoin(right.selectExpr("id as r", "lat as lb", "lng as gb")).withColumn("m", N.haversine("la", "ga", "lb", "gb")).where("m <= 0.5")
    want = {(r.l, r.r): r.m for r in pairs.collect()}
    rows = got.collect()
    assert len(rows) == len(want) > 100_000 and all(abs(r.miles - want[r.left_id, r.right_id]) <= 5.1e-7 for r in rows)
    places = G._places(right.selectExpr("id as right_id", "lat as rlat", "lng as rlng", "0L as grow", "0L as gcol", "0 as x", "0 as y"), 16).collect()
    assert sorted(i for r in places for i in r.right_ids) == list(range(10000, 13000)) and max(len(r.right_ids) for r in places) < 64
