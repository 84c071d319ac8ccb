import math

import pytest
from pyspark.sql import functions as F

from platewise.functions import numbers as N
from platewise.operators import safety as S


def test_wait_curve(spark):
    rows = [(0, 0), (30, 5), (50, 15), (70, 25), (85, 40), (100, 60), (None, None)]
    df = spark.createDataFrame(rows, "b int, e int").withColumn("w", N.wait_minutes("b"))
    assert all(r.w == r.e for r in df.collect())


def test_rounding_and_vectors(spark):
    r = spark.range(1).select(N.round_half_up(F.lit(-2.5)).alias("a"), N.round_half_up(F.lit(0.25), 1).alias("b")).first()
    assert (r.a, r.b) == (-2.0, 0.3)
    vec = N.macro_vector("c", "p", "k", "f")
    df = spark.createDataFrame([(500.0, 30.0, 60.0, 20.0), (None, 1.0, 1.0, 1.0), (500.0, 25.0, 45.0, 20.0)], "c double, p double, k double, f double").select(vec.alias("v"))
    a, b, c = [x.v for x in df.collect()]
    assert math.isclose(sum(x * x for x in a), 1.0) and b is None and c is None
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>").select(N.cosine("a", "b").alias("x")).first()
    assert pair.x == 0.0
    near = spark.createDataFrame([(450.0, 30.0, 50.0, 15.0, 480.0, 32.0, 52.0, 16.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    assert near.select(N.cosine(N.macro_vector("a", "b", "c", "d"), N.macro_vector("e", "f", "g", "h")).alias("x")).first().x > 0.93


DISH = "id int, name string, description string, flags map<string,boolean>, confidence double"


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_gates(spark):
    rows = [
        (1, "Salad", None, {"vegan": True}, 0.95),
        (2, "Salad", None, {"vegan": False}, 0.95),
        (3, "Salad", None, {"vegan": None}, 0.5),
        (4, "Salad", None, {"vegan": True}, 0.8),
        (5, "Beef salad", None, {"vegan": True}, 0.95),
        (6, "Unagi bowl", None, {"vegan": True}, 0.87),
        (7, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DISH)
    assert ids(S.diet_gate(df, [])) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(S.diet_gate(df, ["vegan"])) == [1]
    halal = spark.createDataFrame([(1, "a", "", {"halal": True}, 0.1), (2, "a", "", {"halal": None}, 0.6), (3, "a", "", {"halal": None}, 0.7), (4, "a", "", {}, 0.1), (5, "a", "", {"halal": False}, 0.9)], DISH)
    assert ids(S.diet_gate(halal, ["halal"])) == [1, 3, 4]  # a missing flag is not an unknown one
    nuts = spark.createDataFrame(
        [(1, "Rice", "with peanut sauce", {"nut_free": True}, 0.99), (2, "Rice", "plain", {"nut_free": True}, 0.85), (3, "Pad Thai", "plain", {"nut_free": True}, 0.87), (4, "Rice", "", {"nut_free": None}, 0.99), (5, "Omelette", "", {"nut_free": True}, 0.9)], DISH
    )
    assert ids(S.allergen_gate(nuts, ["peanuts"])) == [2, 5]
    assert ids(S.allergen_gate(nuts, ["peanuts", "eggs"])) == [2]
    assert ids(S.diet_filter(nuts, ["nut_free"])) == [1, 2, 3, 5]


def test_warnings(spark):
    df = spark.createDataFrame([(1, "Pad Thai", "", {"nut_free": True, "halal": None}, 0.85), (2, "Rice", "", {"nut_free": True}, 0.95)], DISH)
    got = {r.id: r.w for r in df.select("id", S.diet_warnings(["nut_free", "halal"]).alias("w")).collect()}
    assert len(got[1]) == 3 and "not verified" in got[1][0] and "traditionally" in got[1][1] and "unknown" in got[1][2]
    assert got[2] == []
    assert spark.range(1).select(S.diet_warnings([]).alias("w")).first().w == []


@pytest.mark.parametrize("allergen", list(S.WORDS))
def test_every_allergen_word_drops(spark, allergen):
    word = S.WORDS[allergen][0]
    df = spark.createDataFrame([(1, f"Dish with {word}", "", {f: True for f in S.CRITICAL}, 1.0)], DISH)
    assert ids(S.allergen_gate(df, [allergen])) == []
