import pytest
from pyspark.sql import functions as F

from platewise.functions import categories as C
from platewise.functions import text as T

NAMES = [
    ("GRILLED SALMON WITH RICE", "Grilled Salmon with Rice"),
    ("NYC STYLE PIZZA", "NYC Style Pizza"),
    ("A1. Kung Pao Chicken", "Kung Pao Chicken"),
    ("Pad Thai - $14.50", "Pad Thai"),
    ("Pad Thai 14.50", "Pad Thai"),
    ("Pizza (gluten-free)", "Pizza"),
    ("Mac &amp; Cheese", "Mac & Cheese"),
    ("Caf&#233; Latt&#xe9;", "Café Latté"),
    ("Appetizers: Spring Rolls", "Spring Rolls"),
    ("Grilled Salmon (450 cal)", "Grilled Salmon"),
    ("Party Platter (Serves 4)", "Party Platter"),
    ("3-Cheese Pizza", "3-Cheese Pizza"),
    ("stir-fried noodles", "Stir-Fried Noodles"),
    ("Tacos al Pastor*", "Tacos al Pastor"),
    ("12", None),
    ("", None),
    (None, None),
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_name(spark):
    assert column(spark, [a for a, _ in NAMES], T.clean_name) == [b for _, b in NAMES]


def test_small_functions(spark):
    assert column(spark, ["Pad Thai (GF) - Large", "Soup**  Bowl"], T.name_key) == ["pad thai", "soup bowl"]
    assert column(spark, ["Bob's Big Burger!", None], T.slug) == ["bobs-big-burger", None]
    assert column(spark, ["img/pad-thai-v2.jpg"], T.stem) == ["pad-thai"]
    assert [str(x) if x is not None else None for x in column(spark, ["$1,250.50", "market price", "$$$", "9"], T.parse_price)] == ["1250.50", None, None, "9.00"]
    assert [tuple(r) for r in column(spark, ["95% (1,200)", "no"], T.parse_rating)] == [(95, 1200), (None, None)]
    assert tuple(column(spark, ["1 Main St, Queens, NY 11101, USA"], T.parse_address)[0]) == ("Queens", "NY")
    assert column(spark, ["1 <b>x</b> &lt;y&gt;"], T.clean_description) == ["1 x <y>"]


def test_similarity(spark):
    rows = [("night", "nacht"), ("", ""), ("a", "ab"), ("Pad Thai", "pad thai")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = [r.d for r in df.select("i", T.dice("a", "b").alias("d")).orderBy("i").collect()]
    assert got == pytest.approx([0.25, 1.0, 0.0, 1.0])
    one = spark.range(1).select(T.trigram_similarity(F.lit("chiken"), F.lit("Chicken Tikka")).alias("t")).first().t
    assert one == pytest.approx(0.3125)


def test_address(spark):
    rows = [("12 Main St, NY", "12 Main St", 1.0), ("12 Main St", "14 Main St", 0.0), ("", "x", 0.0), (None, "x", 0.0), ("Main St", "Main St, NY", 0.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, e double")
    for r in df.withColumn("s", T.address_similarity("a", "b")).collect():
        assert r.s == pytest.approx(r.e)


def test_detectors(spark):
    rows = [
        ("Pinot Noir", None, True), ("Vodka Rigatoni", None, False), ("Don Julio 1942 Añejo", None, True), ("Bourbon Glazed Ribs", None, False),
        ("Mezcal Me Maybe", None, False), ("Bulleit", "Bourbon", True), ("Greenport IPA", None, True), ("Pad Thai", "Noodles", False),
    ]
    df = spark.createDataFrame(rows, "name string, category string, expected boolean")
    for r in df.withColumn("w", C.is_wine_or_spirit("name", "category")).collect():
        assert r.w == r.expected, r.name
    kinds = [
        ("Kids Burger", None, "kids"), ("Family Meal for 4", None, "combo"), ("Chocolate Cake", None, "dessert"), ("Mango Lassi", None, "drink"), ("Fries", "Sides", "side"),
        ("Coca Cola", None, "drink"), ("Free parking", None, "non_food"), ("Green Curry", "Mains", "dish"), ("Ketchup", None, "condiment"),
    ]
    df = spark.createDataFrame(kinds, "name string, category string, expected string")
    for r in df.withColumn("k", C.classify("name", "category", F.lit(None).cast("string"))).collect():
        assert r.k == r.expected, r.name
    worth = [("Side of Rice", None, False), ("Pad Thai", "Drinks", False), ("Mango Lassi", "Drinks", True), ("Lunch Special", None, False), ("Water", None, False), ("Larb", None, True)]
    df = spark.createDataFrame(worth, "name string, category string, expected boolean")
    for r in df.withColumn("k", C.worth_recommending("name", "category")).collect():
        assert r.k == r.expected, r.name
