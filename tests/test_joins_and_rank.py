import random

import pytest
from pyspark.sql import functions as F

from platewise.functions.numbers import haversine
from platewise.operators import aggregates as A
from platewise.operators import filters as FL
from platewise.operators import joins as J
from platewise.operators import rank as R


@pytest.mark.parametrize("miles", [1.0, 60.0, 700.0])
def test_geo_join_is_complete(spark, miles):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(120)]
    pts += [(200, 40.7, -74.0), (201, 40.705, -74.0), (202, 0.0, 179.999), (203, 0.0, -179.999), (204, 89.99, 10.0), (205, 89.99, -170.0), (206, -89.9, 3.0), (207, 90.0, 0.0), (208, None, 1.0)]
    df = spark.createDataFrame(pts, "id int, lat double, lng double")
    got = [(r.left_id, r.right_id) for r in J.geo_join(df, df, miles).collect()]
    b = df.where("lat is not null")
    brute = b.select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lng").alias("ga")).join(b.select(F.col("id").alias("b"), F.col("lat").alias("lb"), F.col("lng").alias("gb")))
    want = [(r.a, r.b) for r in brute.where(haversine("la", "ga", "lb", "gb") <= miles).collect()]
    assert sorted(got) == sorted(want)


def test_diversity_cap_equals_greedy(spark):
    rnd = random.Random(5)
    rows = [(i, r, r % 4, float(rnd.randint(0, 20))) for i in range(200) for r in [rnd.randint(0, 19)]]
    df = spark.createDataFrame(rows, "dish_id int, restaurant_id int, cuisine int, score double")
    got = {r.dish_id for r in R.diversity_cap(df, [F.desc("score"), F.asc("dish_id")], [("restaurant_id", 3), ("cuisine", 6)]).collect()}
    per_r, per_c, want = {}, {}, set()
    for d, r, c, _ in sorted(rows, key=lambda x: (-x[3], x[0])):
        if per_r.get(r, 0) < 3 and per_c.get(c, 0) < 6:
            per_r[r], per_c[c] = per_r.get(r, 0) + 1, per_c.get(c, 0) + 1
            want.add(d)
    assert got == want
    with pytest.raises(ValueError):
        R.diversity_cap(df.withColumn("cuisine", F.col("dish_id")), [F.desc("score")], [("restaurant_id", 3), ("cuisine", 6)])


def test_null_orders(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 3.0, None), (3, 9.0, 1)], "dish_id int, protein_max double, calories_min int")
    assert [r.dish_id for r in R.goal_order(df, "max_protein", 5).collect()] == [1, 3, 2]
    assert [r.dish_id for r in R.goal_order(df, "min_calories", 5).collect()] == [3, 1, 2]


def test_max_wait(spark):
    df = spark.createDataFrame([(1, None), (2, 15), (3, 16)], "id int, wait int")
    assert FL.max_wait(df, 15).count() == 2 and FL.max_wait(df, 15, inclusive=False).count() == 1


def test_reviews_for_dishes(spark):
    dishes = spark.createDataFrame([(1, 1, "Pad Thai"), (2, 1, "Green Curry Chicken"), (3, 1, "The Bowl"), (4, 2, "Pad Thai")], "dish_id int, restaurant_id int, name string")
    reviews = spark.createDataFrame([(1, 1, "Best pad thai in town"), (2, 1, "my iPad broke"), (3, 1, "the green curry, with chicken!"), (4, 1, "green curry only"), (5, 1, "I liked the bowl")], "review_id int, restaurant_id int, text string")
    assert sorted(map(tuple, J.reviews_for_dishes(dishes, reviews).collect())) == [(1, 1), (2, 3), (3, 5)]


def test_matches(spark):
    ours = spark.createDataFrame([(1, "Joe's Pizza", "7 Carmine St, NY"), (2, "Thai Villa", "5 E 19th St")], "id int, name string, address string")
    theirs = spark.createDataFrame([(1, "Joes Pizza", "7 Carmine St"), (2, "Joe's Pizza", "150 E 14th St"), (3, "Thai Villas", "5 E 19th St, NY"), (4, "Nobu", None)], "id int, name string, address string")
    assert sorted((r.left_id, r.right_id) for r in J.match_places(ours, theirs).collect()) == [(1, 1), (2, 3)]
    dishes = spark.createDataFrame([(1, "Pad Thai"), (2, "Green Curry"), (3, "Tom Yum Soup")], "id int, name string")
    files = spark.createDataFrame([("a.jpg", "Pad Thai"), ("b.jpg", "green curry"), ("tom-yum-soups-v2.jpg", "x")], "file string, name string")
    assert sorted((r.id, r.file, r.tier) for r in J.match_photos(dishes, files).collect()) == [(1, "a.jpg", "exact"), (2, "b.jpg", "case"), (3, "tom-yum-soups-v2.jpg", "fuzzy")]
    truth = spark.createDataFrame([("Pad Thai", "general", "dish"), ("Thai", "R1", "drink")], "name string, restaurant string, label string")
    items = spark.createDataFrame([(1, "R1", "pad thai", "dish"), (2, "R2", "Pad Thai special", "dish"), (3, "R2", "Soup", "dish")], "item_id int, restaurant string, name string, item_type string")
    assert sorted((r.item_id, r.label) for r in J.truth_match(items, truth).collect()) == [(1, "drink"), (2, "dish")]
    e = {r.label: (r.n, r.accuracy) for r in A.classifier_eval(items, truth).collect()}
    assert e == {"drink": (1, 0.0), "dish": (1, 1.0), "all": (2, 0.5)}


def test_ensemble_outliers(spark):
    rows = [(1, float(c), 0.8) for c in (400, 420, 380, 1200)] + [(2, float(c), 0.8) for c in (400, 450, 500)] + [(3, 100.0, 0.5)]
    df = spark.createDataFrame(rows, "dish_id int, calories double, confidence double")
    got = {r.dish_id: r for r in A.ensemble(df, "dish_id", ["calories"]).collect()}
    assert got[1].n_outliers == 1 and got[1].calories < 500
    assert got[2].n_outliers == 0 and got[2].calories == 450.0
    assert got[3].confidence == 0.5 and got[3].calories_max == 120.0


def test_requests(spark):
    cols = ["lat", "lng", "radius", "calorie_limit", "protein_min", "max_wait", "limit", "offset", "sort", "goal", "diet", "cuisines", "categories", "allergens", "q"]
    base = dict.fromkeys(cols)
    rows = [base | {"lat": "40.736", "lng": "-73.991", "goal": "max_protein", "diet": "vegan, gluten_free"}, base | {"lat": "100", "lng": "200", "sort": "invalid", "limit": "999", "radius": "-1"}]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))
    good, bad = FL.query_fingerprint(FL.validate_requests(df)).collect()
    assert good.errors == [] and good.radius == 2.0 and good["limit"] == 20
    assert good.fingerprint == "query:all:gluten_free|vegan:max_protein:none:default:calnone:protnone:alnone:waitnone:40.736,-73.991:r2.0"
    assert set(bad.errors) == {"lat", "lng", "sort", "limit", "radius"}
