"""Tests of what the third review found."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import filters as FL
from platewise.operators import joins as J
from platewise.operators import rank as R
from platewise.queries import score6
from platewise.streaming import jobs as ST
from platewise.upkeep_queries import QUERIES
from tests.conftest import SMALL

LARGER = "/root/testdata/sf0.1"

tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_requests_keep_their_own_columns(spark):
    cols = ["lat", "lng", "radius", "calorie_limit", "protein_min", "max_wait", "limit", "offset", "sort", "goal", "diet", "cuisines", "categories", "allergens", "q"]
    df = spark.range(1).select(F.lit(12_345).alias("log_id"), *[F.lit(None).cast("string").alias(c) for c in cols])
    assert [r.log_id for r in FL.query_fingerprint(FL.validate_requests(df)).collect()] == [12_345]


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_search_by_words_meets_reviews(spark):
    """A filter by the name's words was moved to the reviews, which have no name."""
    assert QUERIES["search_safe"](spark, LARGER).collect()


def test_scores_round_like_the_checking_database(spark):
    assert spark.range(1).select(score6(F.lit(0.8823124999999999))).first()[0] == 0.882313


def test_truth_is_sought_once_a_name(spark):
    items = spark.createDataFrame([(1, "a", "Red Soup"), (2, "a", "red soup"), (3, "b", "Red Soup"), (4, "b", "xy"), (5, "c", "none")], "item_id long, restaurant string, name string")
    truth = spark.createDataFrame([("soup", "a", "own"), ("RED SOUP", "general", "g"), ("x", "general", "short"), ("big xy", "b", "long")], "name string, restaurant string, label string")
    assert sorted(map(tuple, J.truth_match(items, truth).collect())) == [(1, "soup", "own"), (2, "soup", "own"), (3, "red soup", "g"), (4, "big xy", "long")]


@tables
@pytest.mark.parametrize("name", ["truth_labels", "vetoed_places", "photo_files"])
def test_exploded_rows_are_not_broadcast(spark, name):
    """They pass for no more than the table that they come from."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan.replace("BroadcastHashJoin [h#", "")  # but a row for each of the bounded hashes


def test_places_meet_by_house_number(spark):
    a = spark.createDataFrame([(1, "Blue Door", "5 Oak Street, NY"), (2, "Blue Door", "Oak Street, NY"), (3, "Blue Door", "7 Elm Street")], "id long, name string, address string")
    b = spark.createDataFrame([(1, "Blue Doors", "5 Oak Street"), (2, "Blue Door", "6 Oak Street"), (3, "Blue Door", None)], "id long, name string, address string")
    every = lambda accept: sorted((r.left_id, r.right_id) for r in J.match_places(a, b, accept).collect())
    assert every(0.75) == [(1, 1), (2, 2)]
    assert every(0.6) == [(1, 1), (2, 2), (3, 2)]


def test_equal_slug_before_equal_bigrams(spark):
    dishes = spark.createDataFrame([(1, "ring 12121!")], "id long, name string")
    files = spark.createDataFrame([("img/ring-1212.jpg", "-"), ("img/ring-12121-v2.jpg", "-")], "file string, name string")
    assert [r.file for r in J.match_photos(dishes, files).collect()] == ["img/ring-12121-v2.jpg"]


def test_windows_of_votes_hold_no_row_a_day(spark):
    import datetime as dt

    at = [dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 3), dt.datetime(2024, 3, 1)]
    f = spark.createDataFrame([(7, "portion_bigger", t) for t in at], "dish_id long, feedback_type string, created_at timestamp")
    votes = ST.feedback_votes(f, 3)
    got = sorted((str(r.window.start.date()), r.portion_bigger) for r in votes.collect())
    assert got == [("2023-12-30", 2), ("2023-12-31", 2), ("2024-01-01", 3), ("2024-01-02", 1), ("2024-01-03", 1), ("2024-02-28", 1), ("2024-02-29", 1), ("2024-03-01", 1)]
    assert "sequence(0" not in votes._jdf.queryExecution().analyzed().toString()


def test_foods_are_scored_once_a_name(spark):
    items = spark.range(1000).select("id", F.lit("red soup").alias("name"))
    foods = spark.createDataFrame([(1, "Soup, red", "Foundation")], "food_id long, description string, data_type string")
    got = J.match_foods(items, foods, {})
    assert got.count() == 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(id" not in plan


def test_near_areas_need_no_distinct(spark):
    a = spark.createDataFrame([(1, 40.0, -74.0, "Soho"), (2, None, None, "soho"), (3, 50.0, 1.0, "x")], "id long, lat double, lng double, name string")
    b = spark.createDataFrame([(8, 40.005, -74.0, "SOHO"), (9, 50.5, 1.0, "y")], "id long, lat double, lng double, name string")
    got = J.near_duplicate_areas(a, b)
    assert sorted(map(tuple, got.collect())) == [(1, 8), (2, 8)]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_similarities_of_a_block_come_in_slices():
    v = np.random.default_rng(1).standard_normal((R.SLICE * 3, 64))
    ids = np.arange(len(v))
    tracemalloc.start()
    got = R._best(v, v, ids, ids, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    assert got.near.tolist() == np.argsort(-s, axis=1)[:, :2].ravel().tolist()
    assert peak < s.nbytes
