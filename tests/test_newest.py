"""The stored newest-child table, and search plans that read it."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from platewise import queries as Q
from platewise.operators import joins as J
from platewise.plans import newest as NE
from platewise.plans import search as SE

SCHEMA = "dish_id long, photo_id long, taken_at timestamp"
KEYS = ("dish_id", "taken_at", "photo_id")


def rows(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(40)]), i, rnd.choice([None, datetime(2024, 1, 1) + timedelta(hours=rnd.randint(0, 9))])) for i in range(n)]


def stored(spark, path):
    return {r.dish_id: r.photo_id for r in NE.newest(spark, path, "dish_id", "photo_id").collect()}


def want(photos):
    best = {}
    for d, p, t in photos:
        if d is not None:
            best[d] = max(best.get(d, (False, datetime.min, -1)), (t is not None, t or datetime.min, p))
    return {d: p for d, (_, _, p) in best.items()}


def test_batches_in_any_order(spark, tmp_path):
    photos, path = rows(300, 1), str(tmp_path / "n")
    for part in (photos[200:], photos[:100], photos[100:200], photos[200:]):
        NE.merge_newest(spark.createDataFrame(part, SCHEMA), path, *KEYS, buckets=8)
    assert stored(spark, path) == want(photos)
    assert NE.merge_newest(spark.createDataFrame([], SCHEMA), path, *KEYS, buckets=8) == 0


def test_a_batch_writes_its_own_folders(spark, tmp_path):
    path = str(tmp_path / "n")
    NE.build_newest(spark.createDataFrame(rows(300, 2), SCHEMA), path, *KEYS, buckets=32)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if "bucket" in d and f.endswith(".parquet")}
    before = files()
    assert NE.merge_newest(spark.createDataFrame([(3, 1000, datetime(2025, 1, 1)), (3, 999, datetime(2025, 1, 1))], SCHEMA), path, *KEYS, buckets=32) == 1
    after = files()
    assert len({os.path.dirname(f) for f in before.keys() ^ after.keys()}) == 1
    assert stored(spark, path)[3] == 1000


def test_taken_out(spark, tmp_path):
    photos, path = rows(200, 3), str(tmp_path / "n")
    NE.build_newest(spark.createDataFrame(photos, SCHEMA), path, *KEYS, buckets=4)
    gone = [x for x in photos if x[1] % 3 or x[0] == 7]
    left = [x for x in photos if x not in gone]
    for _ in range(2):
        NE.forget_children(spark.createDataFrame(gone, SCHEMA), spark.createDataFrame(left, SCHEMA), path, *KEYS, buckets=4)
        assert stored(spark, path) == want(left)
    NE.merge_newest(spark.createDataFrame([(7, 5000, None)], SCHEMA), path, *KEYS, buckets=4)
    assert stored(spark, path)[7] == 5000
    NE.forget_children(spark.createDataFrame([(7, 1, None)], SCHEMA), spark.createDataFrame(left, SCHEMA), str(tmp_path / "none"), *KEYS)


def test_builds_equal_the_aggregate(spark, tmp_path):
    photos = spark.createDataFrame(rows(400, 4), SCHEMA).where("taken_at is not null")
    NE.build_newest(photos, str(tmp_path / "n"), *KEYS)
    parents = photos.select("dish_id").where("dish_id is not null").distinct()
    assert stored(spark, str(tmp_path / "n")) == {r.dish_id: r.photo_id for r in J.latest_child(parents, photos, *KEYS).collect()}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_search_reads_no_photos(spark):
    plan = Q.search_stored_photos(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_shipdate" not in plan


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("q", ["gears", "the on", "zzzz", "rin"])
def test_search_runs_nothing_while_planning(spark, q):
    """Words met in English, only as they are, nowhere, and inside of words."""
    tables = Q._tables(spark, SMALL)
    tracker, group = spark.sparkContext.statusTracker(), f"plan-{q}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = SE.candidates(*tables, SE.SearchSpec(q=q))
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r.dish_id for r in found.select("dish_id").collect()}
    d = tables[0].where("is_available").join(tables[1].where("is_active").select("restaurant_id"), "restaurant_id")
    inside = {r.dish_id for r in d.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("description"), F.lit(q))).collect()}
    if q == "gears":
        assert got
    else:
        assert got == inside
