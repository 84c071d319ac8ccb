"""Tests of what the fourth review found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import blocks as B
from platewise.operators import joins as J
from platewise.operators import rank as R
from platewise.plans import search as SE
from platewise.plans import vector_index as V
from platewise.upkeep_queries import recalled


def test_all_similar_names_are_candidates(spark):
    """Of similar names the fifty most similar ones were kept, and the first five of those by name returned."""
    names = [f"soup zz{c}{d}" for c in "abcdefgh" for d in "abcdefgh"] + [f"a soup of the day {i}" for i in range(5)]
    dishes = spark.createDataFrame([(n,) for n in names], "name string")
    typed = spark.createDataFrame([(1, "zoup soup")], "id long, q string")
    got = [r.name for r in SE.suggest(dishes, typed).orderBy("place").collect()]
    assert got == [f"a soup of the day {i}" for i in range(5)]


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.7])
def test_the_most_alike_name_is_the_best_of_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(B, "BLOCK_ROWS", 40)
    rnd = random.Random(9)
    name = lambda: "".join(rnd.choice("abc 1") for _ in range(rnd.randint(0, 9)))
    left = spark.createDataFrame([(i, name()) for i in range(150)] + [(None, "abc"), (999, None)], "id long, name string")
    right = spark.createDataFrame([(f"f{i}", name()) for i in range(200)] + [(None, "abc")], "id string, name string")
    want = J.best_match(J.dice_join(left, right, threshold)).collect()
    got = J.most_alike(left, right, threshold).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_unlike_names_shuffle_no_pairs(spark):
    """Random names met by pairs of bigrams, which are a part of all pairs of names."""
    dishes = spark.range(400).select("id", F.md5(F.col("id").cast("string")).alias("name"))
    files = spark.range(400).select(F.concat(F.lit("img/"), F.md5(F.concat(F.lit("x"), "id")), F.lit(".jpg")).alias("file"), F.lit("-").alias("name"))
    matched = J.match_photos(dishes, files)
    assert matched.count() == 0
    assert "xxhash64" not in matched._jdf.queryExecution().analyzed().toString()


def vectors(spark, n=600, kind="double"):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((n, 8))
    v[n // 2 :] = v[n // 2]  # half of the rows is one vector
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"id long, v array<{kind}>")


@pytest.mark.parametrize("kind", ["double", "float"])
def test_vectors_of_all_blocks_meet_without_a_shuffle(spark, kind):
    """Each vector was sent to as many tasks as there are blocks."""
    df = vectors(spark, kind=kind)
    v = np.array([r.v for r in df.orderBy("id").collect()])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T - 3 * np.eye(len(v)), 9)
    want = {(i, int(j)) for i, row in enumerate(s) for j in np.lexsort((np.arange(len(row)), -row))[:4]}
    exact = R.similar_all(df, "id", "v", 4, block_rows=70)
    assert {(r.id, r.near) for r in exact.collect()} == want
    listed = R.similar_by_lists(df, "id", "v", 4, n_lists=9, recall=1.0, block_rows=70)
    assert len({(r.id, r.near) for r in listed.collect()} & want) > 0.97 * len(want)
    for found in (exact, listed):
        assert "FlatMapCoGroupsInPandas" not in found._jdf.queryExecution().analyzed().toString()


def test_missing_and_repeated_ids_of_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = sorted((r.id, r.near) for r in R.similar_all(df, "id", "v", 3, block_rows=2).collect())
    assert got == [(1, 2)] * 3 + [(2, 1)] * 3 + [(4, 1), (4, 1), (4, 2)]
    assert R.similar_all(df.limit(0), "id", "v", 3).count() == 0


def test_queries_of_an_index_are_written_once(spark, tmp_path, monkeypatch):
    """A query was sent to each list of each cell that it looks into."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 60)
    df = vectors(spark, 500)
    index = V.build(df, "id", "v", str(tmp_path / "v"), list_rows=20)
    assert len(index.cells) > 3 and index.lists().count() > 10
    held = V.blocks(index)
    exact = {(r.id, r.near) for r in R.similar_all(df, "id", "v", 3).collect()}
    found = V.search(index, df, "id", "v", 3, 1024, held)
    assert {(r.id, r.near) for r in found.collect()} == exact
    assert "FlatMapCoGroupsInPandas" not in found._jdf.queryExecution().analyzed().toString()
    few = V.search(index, df.where("id < 5").withColumn("v", F.col("v").cast("array<float>")), "id", "v", 3, 1024, held)
    assert {(r.id, r.near) for r in few.collect()} == {(i, j) for i, j in exact if i < 5}
    one = V.search(index, df, "id", "v", 3, 1, held)
    assert one.count() and {r.id for r in one.collect()} <= set(range(500))


def test_recall_needs_one_exact_search(spark):
    """The exact search stood twice in the plan, for the pairs and for their number."""
    of = lambda rows: spark.createDataFrame(rows, "id long, near long")
    exact = of([(i, i + j) for i in range(20) for j in (1, 2)])
    for found, hit in ((exact, True), (exact.where("id < 18"), True), (exact.where("id < 17"), False), (exact.limit(0), False)):
        got = recalled(exact, found)
        assert [tuple(r) for r in got.collect()] == [(hit, 20)]
    assert [tuple(r) for r in recalled(exact.limit(0), exact).collect()] == [(True, 0)]
    searched = recalled(exact.mapInArrow(lambda batches: batches, exact.schema), exact.where("id < 18"))
    assert searched._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
