"""Tests of what the third review found, second part."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platewise.functions.stems import stem
from platewise.operators import geo as G
from platewise.operators import joins as J
from platewise.plans import search as SE
from platewise.plans import text_index as TI
from platewise.plans import vector_index as V
from platewise.upkeep_queries import QUERIES, SQL


def test_other_words_of_a_stem_do_not_count(spark, tmp_path):
    """``hationeant`` has the stem of ``hation`` and stands in one document of the larger tables."""
    assert stem("hationeant") == stem("hations") == "hation"
    df = spark.createDataFrame([(1, "a hationeant word"), (2, "some hations"), (3, "Hation")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.doc_id for r in QUERIES["indexed_search"](spark, str(tmp_path)).collect())
    sql = SQL["indexed_search"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(r[0] for r in duckdb.sql(sql).fetchall()) == [2, 3]


def test_postings_leave_a_task_in_pieces(spark, tmp_path, monkeypatch):
    """All postings of a batch were held as lists and left it as one: most of a gigabyte for 10,000 texts."""
    taken = {}

    class Texts:
        sparkSession = spark
        schema = spark.createDataFrame([], "id long, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            taken["run"] = run

    TI.postings(Texts(), ["text"], "id")
    rows = 300
    batch = pa.RecordBatch.from_pydict({"key": list(range(rows)), "f0": ["red soup " * 1000] * (rows - 1) + ["late word"]})
    out = list(taken["run"](iter([batch])))
    assert max(b.column("places").flatten().__len__() for b in out) < TI.PIECE + 2001
    assert sum(b.num_rows for b in out) == 2 * rows
    last = out[-1].to_pylist()[-2:]
    assert [(r["word"], r["key"], r["n"], [x["p"] for x in r["places"]]) for r in last] == [("late", rows - 1, 2, [0]), ("word", rows - 1, 2, [1])]


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_what_all_names_have_does_not_make_them_meet(spark, threshold):
    """"Supplier#000000" is most of a name: all 90,000 pairs were compared."""
    names = [f"Supplier#{i * 37:09d}" for i in range(300)] + ["Supplier", "Fine Supplier", "a", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    sides = J._sides(df, df, J.T.trigrams, [])
    grams = {r.l: set(r.lg) for r in sides[0].collect()}
    met = J._grams_met(*sides, threshold, []).collect()
    got = {(r.l, r.r) for r in met if r.k / (r.ln + r.rn - r.k) > threshold}
    assert got == {(i, j) for i, a in grams.items() for j, b in grams.items() if len(a & b) / len(a | b) > threshold}
    assert threshold < 0.5 or len(met) < 0.6 * 90_000


def test_grams_have_codes_of_their_own(spark):
    grams = ["", "a", "ab", "abc", "  a", "ba", "a\0", "\U0001f35c\U0001f35ca", "\U0010ffff" * 3, "\uffff" * 3]
    codes = spark.createDataFrame([(grams,)], "g array<string>").select(J._codes(F.col("g"))).first()[0]
    assert len(set(codes)) == len(grams)


def test_a_typed_text_is_sought_once(spark):
    dishes = spark.createDataFrame([("Red Soup",), ("red soup",), ("Soup",), ("Big Red",)], "name string")
    typed = spark.createDataFrame([(i, ["re", "RE ", "soup", None, ""][i % 5]) for i in range(500)], "id long, q string")
    got = SE.suggest(dishes, typed)
    assert got.count() == 100 * (2 + 2 + 2)
    assert sorted((r.name, r.tier, r.place) for r in got.where("id = 1").collect()) == [("Big Red", 1, 2), ("Red Soup", 0, 1)]


def test_a_crowd_of_queries_is_many_tasks(spark, tmp_path, monkeypatch):
    """All queries of a list were one task, however many; and a vector left Python once for each of its lists."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    index = V.build(df, "id", "v", str(tmp_path / "v"), list_rows=400)
    seen = {}
    real = V._search_blocks

    def watched(left, right, keys, k):
        seen["most"] = max(r["count"] for r in left.groupBy(*keys).count().collect())
        return real(left, right, keys, k)

    monkeypatch.setattr(V, "_search_blocks", watched)
    got = {(r.id, r.near) for r in V.search(index, df, "id", "v", 3, 2).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T - 3 * np.eye(len(v))
    assert got == {(i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:3]}
    assert seen["most"] < 120
