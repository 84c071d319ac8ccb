import numpy as np

from platewise.operators import rank as R
from platewise.plans import vector_index as V
from platewise.sources.menus import entries_of_page, menu_item_annotations


def clustered(spark, n, seed=1, first=0):
    rnd = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(40, 16))
    v = centres[rnd.integers(0, 40, n)] + 0.2 * rnd.normal(size=(n, 16))
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(v.tolist())], "key bigint, vec array<double>")


def pairs(df):
    return {(r.id, r.near) for r in df.collect()}


def test_index_reaches_recall_and_takes_new_rows(spark, tmp_path):
    old, new = clustered(spark, 3000), clustered(spark, 500, seed=2, first=3000)
    index = V.build(old, "key", "vec", f"{tmp_path}/i", list_rows=60)
    assert index.rows().count() == 3000 and index.lists().count() > 30
    V.add(index, new, "key", "vec")
    V.add(index, new.unionByName(new), "key", "vec")  # a replayed batch changes nothing
    index = V.load(spark, index.path)
    every = old.unionByName(new)
    assert index.rows().count() == 3500 == index.rows().select("id").distinct().count()
    probes = V.probes_of(index, 5)
    exact, found = pairs(R.similar_all(every, "key", "vec", 5)), pairs(V.search(index, every, "key", "vec", 5, probes))
    assert len(found) == len(exact) == 5 * 3500 and len(exact & found) >= 0.93 * len(exact)
    met = index.rows().groupBy("cell", "list").count().agg({"count": "max"}).first()[0]
    assert probes**2 * met < 3500  # a query does not meet the whole table


def test_all_lists_are_exact_even_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 50)
    monkeypatch.setattr(V, "TASK_ROWS", 70)
    copies = spark.range(0, 300).selectExpr("id + 1000 as key", "transform(sequence(1, 16), x -> cast(x as double)) as vec")
    df = clustered(spark, 400).unionByName(copies)
    index = V.build(df, "key", "vec", f"{tmp_path}/i", list_rows=50)
    found = pairs(V.search(index, df, "key", "vec", 3, 64))
    assert found == pairs(R.similar_all(df, "key", "vec", 3))


def test_index_of_nulls_zeros_and_nothing(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (4, None), (5, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "key bigint, vec array<double>").selectExpr("*", "1 as cell", "2 as list", "3 as v")
    index = V.build(df, "key", "vec", f"{tmp_path}/a")
    found = pairs(V.search(index, df, "key", "vec", 1, 1))
    assert found == {(1, 2), (2, 5), (5, 2)} and V.probes_of(index, 1) == 1
    empty = V.build(df.limit(0), "key", "vec", f"{tmp_path}/b")
    assert empty.rows().count() == 0 and V.probes_of(empty, 3) == 1 and V.search(empty, df, "key", "vec", 2, 1).count() == 0


def test_nested_entries_keep_their_own_amounts(spark):
    nested = "<ul><li><h3>Set</h3> 900 cal<ul><li><h4>Soup</h4> 120 cal</li><li><h4>Roll</h4> 200 kcal</ul></li></ul>"
    table = '<div class="menu-item"><span class="item-name">Burger</span><table><tr><td>Calories: 650</td></tr><tr><td>30 g protein</td></tr></table><script>9 cal</script></div>'
    rows = "<table><tr><td class=name>Tea<td>5 cal<tr><td class=name>Cocoa<td>190 cal. Contains: milk &amp; <b>soy</b></table>"
    odd = "<li><h3>x</h3></li><![if x]><li><h3>Pie</h3> 300 cal"
    df = spark.createDataFrame([(1, nested), (2, table), (3, rows), (4, odd), (5, None), (6, ""), (None, table)], "page_id bigint, html string").selectExpr("*", "1 as name", "2 as t")
    got = {(r.page_id, r.name): (r.calories, r.protein) for r in menu_item_annotations(df).collect()}
    assert got == {
        (1, "set"): (900, None), (1, "soup"): (120, None), (1, "roll"): (200, None),
        (2, "burger"): (650, 30), (None, "burger"): (650, 30),
        (3, "tea"): (5, None), (3, "cocoa"): (190, None), (4, "pie"): (300, None),
    }
    deep = "<div class=dish>" * 3000 + "<h3>Deep</h3> 10 cal"
    assert entries_of_page(deep) == [("deep", "deep 10 cal")]
