"""Nearest neighbours over a stored inverted file of two levels.

Level 1 parts the vectors into at most ``MAX_CELLS`` cells, by centres fitted on a bounded sample. Each cell
is parted again into lists of about ``list_rows`` rows, by centres that one task fits on a bounded sample
of that cell. So the number of lists grows with the table, up to ``MAX_CELLS`` x ``MAX_LISTS``, and the rows
that a query meets do not. The rows lie in folders by cell, sorted by list inside; :func:`add` places new ones by the
centres that are there.

A query looks into the nearest lists of the nearest cells, as many of both as :func:`probes_of` finds to be
needed: it compares the index with an exact search of all rows for a sample of queries. For a search the rows of
each cell and the queries lie in blocks of about ``BLOCK_ROWS`` in the shared folder, once each, and meet there; none are left out,
and no vector is sent to the cells or lists that it is sought in.

Defined results: rows with a null key or vector are not indexed and find nothing; keys must be unique, and a key that is
stored is not added again; vectors of zeros have similarity 0 with all; an empty table gives an empty index, to which
nothing can be added; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.operators import blocks as B
from platewise.operators.rank import FOUND, _Nearest, _packed, _units, centres_of, nearest_centres, sought_lists, top_k_per_group
from platewise.operators.rank import _search_blocks as _search_all

LIST_ROWS = 1000
MAX_CELLS = 1024
MAX_LISTS = 1024  # of one cell
SAMPLE = 20_000
PER_LIST = 10  # rows of a cell's sample for each of its lists
TASK_ROWS = 4096  # rows of a cell that are placed at a time
BLOCK_ROWS = 4096
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


class Index(NamedTuple):
    """Where the index lies, and the level 1 centres (a row a cell)."""

    spark: SparkSession
    path: str
    cells: np.ndarray

    def rows(self) -> DataFrame:
        """(id, v, cell, list) of every indexed row."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def lists(self) -> DataFrame:
        """(cell, list, centre)."""
        return self.spark.read.parquet(f"{self.path}/lists")


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")


def _with_cells(rows: DataFrame, cells: np.ndarray, n: int = 1) -> DataFrame:
    """``rows`` with an array of their ``n`` nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # at most MAX_CELLS rows

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(nearest_centres(v, shared.value, n))

    return rows.withColumn("cells", nearest("v"))


def _with_lists(rows: DataFrame, lists: DataFrame, n: int = 1) -> DataFrame:
    """``rows`` (id, v, cell) once for each of the ``n`` nearest lists of their cell; cells with many rows are dealt by salt."""
    salts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("salts"))
    salts = F.broadcast(salts)  # a row a cell
    kind = rows.schema["v"].dataType.simpleString()

    def place(rows: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or lists.empty:
            return rows.iloc[:0][["id", "v", "cell"]].assign(lists=pd.Series(dtype=object))
        lists = lists.sort_values("list")
        which = lists["list"].to_numpy()
        found = nearest_centres(rows["v"], np.stack(lists["centre"].to_numpy()), n)
        return rows[["id", "v", "cell"]].assign(lists=[which[x] for x in found])

    rows = rows.join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    every = lists.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    by = ["cell", "salt"]
    placed = rows.select("id", "v", *by).groupBy(*by).cogroup(every.select("list", "centre", *by).groupBy(*by)).applyInPandas(place, f"id bigint, v {kind}, cell int, lists array<int>")
    # a vector leaves Python once, whatever the number of its lists
    return placed.select("id", "v", "cell", F.explode("lists").alias("list"))


def build(df: DataFrame, key: str, vector: str, path: str, list_rows: int = LIST_ROWS, max_sample: int = SAMPLE) -> Index:
    """Index every row of ``df`` into the folder ``path``, which must be new."""
    spark, rows = df.sparkSession, _rows(df, key, vector)
    n = rows.count()
    n_cells = min(MAX_CELLS, max(1, round(math.sqrt(n / list_rows))))
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("v").collect()]
    cells = centres_of(_units(pd.Series(sample)), n_cells) if sample else np.zeros((0, 0))
    placed = _with_cells(rows, cells).select("id", "v", F.col("cells")[0].alias("cell"))

    # a bounded sample of each cell: first by a share of the hashes, then exactly
    n_lists = F.least(F.lit(MAX_LISTS), F.ceil(F.col("n") / list_rows)).cast("int")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("n_lists", n_lists)
    some = placed.join(F.broadcast(sizes), "cell").withColumn("h", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)))
    some = some.where(F.col("h") < F.col("n_lists") * (2 * PER_LIST * float(1 << 30)) / F.col("n"))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("h", "id"))).where(F.col("place") <= PER_LIST * F.col("n_lists"))

    def fit(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        c = centres_of(_units(pdf["v"]), int(pdf["n_lists"].iloc[0]))
        return pd.DataFrame({"cell": at[0], "list": np.arange(len(c)), "centre": c.tolist()})

    lists = some.select("cell", "v", "n_lists", "place").groupBy("cell").applyInPandas(fit, "cell int, list int, centre array<double>")
    # a cell whose hashes all missed the share has its level 1 centre as its only list
    own = spark.createDataFrame([(i, 0, c.tolist()) for i, c in enumerate(cells)], "cell int, list int, centre array<double>")
    bare = own.join(lists.select("cell").distinct(), "cell", "left_anti")
    lists.unionByName(bare).write.parquet(f"{path}/lists")
    index = Index(spark, path, cells)
    _with_lists(placed, index.lists()).sortWithinPartitions("cell", "list", "id").write.partitionBy("cell").parquet(f"{path}/rows")
    if not n:  # no folder of a cell, so no schema to read
        placed.limit(0).withColumn("list", F.lit(0)).write.mode("overwrite").parquet(f"{path}/rows")
    own.write.parquet(f"{path}/cells")
    return index


def load(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").select("centre").collect()  # at most MAX_CELLS
    return Index(spark, path, np.array([r.centre for r in cells]))


def add(index: Index, df: DataFrame, key: str, vector: str) -> None:
    """Place new rows by the centres of the index; keys that are stored already stay as they are."""
    if not len(index.cells):
        raise ValueError("an index of an empty table has no centres")
    rows = _rows(df, key, vector).dropDuplicates(["id"]).join(index.rows().select("id"), "id", "left_anti")
    placed = _with_cells(rows, index.cells).select("id", "v", F.col("cells")[0].alias("cell"))
    _with_lists(placed, index.lists()).sortWithinPartitions("cell", "list", "id").write.mode("append").partitionBy("cell").parquet(f"{index.path}/rows")


class _NearestInCells(_Nearest):
    """The nearest rows so far of each query of a block, among the lists that it is sought in."""

    def __init__(self, row: dict, kind: type, k: int):
        super().__init__(row, kind, k)
        self.cells = np.frombuffer(row["l_cells"].as_buffer(), np.int32).reshape(len(self.ids), -1)
        self.probes = row["probes"].as_py()

    def meet(self, row: dict) -> None:
        mine = np.flatnonzero((self.cells == row["cell"].as_py()).any(1))
        if not len(mine):
            return
        ids, v = self.vectors(row, "r")
        centres = np.frombuffer(row["r_centres"].as_buffer()).reshape(-1, v.shape[1])
        homes = np.frombuffer(row["r_homes"].as_buffer(), np.int32)
        sought = sought_lists(self.v[mine], centres, self.probes)
        for home in np.unique(homes):
            of = homes == home
            self.seek(mine[sought[:, home]], v[of], ids[of])


def _kind(df: DataFrame, vector: str) -> type:
    return np.float32 if df.schema[vector].dataType.simpleString() == "array<float>" else np.float64


def _numbers(df: DataFrame, vector: str) -> DataFrame:
    """Vectors of other numbers than floats as doubles."""
    return df if _kind(df, vector) == np.float32 else df.withColumn(vector, F.col(vector).cast("array<double>"))


def blocks(index: Index) -> DataFrame:
    """The rows of the index, packed into blocks of a cell with the centres of its lists."""
    rows = _numbers(index.rows(), "v")
    kind = _kind(rows, "v")
    parts = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")))  # a row a cell
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int"))
    every = index.lists().join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def pack(rows: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or lists.empty:
            return pd.DataFrame({"cell": [], "ids": [], "v": [], "homes": [], "centres": []})
        lists = lists.sort_values("list")
        homes = np.searchsorted(lists["list"].to_numpy(), rows["list"].to_numpy()).astype(np.int32)
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], **_packed(rows, kind), "homes": [homes.tobytes()], "centres": [np.stack(lists["centre"].to_numpy()).astype(float).tobytes()]})

    by = ["cell", "part"]
    packed = dealt.select("id", "v", "list", *by).groupBy(*by).cogroup(every.select("list", "centre", *by).groupBy(*by))
    return B.stored(packed.applyInPandas(pack, "cell int, ids array<bigint>, v binary, homes binary, centres binary"), "cells")


def _search_blocks(left: DataFrame, right: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` of each query: ``left`` has qid, qv, cells and probes, and a block for each value of ``by``; ``right`` is that of :func:`blocks`."""
    left = _numbers(left, "qv")
    kind = _kind(left, "qv")

    def pack(at: tuple, f: pd.DataFrame) -> pd.DataFrame:
        cells = np.stack(f["cells"].to_numpy()).astype(np.int32)
        more = {"cells": [cells.tobytes()], "asked": [np.unique(cells).tolist()], "probes": [f["probes"].iloc[0]]}
        return pd.DataFrame({"block": [" ".join(map(str, at))], **_packed(f.rename(columns={"qid": "id", "qv": "v"}), kind), **more})

    packed = left.groupBy(*by).applyInPandas(pack, "block string, ids array<bigint>, v binary, cells binary, asked array<int>, probes int")
    queries = B.stored(packed, "queries").select("block", "asked", "probes", *[F.col(c).alias(f"l_{c}") for c in ("ids", "v", "cells")])
    rows = right.select("cell", *[F.col(c).alias(f"r_{c}") for c in ("ids", "v", "homes", "centres")])
    met = B.meet(queries, rows, lambda row: _NearestInCells(row, kind, k), FOUND, F.array_contains("asked", F.col("cell")))
    return top_k_per_group(met, ["id"], [F.round("similarity", 9).desc(), F.asc("near")], k)


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int, probes: int, held: DataFrame | None = None) -> DataFrame:
    """(id, near, similarity): the ``k`` nearest indexed rows, but itself, of every query, by cosine.

    A query looks into the ``probes`` nearest lists of each of its ``probes`` nearest cells. ``held`` is :func:`blocks` of the index, if there already.
    """
    if not len(index.cells):
        return index.spark.createDataFrame([], FOUND)
    rows = _rows(queries, key, vector)
    # a block holds the queries of neighbouring cells
    runs = max(1, min(len(index.cells), -(-rows.count() // BLOCK_ROWS)))
    asked = _with_cells(rows, index.cells, probes).withColumn("run", F.floor(F.col("cells")[0] * runs / len(index.cells)).cast("int"))
    crowds = F.broadcast(asked.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("crowds")))  # at most a row a cell
    asked = asked.join(crowds, "run").withColumn("x", F.pmod(F.xxhash64("id", F.lit(1)), F.col("crowds")).cast("int"))
    left = asked.select(F.col("id").alias("qid"), F.col("v").alias("qv"), "cells", F.lit(probes).alias("probes"), "run", "x")
    return _search_blocks(left, held or blocks(index), ["run", "x"], k)


def probes_of(index: Index, k: int, recall: float = 0.95, queries: int = 200) -> int:
    """The least of ``STEPS`` with which the index finds the share ``recall`` of the exact neighbours of a sample of rows."""
    rows = index.rows()
    sample = [(r.id, list(r.v)) for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(queries).select("id", "v").collect()]
    if not sample:
        return 1
    asked = index.spark.createDataFrame(sample, "id bigint, v array<double>")
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    left = asked.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y"))
    right = rows.select(F.col("id").alias("rid"), F.col("v").cast("array<double>").alias("rv"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("y"))
    exact = {(r.id, r.near) for r in _search_all(left, right, ["y"], k).collect()}  # queries x k
    held = blocks(index)
    for p in STEPS:
        found = {(r.id, r.near) for r in search(index, asked, "id", "v", k, p, held).select("id", "near").collect()}
        if len(exact & found) >= recall * len(exact) or p >= max(len(index.cells), MAX_LISTS):
            return p
    return STEPS[-1]
