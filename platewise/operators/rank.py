"""Scores, orders, top-k, diversity caps, pages and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from platewise.functions.numbers import cosine_to, haversine
from platewise.operators import blocks as B


def goal_order(df: DataFrame, goal: str | None, limit: int) -> DataFrame:
    """The fetch order of a goal: nulls first when descending, last when ascending; ties by id."""
    orders = {
        "max_protein": F.desc_nulls_first("protein_max"),
        "glp1_friendly": F.desc_nulls_first("protein_max"),
        "min_calories": F.asc_nulls_last("calories_min"),
        "min_fat": F.asc_nulls_last("fat_min"),
        "min_carbs": F.asc_nulls_last("carbs_min"),
    }
    return df.orderBy(orders.get(goal, F.desc_nulls_first("dish_id")), "dish_id").limit(max(limit, 100))


def macro_match_score(goal: str) -> Column:
    """How well a dish serves a nutrition goal; higher is better."""

    def left_of(c, top):
        return F.when(F.col(c).isNotNull(), F.lit(float(top)) - F.col(c)).otherwise(0.0)

    if goal == "max_protein":
        return F.coalesce("protein_max", F.lit(0.0))
    if goal in ("min_calories", "min_fat", "min_carbs"):
        return left_of(*{"min_calories": ("calories_min", 2000), "min_fat": ("fat_min", 100), "min_carbs": ("carbs_min", 200)}[goal])
    if goal == "glp1_friendly":
        protein = F.least(F.coalesce("protein_min", F.lit(0.0)) / 50, F.lit(1.0))
        light = F.greatest(F.lit(0.0), 1 - (F.coalesce(F.col("calories_max").cast("double"), F.lit(800.0)) - 200) / 600)
        return protein * 0.6 + light * 0.4
    if goal == "balanced":
        energy = [F.coalesce(c, F.lit(d)) * k for c, d, k in (("protein_max", 25.0, 4), ("carbs_max", 45.0, 4), ("fat_max", 20.0, 9))]
        total = energy[0] + energy[1] + energy[2]
        total = F.when(total == 0, 1.0).otherwise(total)
        off = [F.abs(e / total - share) for e, share in zip(energy, (0.3, 0.4, 0.3))]
        return (1 - (off[0] + off[1] + off[2])) * F.coalesce(F.col("calories_min").cast("double"), F.lit(500.0))
    return F.lit(0.0)


def relevance(rank: Column | None = None) -> Column:
    """Best match from rating, nearness, reviews, macro confidence and photo; with a text rank, that too."""
    rating = F.coalesce("average_rating", F.lit(0.0)) / 5
    near = 1 / (1 + F.coalesce("distance", F.lit(10.0)))
    reviewed = F.when(F.col("average_rating").isNotNull(), 1.0).otherwise(0.0)
    sure = F.coalesce("macro_confidence", F.lit(0.0))
    photo = F.when(F.col("photo_id").isNotNull(), 1.0).otherwise(0.0)
    plain = rating * 0.35 + near * 0.25 + reviewed * 0.15 + sure * 0.15 + photo * 0.10
    if rank is None:
        return plain
    texted = F.least(rank, F.lit(1.0)) * 0.30 + rating * 0.25 + near * 0.20 + reviewed * 0.10 + sure * 0.10 + photo * 0.05
    return F.when(F.coalesce(rank, F.lit(0.0)) > 0, texted).otherwise(plain)


def sort_key(mode: str | None, goal: str | None = None) -> list[Column]:
    """Sort columns with the stand-ins for missing values; ties by id."""
    key = {
        "rating": F.coalesce("average_rating", F.lit(-1.0)).desc(),
        "distance": F.coalesce("distance", F.lit(float("inf"))).asc(),
        "wait_time": F.coalesce(F.col("wait").cast("double"), F.lit(float("inf"))).asc(),
    }.get(mode)
    if mode == "macro_match" and goal:
        key = macro_match_score(goal).desc()
    return [key if key is not None else F.col("score").desc(), F.asc("dish_id")]


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_k_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes groups before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def diversity_cap(df: DataFrame, order: list, caps: list[tuple[str, int]], check_nested: bool = True) -> DataFrame:
    """Keep, in the given order, at most so many rows of each key.

    Exact as one filter after another if each key's groups lie within the next key's groups, as
    restaurants lie within cuisines; other keys are refused.
    """
    for (inner, _), (outer, _) in zip(caps, caps[1:]):
        if check_nested and df.groupBy(inner).agg(F.count_distinct(F.coalesce(F.col(outer).cast("string"), F.lit("")) ).alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"{inner} does not lie within {outer}; a cap by filters would not be exact")
    for key, n in caps:
        df = top_k_per_group(df, [key], order, n, "_rank").drop("_rank")
    return df


def shelves(df: DataFrame, k: int = 8) -> DataFrame:
    """The home shelves: best rated and most protein."""
    tops = {
        "top_rated": [F.col("average_rating").desc_nulls_last(), F.asc("dish_id")],
        "high_protein": [((F.col("protein_min") + F.col("protein_max")) / 2).desc_nulls_last(), F.asc("dish_id")],
    }
    frames = [df.orderBy(*o).limit(k).withColumn("shelf", F.lit(s)) for s, o in tops.items()]
    return frames[0].unionByName(frames[1])


def similar(df: DataFrame, source: dict, vector: str = "vec", min_similarity: float = 0.85, n: int | None = 10, boosts: bool = False, miles: float | None = None) -> DataFrame:
    """Nearest rows to one source vector, of other restaurants; optional boosts for category and cuisine.

    Without ``n`` all rows that are alike enough, in no order.

    ``source`` has vec, restaurant_id and, for boosts, category and cuisine, for a radius lat and lng: one
    row's plain values. Rows without a place are in reach.
    """
    sim = cosine_to(F.col(vector), [float(v) for v in source["vec"]])
    if boosts:
        sim = sim + F.when(F.col("category") == source.get("category"), 0.05).otherwise(0.0)
        sim = sim + F.when(F.col("cuisine") == source.get("cuisine"), 0.03).otherwise(0.0)
    df = df.where(F.col("restaurant_id") != source["restaurant_id"])
    if miles is not None:
        far = haversine("lat", "lng", F.lit(source["lat"]), F.lit(source["lng"]))
        df = df.where(far.isNull() | (far <= miles))
    # exploded, so that the threshold is not moved below and the vector's terms are not written out for each use
    out = df.withColumn("similarity", F.explode(F.array(sim))).where(F.col("similarity") > min_similarity)
    return out if n is None else out.orderBy(F.col("similarity").desc(), "dish_id").limit(n)


SLICE = 256  # rows of a block whose similarities are held at a time


def _best(p: np.ndarray, q: np.ndarray, pid: np.ndarray, qid: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest of ``q`` for every row of ``p``, by similarity to nine digits and then by id."""
    return pd.concat([_best_few(p[i : i + SLICE], q, pid[i : i + SLICE], qid, k) for i in range(0, len(p), SLICE)], ignore_index=True)


def _best_few(p: np.ndarray, q: np.ndarray, pid: np.ndarray, qid: np.ndarray, k: int) -> pd.DataFrame:
    value, near = _top(p, q, pid, qid, k)
    row, place = np.nonzero(value > -2)
    return pd.DataFrame({"id": pid[row], "near": near[row, place], "similarity": value[row, place]})


def _top(p: np.ndarray, q: np.ndarray, pid: np.ndarray, qid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and ids of the ``k`` nearest of ``q``, a row for each of ``p``; -2 where there are fewer."""
    values, nears = np.full((len(p), k), -2.0), np.zeros((len(p), k), qid.dtype)
    s = p @ q.T
    s[pid[:, None] == qid[None, :]] = -2
    most = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
    row, col = np.nonzero(s >= least[:, None] - 1e-9)
    value, near = s[row, col], qid[col]
    order = np.lexsort((near, -np.round(value, 9), row))
    row, value, near = row[order], value[order], near[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)  # from where a row's candidates begin
    keep = (place < most) & (value > -2)
    values[row[keep], place[keep]], nears[row[keep], place[keep]] = value[keep], near[keep]
    return values, nears


def _unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _units(vectors: pd.Series) -> np.ndarray:
    return _unit_rows(np.stack(vectors.to_numpy()))


FOUND = "id bigint, near bigint, similarity double"


def _search_blocks(pairs_left: DataFrame, pairs_right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Multiply blocks of queries (qid, qv) with blocks of rows (rid, rv) of equal keys; the best k of each query."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "near": [], "similarity": []})
        return _best(_units(a["qv"]), _units(b["rv"]), a["qid"].to_numpy(), b["rid"].to_numpy(), k)

    found = pairs_left.groupBy(*keys).cogroup(pairs_right.groupBy(*keys)).applyInPandas(best, FOUND)
    return top_k_per_group(found, ["id"], [F.round("similarity", 9).desc(), F.asc("near")], k)


class _Nearest:
    """The ``k`` nearest rows so far of each vector of a block."""

    def __init__(self, row: dict, kind: type, k: int):
        self.k = k
        self.ids, self.v = self.vectors(row, "l", kind)
        self.value, self.near = np.full((len(self.ids), k), -2.0), np.zeros((len(self.ids), k), self.ids.dtype)

    def vectors(self, row: dict, x: str, kind: type | None = None) -> tuple[np.ndarray, np.ndarray]:
        ids, numbers = row[f"{x}_ids"].values.to_numpy(zero_copy_only=False), row[f"{x}_v"].as_buffer()
        kind = kind or {4: np.float32, 8: np.float64}[numbers.size // (len(ids) * self.v.shape[1])]  # vectors are of one length
        return ids, _unit_rows(np.frombuffer(numbers, kind).reshape(len(ids), -1).astype(float))

    def meet(self, row: dict) -> None:
        ids, v = self.vectors(row, "r")
        self.seek(np.arange(len(self.ids)), v, ids)

    def seek(self, rows: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        for i in range(0, len(rows), SLICE):
            at = rows[i : i + SLICE]
            value, near = _top(self.v[at], v, self.ids[at], ids, self.k)
            value, near = np.hstack([self.value[at], value]), np.hstack([self.near[at], near])
            order = np.lexsort((near, -np.round(value, 9)), axis=1)[:, : self.k]
            if near.dtype != self.near.dtype:  # an id is missing
                self.near = self.near.astype(near.dtype)
            self.value[at], self.near[at] = np.take_along_axis(value, order, 1), np.take_along_axis(near, order, 1)

    def found(self):
        row, place = np.nonzero(self.value > -2)
        ids = lambda x: pa.array(x, pa.int64(), from_pandas=True)
        yield pa.RecordBatch.from_pydict({"id": ids(self.ids[row]), "near": ids(self.near[row, place]), "similarity": self.value[row, place]})


def _vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, type]:
    """(id, v) of the rows that have a vector, and what numpy calls its numbers."""
    single = isinstance(df.schema[vector].dataType.elementType, FloatType)
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), v.alias("v")), np.float32 if single else np.float64


def _packed(f: pd.DataFrame, kind: type) -> dict:
    ids = [None if pd.isna(i) else int(i) for i in f["id"]]
    return {"ids": [ids], "v": [np.stack(f["v"].to_numpy()).astype(kind).tobytes()]}


def similar_all(df: DataFrame, key: str, vector: str, k: int, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest neighbours of every row by cosine, exact.

    The vectors are dealt into blocks that lie in the shared folder. Every block of queries is multiplied with every block of rows by
    numpy, and a task keeps the best k of each query. The work is all pairs, as an exact answer needs; a vector is
    written once, and memory is that of two blocks. For large tables take :func:`similar_by_lists`.
    """
    n = max(1, -(-df.count() // block_rows))
    rows, kind = _vectors(df, key, vector)

    def pack(at: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [at[0]], **_packed(f, kind)})

    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    blocks = B.stored(rows.groupBy(block.alias("block")).applyInPandas(pack, "block int, ids array<bigint>, v binary"), "vectors")
    left = blocks.select("block", F.col("ids").alias("l_ids"), F.col("v").alias("l_v"))
    right = blocks.select(F.col("ids").alias("r_ids"), F.col("v").alias("r_v"))
    found = B.meet(left, right, lambda row: _Nearest(row, kind, k), FOUND)
    return top_k_per_group(found, ["id"], [F.round("similarity", 9).desc(), F.asc("near")], k)


def centres_of(v: np.ndarray, n: int, steps: int = 10, seed: int = 0) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    c = v[np.random.default_rng(seed).permutation(len(v))[:n]]
    for _ in range(steps):
        at = (v @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def probes_for(v: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 500) -> int:
    """How many lists hold the share ``recall`` of the ``k`` nearest rows, on a sample."""
    home = (v @ centres.T).argmax(1)
    q = v[:queries]
    s = q @ v.T
    s[np.arange(len(q)), np.arange(len(q))] = -2
    k = min(k, len(v) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # of each list for each query
    needed = np.take_along_axis(place, home[near], 1).ravel()
    return int(np.quantile(needed, recall, method="higher")) + 1


def nearest_centres(v: pd.Series, centres: np.ndarray, n: int) -> list[np.ndarray]:
    """The ``n`` nearest centres of each vector, nearest first; the similarities of ``SLICE`` vectors are held at a time."""
    parts = (_units(v.iloc[i : i + SLICE]) @ centres.T for i in range(0, len(v), SLICE))
    return [row for s in parts for row in np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)]


def sought_lists(units: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Whether each of the centres is among the ``n`` nearest of each vector."""
    out = np.zeros((len(units), len(centres)), bool)
    for i in range(0, len(units), SLICE):
        near = np.argsort(-(units[i : i + SLICE] @ centres.T), axis=1, kind="stable")[:, :n]
        np.put_along_axis(out[i : i + SLICE], near, True, axis=1)
    return out


class _NearestInLists(_Nearest):
    """The same among the lists that each vector is sought in."""

    def __init__(self, row: dict, kind: type, k: int):
        super().__init__(row, kind, k)
        bits = np.frombuffer(row["l_sought"].as_buffer(), np.uint8).reshape(len(self.ids), -1)
        self.sought = np.unpackbits(bits, axis=1).astype(bool)

    def meet(self, row: dict) -> None:
        ids, v = self.vectors(row, "r")
        homes = np.frombuffer(row["r_homes"].as_buffer(), np.int32)
        for home in np.unique(homes):
            of = homes == home
            self.seek(np.flatnonzero(self.sought[:, home]), v[of], ids[of])


def similar_by_lists(df: DataFrame, key: str, vector: str, k: int, n_lists: int | None = None, recall: float = 0.95, max_sample: int = 20_000, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest neighbours of every row by cosine, by an inverted file: approximate.

    Centres are fitted on at most ``max_sample`` rows (those of the least hash); every row is in the list
    of its nearest centre and is sought in as many of the nearest lists as hold the share ``recall`` of the
    neighbours within that sample: few where vectors cluster, most where they are random. Blocks of at most about
    ``block_rows`` rows of lists that follow each other lie in the shared folder, once, and blocks meet where a row of one is sought
    in a list of the other; a hot list is many blocks.
    """
    rows, kind = _vectors(df, key, vector)
    n = rows.count()
    n_lists = n_lists or int(min(1024, max(1, n**0.5)))
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("v").collect()]
    if not sample:
        return df.sparkSession.createDataFrame([], FOUND)
    sample = _units(pd.Series([np.array(v, float) for v in sample]))
    found = centres_of(sample, n_lists)
    probes = min(len(found), probes_for(sample, found, k, recall))
    centres = df.sparkSession.sparkContext.broadcast(found)
    runs = min(len(found), -(-n // block_rows))

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series([x[0] for x in nearest_centres(v, centres.value, 1)], dtype="int32")

    def pack(at: tuple, f: pd.DataFrame) -> pd.DataFrame:
        sought = sought_lists(_units(f["v"]), centres.value, probes)
        held, asked = np.unique(f["home"]), np.flatnonzero(sought.any(0))
        more = {"homes": [f["home"].to_numpy(np.int32).tobytes()], "held": [held.tolist()], "sought": [np.packbits(sought, axis=1).tobytes()], "asked": [asked.tolist()]}
        return pd.DataFrame({"block": [f"{at[0]} {at[1]}"], **_packed(f, kind), **more})

    placed = rows.withColumn("home", home("v")).withColumn("run", F.floor(F.col("home") * runs / len(found)).cast("int"))
    sizes = placed.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "run").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row a run: 1024 at most
    schema = "block string, ids array<bigint>, v binary, homes binary, held array<int>, sought binary, asked array<int>"
    blocks = B.stored(dealt.select("id", "v", "home", "run", "part").groupBy("run", "part").applyInPandas(pack, schema), "lists")
    left = blocks.select("block", "asked", *[F.col(c).alias(f"l_{c}") for c in ("ids", "v", "sought")])
    right = blocks.select("held", *[F.col(c).alias(f"r_{c}") for c in ("ids", "v", "homes")])
    met = B.meet(left, right, lambda row: _NearestInLists(row, kind, k), FOUND, F.arrays_overlap("asked", "held"))
    return top_k_per_group(met, ["id"], [F.round("similarity", 9).desc(), F.asc("near")], k)
