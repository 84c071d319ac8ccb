"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``BITS`` bits each; the cell's place on the Hilbert
curve through that cube orders the rows, so that a run of the order is a compact region in all
dimensions at once. The order is cut into runs of equal row counts (law ``rows``: counts at most
one apart), and a reader prunes shards by the per-shard ranges of :func:`shard_ranges`.

Categories lie on their axis in the order of their frequency, each at the middle of its share of the
rows, so that halves of an axis hold about half of the rows; beyond the ``MAX_PLACED`` most frequent
ones values are dealt over the rest of the axis by their hash. Lengths are placed by quantile. These
statistics, over all rows, are all that the driver sees. Equal texts of one language and source share a
cell; ties on the curve are broken by the text's checksum and the key, which sorts them together there.

The order is made by a range partitioning of narrow rows (no texts). Rows are counted within each
range and the starts of the ranges, one number for each partition, come from the driver.

Defined results: a null text has size 1 and checksum 0; null metadata is a value of its own;
repeated rows each get a slot; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import keep, table, text_or_empty

BITS = 8
N_SHARDS = 8
MAX_PLACED = 255  # categories of an axis with a place of their own


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve index of each row of ``points`` (n rows, d coordinates of ``bits`` bits), after
    J. Skilling, "Programming the Hilbert curve" (2004): undo the excess rotations from the top
    bit down, Gray-encode, then interleave the bits.
    """
    x = np.array(points, dtype=np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def by_frequency(df: DataFrame, col: str, bits: int = BITS, placed: int = MAX_PLACED) -> Column:
    """Cell of a categorical value; null is a value of its own."""
    value = F.coalesce(F.col(col).cast("string"), F.lit("\0"))
    counts = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    cells, before = [], 0
    for r in counts.orderBy(F.desc("n"), "v").limit(placed).collect():
        cells += [F.lit(r.v), F.lit(((2 * before + r.n) << bits) // (2 * total))]
        before += r.n
    first = min((before << bits) // total, (1 << bits) - 1)
    rest = (F.pmod(F.xxhash64(value), F.lit((1 << bits) - first)) + first).cast("int")
    return F.coalesce(F.create_map(*cells)[value], rest).cast("int") if cells else rest


def by_quantile(df: DataFrame, value: Column, bits: int = BITS, edges: int = 63) -> Column:
    """Cell of a number by where it stands among all rows'; null counts as 0."""
    value = F.coalesce(value, F.lit(0))
    cuts = df.agg(F.percentile_approx(value, [(i + 1) / (edges + 1) for i in range(edges)], 1000).alias("q")).first().q or []
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)
    return (at * ((1 << bits) // (edges + 1))).cast("int")


DIMS = ["d_lang", "d_source", "d_length"]


def cells(docs: DataFrame) -> dict[str, Column]:
    """The axes of a table of documents."""
    return dict(zip(DIMS, (by_frequency(docs, "lang"), by_frequency(docs, "source"), by_quantile(docs, F.octet_length(text_or_empty("text"))))))


def with_curve(df: DataFrame, dims: list[Column], out: str = "curve", bits: int = BITS) -> DataFrame:
    n_dims = len(dims)

    @F.pandas_udf("bigint")
    def curve(cells: pd.Series) -> pd.Series:
        points = np.array(cells.tolist(), dtype=np.int64).reshape(len(cells), n_dims)
        return pd.Series(hilbert_index(points, bits))

    return df.withColumn(out, curve(F.array(*dims)))


def ranked(df: DataFrame, order: list[str], out: str = "place") -> tuple[DataFrame, int]:
    """``df`` with its 0-based place in ``order``, and the number of rows.

    Spark's own row ids count up within a sorted range, so one range partitioning is enough; the
    written table fixes them. They hold the range above bit 33.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt, _ = keep(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    in_range, at = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND((1 << 33) - 1)
    starts, total = [], 0
    for r in dealt.groupBy(in_range.alias("r")).count().orderBy("r").collect():  # one row a partition
        starts += [F.lit(r["r"]), F.lit(total)]
        total += r["count"]
    offset = F.element_at(F.create_map(*starts), in_range) if starts else F.lit(0)
    return dealt.withColumn(out, (at + offset).cast("bigint")).drop("_id"), total


def cut_rows(df: DataFrame, order: list[str], n_shards: int = N_SHARDS) -> DataFrame:
    """``df`` with shard and slot: runs of the order whose counts are at most one apart."""
    placed, n = ranked(df, order)
    n = max(n, 1)
    shard = F.expr(f"(place * {n_shards} + {n_shards - 1}) div {n}").cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * bigint({n})) div {n_shards}")
    return placed.withColumn("slot", (F.col("place") - first).cast("bigint")).drop("place")


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Least and greatest value of every dimension in each shard, for pruning."""
    aggs = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *aggs)


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> DataFrame:
    """Write ``docs``, every row once, in one folder a shard, each sorted by slot.

    Rows are carried through the sort, so repeated rows and null ids keep their places; columns named
    curve, text_crc32, shard, slot or like a dimension are replaced. Returns the ranges of each shard.
    """
    curved = with_curve(docs.drop("curve", "shard", "slot", "text_crc32", *DIMS).withColumns(cells(docs)), [F.col(d) for d in DIMS])
    text = text_or_empty("text")
    curved = curved.withColumn("text_crc32", F.crc32(text.cast("binary")))
    placed = cut_rows(curved, ["curve", "text_crc32", "doc_id"], n_shards)
    out = placed.drop("curve", "text_crc32")
    out.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return shard_ranges(placed, DIMS)


def prunable(ranges: DataFrame, dim: str, cell: Column) -> DataFrame:
    """The shards that cannot hold a cell of a dimension."""
    return ranges.where(~cell.between(F.col(f"min_{dim}"), F.col(f"max_{dim}"))).select("shard")


def hilbert_shards(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    text = text_or_empty("text")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[c.alias(name) for name, c in cells(docs).items()],
    )
    curved = with_curve(narrow, [F.col(d) for d in DIMS])
    return cut_rows(curved, ["curve", "text_crc32", "doc_id"], n_shards)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
