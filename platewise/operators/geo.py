"""Joins by distance over a grid whose crowded cells are cut by count."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.numbers import EARTH_MILES, haversine, round_half_up

MOST = 4096  # rows of either side that meet in one place
FINE = 32  # a crowded cell is cut into at most FINE x FINE squares
PER_PLACE = 16  # rows of one place hold at most about most / PER_PLACE ids
SALTS = 32  # copies of the crowded cells' cuts, so that their rows are looked up by many tasks


def geo_join(left: DataFrame, right: DataFrame, miles: float, out: str = "miles", most: int = MOST, digits: int | None = None) -> DataFrame:
    """Pairs of points at most ``miles`` apart, by a grid instead of all pairs.

    Both frames have id, lat and lng; the result has left_id, right_id and the distance, to ``digits`` if
    given (the test takes the whole distance). Rows of
    the grid are ``miles`` high. Within a row, columns are as wide as ``miles`` reach at the edge of
    the row nearest to a pole, so neighbours lie in the next cells; near the poles one cell spans
    the row. Each right point is in one cell and each left point looks into the nine around it, so
    no pair comes twice.

    A cell of over ``most`` right points is a quadtree: squares are quartered while they hold more,
    down to 1/32 of a cell, and a left point goes to those squares only that its reach touches. What is
    still too full (many points at one place, or many left points around a cell) is dealt by hash of
    the ids: a square with a parts of left points and b parts of right ones is a x b tasks' work, each of
    about ``most`` times ``most`` pairs. Copies of a point thus grow with the pairs to be tested, and
    ids should be distinct, since equal ones stay together. Points without a place meet nothing.
    Right points at one place are rows of up to about ``most`` / 16 ids there, so a distance is found once
    for all of them; the pairs that come out are as many as there are.

    One aggregate of both sides runs while the join is planned: without a crowded cell nothing is cut
    and the join has one shuffle a side.
    """
    step = math.degrees(miles / EARTH_MILES) * (1 + 1e-9)
    def row(lat):
        return F.floor(lat / step).cast("bigint")

    def columns(r):
        """Number of cells in a grid row: their width is the reach at the row's outer edge."""
        edge = F.least(F.greatest(F.abs(r * step), F.abs((r + 1) * step)) + step, F.lit(90.0))
        ratio = math.sin(math.radians(step)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
        width = F.when(ratio >= 1, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("bigint")

    def along(lng, n):
        """Place along a row of n cells, in cells."""
        return F.pmod(lng.cast("double") + 180, F.lit(360.0)) / 360 * n

    def col(lng, n):
        return F.least(F.floor(along(lng, n)).cast("bigint"), n - 1)

    def square(part):
        return F.greatest(F.least(F.floor(part * FINE), F.lit(FINE - 1)), F.lit(0)).cast("int")

    right = right.where("lat is not null and lng is not null").select(F.col("id").alias("right_id"), F.col("lat").cast("double").alias("rlat"), F.col("lng").cast("double").alias("rlng"))
    right = right.withColumn("grow", row(F.col("rlat")))
    n = columns(F.col("grow"))
    right = right.withColumn("gcol", col(F.col("rlng"), n))
    right = right.withColumn("x", square(along(F.col("rlng"), n) - F.col("gcol"))).withColumn("y", square(F.col("rlat") / step - F.col("grow")))

    left = left.where("lat is not null and lng is not null").select(F.col("id").alias("left_id"), F.col("lat").cast("double").alias("llat"), F.col("lng").cast("double").alias("llng"))
    r = row(F.col("llat"))
    left = left.withColumn("grow", F.explode(F.array(r - 1, r, r + 1))).withColumn("n", columns(F.col("grow")))
    left = left.withColumn("at", along(F.col("llng"), F.col("n"))).withColumn("home", col(F.col("llng"), F.col("n")))
    n, at, home = F.col("n"), F.col("at"), F.col("home")
    # where the row has two cells at most, both sides of a cell are the same one: all of it is in reach
    cells = F.array(*[F.struct(F.pmod(home + d, n).alias("gcol"), F.when(n >= 3, at - home - d).alias("u")) for d in (-1, 0, 1)])
    left = left.withColumn("c", F.explode(F.array_distinct(cells))).select("left_id", "llat", "llng", "grow", F.col("c.gcol").alias("gcol"), F.col("c.u").alias("u"))

    if not _crowded(right, left, most).limit(1).count():
        return _close(left, right, ["grow", "gcol"], miles, out, digits)
    right = _places(right, max(1, most // PER_PLACE))
    cuts = _cuts(right, left, most, F.size("right_ids"))
    here = ["grow", "gcol", "salt"]
    v = F.col("llat") / step - F.col("grow")
    reached = lambda p, low, size: ((p - 1) * FINE - 1e-6 < low + size) & ((p + 1) * FINE + 1e-6 >= low)
    touched = F.filter("squares", lambda s: reached(v, s["y"], s["side"]) & F.coalesce(reached(F.col("u"), s["x"], s["side"]), F.lit(True)))
    whole = F.array(F.struct(F.lit(-1).alias("sq"), F.lit(0).cast("bigint").alias("rp")))
    targets = F.flatten(F.transform(touched, lambda s: F.transform(F.sequence(F.lit(0).cast("bigint"), s["parts"] - 1), lambda p: F.struct((s["x"] * FINE + s["y"]).alias("sq"), p.alias("rp")))))
    left = left.withColumn("salt", F.pmod(F.xxhash64("left_id"), F.lit(SALTS))).join(cuts, here, "left")
    left = left.withColumn("lp", F.pmod(F.xxhash64("left_id", F.lit("l")), F.coalesce("lparts", F.lit(1)))).withColumn("t", F.explode(F.coalesce(targets, whole)))
    left = left.select("left_id", "llat", "llng", "grow", "gcol", "t.sq", "t.rp", "lp")

    mine = F.filter("squares", lambda s: F.col("x").between(s["x"], s["x"] + s["side"] - 1) & F.col("y").between(s["y"], s["y"] + s["side"] - 1))
    right = right.withColumn("salt", F.pmod(F.xxhash64("rlat", "rlng", "chunk"), F.lit(SALTS))).join(cuts, here, "left").withColumn("s", F.try_element_at(mine, F.lit(1)))
    right = right.withColumn("sq", F.coalesce(F.col("s.x") * FINE + F.col("s.y"), F.lit(-1))).withColumn("rp", F.pmod(F.xxhash64("rlat", "rlng", "chunk", F.lit("r")), F.coalesce("s.parts", F.lit(1))))
    right = right.withColumn("lp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("lparts", F.lit(1)) - 1)))
    right = right.select("right_ids", "rlat", "rlng", "grow", "gcol", "sq", "rp", "lp")

    near = _close(left, right, ["grow", "gcol", "sq", "rp", "lp"], miles, out, digits)
    return near.select("left_id", F.explode("right_ids").alias("right_id"), out)


def _close(left: DataFrame, right: DataFrame, place: list[str], miles: float, out: str, digits: int | None) -> DataFrame:
    both = left.join(right, place).withColumn(out, haversine("llat", "llng", "rlat", "rlng")).where(F.col(out) <= miles)
    ids = "right_ids" if "right_ids" in right.columns else "right_id"
    return both.select("left_id", ids, out if digits is None else round_half_up(out, digits).alias(out))


def _places(right: DataFrame, per: int) -> DataFrame:
    """The right points as rows of a place: (..., rlat, rlng, chunk, right_ids), about ``per`` ids at most in each."""
    at = ["rlat", "rlng"]
    full = right.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / per).cast("bigint").alias("chunks")).where("chunks > 1")
    chunk = F.pmod(F.xxhash64("right_id"), F.coalesce("chunks", F.lit(1)))
    rows = right.join(full, at, "left").withColumn("chunk", chunk)
    return rows.groupBy("grow", "gcol", "x", "y", *at, "chunk").agg(F.collect_list("right_id").alias("right_ids"))


def _crowded(right: DataFrame, left: DataFrame, most: int) -> DataFrame:
    """Cells of more than ``most`` points of either side."""
    sides = [df.groupBy("grow", "gcol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most) for df in (right, left)]
    return sides[0].unionByName(sides[1])


def _cuts(right: DataFrame, left: DataFrame, most: int, points: Column | None = None) -> DataFrame:
    """The crowded cells: (grow, gcol, salt, squares, lparts), one row for each salt; ``points`` is how many a right row holds.

    ``squares`` (x, y, side in 1/32 of a cell, parts of right points) cover every right point of the cell;
    ``lparts`` is the number of parts of the left points. There are at most 4 times as many squares as
    right rows / ``most``, or 1,024 a cell.
    """
    cell = Window.partitionBy("grow", "gcol")
    fine = right.groupBy("grow", "gcol", "x", "y").agg(F.sum(F.lit(1) if points is None else points).alias("n"))
    fine = fine.withColumn("all", F.sum("n").over(cell)).where(F.col("all") > most)
    side, held = F.lit(FINE), F.col("all")
    size = FINE // 2
    while size:
        low = lambda c: F.col(c) - F.col(c) % size  # noqa: E731, B023
        fine = fine.withColumn(f"n{size}", F.sum("n").over(Window.partitionBy("grow", "gcol", low("x"), low("y"))))
        full = held > most
        side, held = F.when(full, F.lit(size)).otherwise(side), F.when(full, F.col(f"n{size}")).otherwise(held)
        size //= 2
    fine = fine.select("grow", "gcol", (F.col("x") - F.col("x") % side).alias("x"), (F.col("y") - F.col("y") % side).alias("y"), side.alias("side"), F.ceil(held / most).cast("bigint").alias("parts"))
    squares = fine.groupBy("grow", "gcol").agg(F.collect_set(F.struct("x", "y", "side", "parts")).alias("squares"))
    crowds = left.groupBy("grow", "gcol").agg(F.ceil(F.count(F.lit(1)) / most).cast("bigint").alias("lparts")).where("lparts > 1")
    one = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(FINE).alias("side"), F.lit(1).cast("bigint").alias("parts")))
    cuts = squares.join(crowds, ["grow", "gcol"], "full_outer").select("grow", "gcol", F.coalesce("squares", one).alias("squares"), F.coalesce("lparts", F.lit(1).cast("bigint")).alias("lparts"))
    return cuts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
