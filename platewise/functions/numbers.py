"""Numeric column functions: rounding, geography, macro vectors, waits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3959.0
# Means and deviations of the four macros.
MACRO_STATS = {"calories": (500.0, 250.0), "protein": (25.0, 15.0), "carbs": (45.0, 30.0), "fat": (20.0, 15.0)}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def round_half_up(x, digits: int = 0) -> Column:
    """Round halves towards plus infinity."""
    scale = 10**digits
    return F.floor(_c(x) * scale + 0.5) / scale


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle miles, unrounded."""
    lat1, lng1, lat2, lng2 = (F.radians(_c(v).cast("double")) for v in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def haversine_sql(lat1, lng1, lat2, lng2) -> str:
    h = (
        f"power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin((radians({lng2}) - radians({lng1})) / 2), 2)"
    )
    return f"({2 * EARTH_MILES} * asin(sqrt(least({h}, 1.0))))"


def travel_minutes(miles, mph: float) -> Column:
    """Whole minutes at a speed, one at least."""
    return F.greatest(round_half_up(_c(miles) / mph * 60), F.lit(1)).cast("int")


def wait_minutes(busyness) -> Column:
    """Piecewise linear: corners at 30, 50, 70, 85 and 100 percent are 5, 15, 25, 40 and 60 minutes."""
    b = _c(busyness).cast("double")
    corners = [(0, 0), (30, 5), (50, 15), (70, 25), (85, 40), (100, 60)]
    out = None
    for (x0, y0), (x1, y1) in zip(corners, corners[1:]):
        line = F.lit(y0) + (b - x0) / (x1 - x0) * (y1 - y0)
        last = x1 == 100
        out = F.when(b <= x1, line) if out is None else out.otherwise(line) if last else out.when(b <= x1, line)
    return round_half_up(out).cast("int")


def macro_vector(calories, protein, carbs, fat, zero_is_null: bool = True) -> Column:
    """Unit vector of the macros' z-scores; null without calories."""
    z = [(F.coalesce(_c(v).cast("double"), F.lit(0.0)) - m) / s for v, (m, s) in zip((calories, protein, carbs, fat), MACRO_STATS.values())]
    norm = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))
    unit = F.array(*[x / norm for x in z])
    empty = F.lit(None).cast("array<double>") if zero_is_null else F.array(*[F.lit(0.0)] * 4)
    return F.when(_c(calories).isNull(), F.lit(None).cast("array<double>")).when(norm == 0, empty).otherwise(unit)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def cosine_to(a, vector: list[float]) -> Column:
    """Cosine similarity to a vector of plain values, without a lambda a row; 0 where a norm is 0, null for another length."""
    a, size = _c(a), math.sqrt(sum(v * v for v in vector))
    at = [F.get(a, i).cast("double") for i in range(len(vector))]
    total = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0.0)
    norm = F.sqrt(total([x * x for x in at])) * F.lit(size)
    near = F.when(norm == 0, F.lit(0.0)).otherwise(total([x * F.lit(v) for x, v in zip(at, vector)]) / norm)
    return F.when(F.size(a) == len(vector), near)


def macro_range(value, confidence) -> Column:
    """Uncertainty around an estimate: 20 % above .8 confidence, 35 % from .5, else 50 %."""
    c = _c(confidence)
    margin = F.when(c > 0.8, 0.2).when(c >= 0.5, 0.35).otherwise(0.5)
    v = _c(value).cast("double")
    return F.struct(
        round_half_up(v * (1 - margin), 1).alias("min"), round_half_up(v * (1 + margin), 1).alias("max"), round_half_up(v, 1).alias("best")
    )


def day_of_week(ts) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(_c(ts)) - 1).cast("int")


def age_days(ts, now) -> Column:
    return (F.unix_micros(_c(now)) - F.unix_micros(_c(ts))) / F.lit(86_400_000_000)


def lat_cell(lat, miles: float) -> Column:
    """Row of a grid whose rows are ``miles`` high."""
    return F.floor(_c(lat) / math.degrees(miles / EARTH_MILES)).cast("bigint")


def current_busyness(live, forecast) -> Column:
    """struct(busyness, busier, wait): the live value, else the forecast; busier than usual if both are known
    and the live one is greater; busyness 0 and a null wait where neither is known."""
    live, forecast = _c(live), _c(forecast)
    now = F.coalesce(live, forecast)
    return F.struct(
        F.coalesce(now, F.lit(0)).alias("busyness"), F.coalesce(live > forecast, F.lit(False)).alias("busier"), F.when(now.isNotNull(), wait_minutes(now)).alias("wait")
    )
