"""Row filters and projections of the search and upkeep jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.categories import BASIC_DRINKS, JUNK, is_wine_or_spirit
from platewise.functions.flags import overlaps
from platewise.functions.numbers import haversine

# Fixed values.
CUISINES = ["thai", "italian", "mexican", "japanese", "chinese", "indian", "korean", "greek", "french", "vietnamese", "mediterranean", "american"]
LODGING_TYPES = ["lodging", "hotel", "gas_station", "supermarket", "grocery_store", "convenience_store", "pharmacy", "hospital", "gym", "spa", "movie_theater"]
LODGING_NAMES = r"(?i)\b(?:hotel|inn|suites|resort|motel|hostel|marriott|hilton|hyatt|sheraton|westin|airbnb)\b"
FEEDBACK_TYPES = ["portion_bigger", "portion_smaller", "portion_accurate", "dish_unavailable", "photo_submission"]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def available(dishes: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Available dishes of active restaurants."""
    return dishes.where("is_available").join(restaurants.where("is_active").select("restaurant_id"), "restaurant_id", "left_semi")


def macro_filter(df: DataFrame, calorie_limit=None, protein_min=None, goal: str | None = None) -> DataFrame:
    """A goal of glp1_friendly replaces the caller's limits by 500 kcal and 25 g of protein."""
    if goal == "glp1_friendly":
        calorie_limit, protein_min = 500, 25
    if calorie_limit:
        df = df.where(F.col("calories_max") <= calorie_limit)
    if protein_min:
        df = df.where(F.col("protein_min") >= protein_min)
    return df


def text_contains(df: DataFrame, q: str, cols: list[str]) -> DataFrame:
    return df.where(_any([F.contains(F.lower(F.col(c)), F.lit(q.lower())) for c in cols]))


def cuisine_filter(df: DataFrame, cuisines: list[str], col: str = "cuisines") -> DataFrame:
    """Rows of one of the cuisines, whatever their case; all rows where none is asked for."""
    return df.where(overlaps(col, cuisines)) if cuisines else df


def split_categories(categories: list[str]) -> tuple[list[str], list[str]]:
    """Requested categories that name cuisines, and the others."""
    return [c for c in categories if c.lower() in CUISINES], [c for c in categories if c.lower() not in CUISINES]


def category_filter(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.where(F.lower("category").isin([c.lower() for c in categories])) if categories else df


def with_distance(df: DataFrame, lat: float, lng: float) -> DataFrame:
    """Miles to a point, to two decimals; null where the row has no place."""
    return df.withColumn("distance", F.floor(haversine("lat", "lng", F.lit(lat), F.lit(lng)) * 100 + 0.5) / 100)


def within_radius(df: DataFrame, miles: float) -> DataFrame:
    return df.where(F.col("distance").isNull() | (F.col("distance") <= miles))


def in_viewport(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return df.where(F.col("lat").between(south, north) & F.col("lng").between(west, east))


def max_wait(df: DataFrame, minutes: int, inclusive: bool = True) -> DataFrame:
    """Unknown waits pass."""
    w = F.col("wait")
    return df.where(w.isNull() | ((w <= minutes) if inclusive else (w < minutes)))


def stale(df: DataFrame, ts: str, days: int, now) -> DataFrame:
    """Never done, or longer ago than ``days``."""
    return df.where(F.col(ts).isNull() | (F.col(ts) < now - F.make_dt_interval(days=F.lit(days))))


def due_areas(areas: DataFrame, now, n: int) -> DataFrame:
    """Areas whose own interval is over; by priority, longest wait first."""
    due = F.col("last_discovered_at").isNull() | (F.col("last_discovered_at") < now - F.make_dt_interval(days=F.col("interval_days")))
    return areas.where(due).orderBy(F.asc("priority"), F.asc_nulls_first("last_discovered_at"), "area_id").limit(n)


def review_queue(items: DataFrame, mode: str) -> DataFrame:
    """Items that need a look: low_confidence, unknown or unscored; backfilled ones never."""
    rule = {
        "low_confidence": F.col("audit_confidence") < 0.7,
        "unknown": F.col("item_type") == "unknown",
        "unscored": F.col("is_dish_card") & F.col("dish_card_confidence").isNull(),
    }[mode]
    return items.where(rule & (F.col("source") != "backfill"))


def non_restaurant(df: DataFrame) -> DataFrame:
    return df.where(F.arrays_overlap("types", F.array(*map(F.lit, LODGING_TYPES))) | F.col("name").rlike(LODGING_NAMES))


def validate_items(df: DataFrame) -> DataFrame:
    """``df`` (name, description, price text) with errors and warnings: arrays of what is wrong with the format."""
    n, d = F.trim(F.coalesce("name", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    price = F.regexp_replace(F.coalesce("price", F.lit("")), "[^0-9.]", "").try_cast("double")

    def said(*rules):
        return F.filter(F.array(*[F.when(c, F.lit(s)) for c, s in rules]), lambda x: x.isNotNull())

    errors = said(
        (F.length(n) < 3, "name_too_short"),
        (F.length(n) > 80, "name_too_long"),
        (n.rlike("[<>{}]"), "markup"),
        (F.lower(F.concat_ws(" ", n, d)).rlike(JUNK), "junk"),
        (n.rlike(r"^\d[\d\s.,-]*$"), "only_digits"),
        (F.contains(n, F.lit("|")) & n.rlike(r"\d{4}"), "wine_code"),
    )
    warnings = said((price < 0.5, "price_low"), (price > 500, "price_high"), ((d == "") & (F.coalesce("price", F.lit("")) == ""), "no_description_or_price"))
    return df.withColumn("errors", errors).withColumn("warnings", warnings)


def eligible_notifications(events: DataFrame, prefs: DataFrame) -> DataFrame:
    """Events whose user takes them: channel and type on, outside quiet hours (which may wrap midnight).

    Users without preferences take everything. ``events`` has user_id, type, channel and hour.
    """
    p = prefs.select("user_id", "channels", "types", "quiet_from", "quiet_to")
    on = lambda arr, v: F.col(arr).isNull() | F.array_contains(F.col(arr), F.col(v))
    h, a, b = F.col("hour"), F.col("quiet_from"), F.col("quiet_to")
    quiet = F.when(a.isNull() | b.isNull() | (a == b), False).when(a < b, (h >= a) & (h < b)).otherwise((h >= a) | (h < b))
    return events.join(p, "user_id", "left").where(on("channels", "channel") & on("types", "type") & ~quiet).select(*events.columns)


def old_summaries(df: DataFrame, prefixes: list[str]) -> DataFrame:
    s = F.col("summary")
    return df.where(s.isNotNull() & (s != "") & ~_any([s.startswith(p) for p in prefixes]))


def drinks_listed(df: DataFrame) -> DataFrame:
    return df.where(is_wine_or_spirit("name", "category") | F.lower("name").isin(BASIC_DRINKS))


def validate_requests(df: DataFrame) -> DataFrame:
    """A log of search requests as text, typed, with defaults filled in and a list of errors per row.

    A bad value gives an error and a null; a missing one its default. Other columns, such as the log's own
    key, stay as they are.
    """
    sorts = ["rating", "distance", "wait_time", "macro_match"]
    goals = ["max_protein", "min_calories", "min_fat", "min_carbs", "balanced", "glp1_friendly"]

    def number(c, kind, low, high, default=None):
        v = F.col(c).try_cast(kind)
        ok = v.between(low, high)
        bad = F.col(c).isNotNull() & ~F.coalesce(ok, F.lit(False))
        return F.when(F.col(c).isNull(), F.lit(default).cast(kind)).when(ok, v), bad

    def choice(c, values):
        v = F.lower(F.trim(F.col(c)))
        bad = F.col(c).isNotNull() & ~v.isin(values)
        return F.when(v.isin(values), v), bad

    rules = {
        "lat": number("lat", "double", -90, 90),
        "lng": number("lng", "double", -180, 180),
        "radius": number("radius", "double", 0.1, 50, 2.0),
        "calorie_limit": number("calorie_limit", "int", 1, 10_000),
        "protein_min": number("protein_min", "int", 0, 500),
        "max_wait": number("max_wait", "int", 0, 240),
        "limit": number("limit", "int", 1, 100, 20),
        "offset": number("offset", "int", 0, 10_000, 0),
        "sort": choice("sort", sorts),
        "goal": choice("goal", goals),
    }
    errors = F.filter(F.array(*[F.when(bad, F.lit(c)) for c, (_, bad) in rules.items()]), lambda e: e.isNotNull())
    lists = {c: F.filter(F.split(F.coalesce(F.lower(F.col(c)), F.lit("")), r"\s*,\s*"), lambda x: x != "") for c in ("diet", "cuisines", "categories", "allergens")}
    out = df.withColumn("_errors", errors).withColumns({f"_{c}": v for c, (v, _) in rules.items()} | {f"_{c}": v for c, v in lists.items()})
    own = [F.col(c) for c in df.columns if c not in {*rules, *lists, "q", "errors"}]
    return out.select(*[F.col(f"_{c}").alias(c) for c in (*rules, *lists)], F.lower(F.trim("q")).alias("q"), F.col("_errors").alias("errors"), *own)


def query_fingerprint(df: DataFrame) -> DataFrame:
    """Canonical text of a typed request, equal for equal searches."""

    def joined(c, empty):
        return F.coalesce(F.nullif(F.array_join(F.array_sort(c), "|"), F.lit("")), F.lit(empty))

    def maybe(prefix, c):
        return F.concat(F.lit(prefix), F.coalesce(F.col(c).cast("string"), F.lit("none")))

    point = F.concat(F.format_string("%.3f", "lat"), F.lit(","), F.format_string("%.3f", "lng"))
    parts = [
        F.lit("query"),
        F.coalesce(F.nullif(F.col("q"), F.lit("")), F.lit("all")),
        joined("diet", "none"),
        F.coalesce("goal", F.lit("none")),
        joined("cuisines", "none"),
        F.coalesce("sort", F.lit("default")),
        maybe("cal", "calorie_limit"),
        maybe("prot", "protein_min"),
        F.concat(F.lit("al"), joined("allergens", "none")),
        maybe("wait", "max_wait"),
        F.coalesce(point, F.lit("anywhere")),
        F.concat(F.lit("r"), F.format_string("%.1f", "radius")),
    ]
    return df.withColumn("fingerprint", F.array_join(F.array(*parts), ":"))
