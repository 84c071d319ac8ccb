"""Readers that turn raw feeds into tables: JSON, reviews, forecasts, labels and source priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, sf_dir: str, table: str, cols: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A table's columns and rows; both reach the Parquet scan."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.where(where) if where else df
    return df.select(*cols) if cols else df


def first_nonempty_source(frames: list[DataFrame], key: str) -> DataFrame:
    """Per key the rows of the first source that has any; rows without a key have none."""
    return first_source(union_sources(*[f.withColumn("source_no", F.lit(i)) for i, f in enumerate(frames)]), key, "source_no")


def first_source(df: DataFrame, key: str, source: str) -> DataFrame:
    """Per key the rows of its least ``source``, for sources that lie in one table.

    A rank and no semi-join with the keys' least sources: Spark moves that join into every source of a union, where
    each reads the least sources again. Tasks drop what is not first among their own rows before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(source)
    return df.where(F.col(key).isNotNull() & F.col(source).isNotNull()).withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def override_union(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """All primary rows, and the secondary ones whose lower-cased key they do not have."""
    k = primary.select(F.lower(key).alias("_k")).distinct()
    rest = secondary.withColumn("_k", F.lower(key)).join(k, "_k", "left_anti").drop("_k")
    return primary.unionByName(rest, allowMissingColumns=True)


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_first(frames: list[DataFrame], key: str, n: int) -> DataFrame:
    """A union without names of an earlier tier, in the order of tiers and names, ``n`` at most."""
    out = union_sources(*[f.withColumn("tier", F.lit(i)) for i, f in enumerate(frames)])
    w = Window.partitionBy(F.lower(key)).orderBy("tier", key)
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy("tier", key).limit(n)


def normalise_reviews(google: DataFrame, yelp: DataFrame) -> DataFrame:
    """Two review feeds in one schema."""
    g = google.select("restaurant_id", F.col("text"), F.col("rating").cast("double").alias("rating"), F.col("author_name").alias("author"), F.col("publish_time").alias("date"), F.lit("google").alias("source"))
    y = yelp.select("restaurant_id", F.col("text"), F.col("rating").cast("double").alias("rating"), F.col("user.name").alias("author"), F.col("time_created").alias("date"), F.lit("yelp").alias("source"))
    return g.unionByName(y)


def flatten_forecast(df: DataFrame) -> DataFrame:
    """A weekly forecast as one row a venue, day and hour; busyness is ten times the intensity."""
    day = df.select("venue_name", F.explode("analysis").alias("d"))
    hour = day.select("venue_name", F.col("d.day_info.day_int").alias("day"), F.explode("d.hour_analysis").alias("h"), F.array_contains("d.busy_hours", F.col("h.hour")).alias("is_peak"), F.array_contains("d.quiet_hours", F.col("h.hour")).alias("is_quiet"))
    pct = F.least(F.greatest(F.col("h.intensity_nr") * 10, F.lit(0.0)), F.lit(100.0)).cast("int")
    return hour.select("venue_name", "day", F.col("h.hour").alias("hour"), pct.alias("busyness"), "is_peak", "is_quiet")


def extract_json(c: Column, schema: StructType | str) -> Column:
    """JSON in noisy text: the text itself, a fenced block, or from the first bracket to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    between = F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(ok(F.trim(c)), ok(F.nullif(fenced, F.lit(""))), ok(F.nullif(between, F.lit(""))))


def parse_analysis(df: DataFrame, text: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows with the parsed struct, rows that do not parse)."""
    parsed = df.withColumn("parsed", extract_json(F.col(text), schema))
    return parsed.where("parsed is not null"), parsed.where("parsed is null").drop("parsed").withColumn("error", F.lit("not the expected JSON"))


def corrected_truth(truth: DataFrame, corrections: DataFrame) -> DataFrame:
    """Labels (name, expected_type) with corrections (name, correct_type) by lower-cased name written over them."""
    c = corrections.select(F.lower("name").alias("_k"), "correct_type").groupBy("_k").agg(F.min("correct_type").alias("correct_type"))
    out = truth.withColumn("_k", F.lower("name")).join(c, "_k", "left")
    return out.withColumn("expected_type", F.coalesce("correct_type", "expected_type")).drop("_k", "correct_type")


def load_truth(spark: SparkSession, path: str, corrections: str | None = None) -> DataFrame:
    """A label file of items; a corrections file overrides labels by name."""
    t = spark.read.option("multiLine", True).json(path)
    if "items" in t.columns:
        t = t.select(F.explode("items").alias("i")).select("i.*")
    return corrected_truth(t, spark.read.option("multiLine", True).json(corrections)) if corrections else t


def backfill_menu_items(dishes: DataFrame, existing: DataFrame) -> DataFrame:
    """Menu items for dishes that have none: type by availability, seen when they were made and audited."""
    from platewise.functions.text import name_key

    rows = dishes.select(
        "restaurant_id", "name", name_key("name").alias("name_normalized"), F.lit("backfill").alias("source"), F.when(F.col("is_available"), "dish").otherwise("unknown").alias("item_type"), "dish_id"
    )
    return rows.join(existing.select("restaurant_id", "name_normalized"), ["restaurant_id", "name_normalized"], "left_anti")
