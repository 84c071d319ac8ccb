"""The menu ETL over all restaurants at once: annotate, clean, deduplicate, tag, upsert, classify, promote, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import categories as C
from platewise.functions import text as T
from platewise.operators.aggregates import archive_stale, dedup_first
from platewise.operators.sinks import upsert
from platewise.sources.menus import raw_annotations

COLUMNS = ["restaurant_id", "name_normalized", "source", "name", "description", "category", "price", "tags", "item_type", "first_seen_at", "last_seen_at", "archived_at", "archived_reason", "is_dish_card", "dish_id"]


def clean_items(raw: DataFrame) -> DataFrame:
    """Raw items (restaurant_id, source, position, name, description, category, price) cleaned and tagged."""
    out = raw.withColumn("tags", raw_annotations(F.col("name"), F.col("description"))["tags"])
    out = out.withColumn("name", T.clean_name("name")).where("name is not null")
    # a dealing by restaurant, which the steps below need anyway, keeps the rules from being
    # evaluated inside the cleaning expression
    out = out.repartition("restaurant_id")
    out = out.withColumn("description", T.clean_description("description")).withColumn("category", T.clean_category("category")).withColumn("price", T.parse_price("price"))
    out = out.where(C.likely_food("name", "description")).withColumn("name_normalized", T.name_key("name"))
    out = dedup_first(out, ["restaurant_id", "name_normalized", "source"], [F.asc("position"), F.asc("name")])
    return out.withColumn("item_type", C.pretag("name", "category"))


def to_dish(items: DataFrame) -> DataFrame:
    """Dish records of items: a tag on the menu raises confidence to .95, menu calories set both bounds."""
    tagged = F.size("tags") > 0
    return items.select(
        "restaurant_id", "name", "description", "category", "price", F.when(tagged, 0.95).otherwise(0.7).alias("dietary_confidence"), F.col("menu_calories").cast("int").alias("calories_min"),
        F.col("menu_calories").cast("int").alias("calories_max"), F.when(F.col("menu_calories").isNotNull(), "published").alias("macro_source"),
    )


def promote(items: DataFrame, dishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new dishes, items with their dish): promotable items get the dish of their name, made if missing."""
    wanted = items.where(F.col("archived_at").isNull() & C.promotable("item_type", "name", "category"))
    keyed = wanted.withColumn("k", F.lower("name")).select("restaurant_id", "k", "name", "description", "category", "price", "tags")
    new = keyed.join(dishes.select("restaurant_id", F.lower("name").alias("k")), ["restaurant_id", "k"], "left_anti")
    w = Window.partitionBy("restaurant_id", "k").orderBy("name")
    new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    made = new.select(F.abs(F.xxhash64("restaurant_id", "k")).alias("dish_id"), "restaurant_id", "name", "description", "category", "price")
    every = dishes.select("dish_id", "restaurant_id", F.lower("name").alias("k")).unionByName(made.select("dish_id", "restaurant_id", F.lower("name").alias("k")))
    every = every.groupBy("restaurant_id", "k").agg(F.min("dish_id").alias("found"))
    ok = F.col("archived_at").isNull() & C.promotable("item_type", "name", "category")
    linked = items.withColumn("k", F.lower("name")).join(every, ["restaurant_id", "k"], "left")
    linked = linked.withColumn("is_dish_card", ok).withColumn("dish_id", F.when(ok, F.coalesce("dish_id", "found")).otherwise(F.col("dish_id"))).drop("k", "found")
    return made, linked


def menu_pipeline(raw: DataFrame, state: DataFrame, dishes: DataFrame, crawls: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(items after the crawl, new dishes). ``state`` has COLUMNS; ``crawls`` restaurant_id, source, crawled_at."""
    seen = clean_items(raw).select(
        "restaurant_id", "name_normalized", "source", "name", "description", "category", "price", "tags", "item_type", now.alias("first_seen_at"), now.alias("last_seen_at")
    )
    items = upsert(state, seen, ["restaurant_id", "name_normalized", "source"], insert_only=["first_seen_at"], revive=["archived_at", "archived_reason"])
    kind = F.when(F.col("item_type") == "unknown", C.classify("name", "category", "description")).otherwise(F.col("item_type"))
    made, linked = promote(items.withColumn("item_type", kind), dishes)
    return archive_stale(linked, crawls, now), made
