"""Nutrition: food matching scores, portion scaling, tiered resolution and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import round_half_up

# Nutrient ids of the public food database, preparation factors, data types.
NUTRIENTS = {"calories": 1008, "protein": 1003, "carbs": 1005, "fat": 1004, "fiber": 1079}
PREPARATION = {"fried": 1.2, "deep-fried": 1.35, "grilled": 0.95, "baked": 1.0, "steamed": 0.95, "raw": 1.0, "sauteed": 1.1, "roasted": 1.0}
TRUSTED_TYPE = "Foundation"
MIN_GRAMS, MAX_GRAMS = 1, 5000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def food_macros(foods: DataFrame) -> DataFrame:
    """One row per food from its nested nutrients; a missing nutrient is 0."""

    def amount(i):
        got = F.filter("foodNutrients", lambda n: n["nutrientId"] == i)
        return F.coalesce(F.try_element_at(got, F.lit(1))["value"], F.lit(0.0))

    return foods.select("fdcId", "description", "dataType", *[amount(i).alias(c) for c, i in NUTRIENTS.items()])


def food_confidence(description, query, data_type) -> Column:
    """How well a food fits a phrase: share of its words found, trusted source, the phrase itself, less for
    descriptions of over three times as many words. Words and phrase count at word boundaries.
    """
    d, q = F.lower(_c(description)), F.trim(F.lower(_c(query)))
    words = F.split(q, r"\s+")

    def said(w):
        return F.regexp_like(d, F.concat(F.lit(r"(?<!\w)\Q"), w, F.lit(r"\E(?!\w)")))

    ratio = F.size(F.filter(words, said)) / F.size(words)
    long = F.size(F.filter(F.split(d, r"[\s,]+"), lambda w: w != "")) * 0.3 > F.size(words)
    score = ratio * 0.75 + F.when(_c(data_type) == TRUSTED_TYPE, 0.1).otherwise(0.0) + F.when(said(q), 0.15).otherwise(0.0) - F.when(long, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def scale_macros(df: DataFrame, grams: str = "grams", preparation: str = "preparation") -> DataFrame:
    """Macros per 100 g scaled to a portion of 1 to 5000 g and by preparation (calories and fat)."""
    factors = F.create_map(*[F.lit(v) for kv in PREPARATION.items() for v in kv])
    portion = F.least(F.greatest(F.col(grams).cast("double"), F.lit(float(MIN_GRAMS))), F.lit(float(MAX_GRAMS))) / 100
    cooked = F.coalesce(F.try_element_at(factors, F.lower(F.col(preparation))), F.lit(1.0))
    out = {c: round_half_up(F.col(c) * portion, 1) for c in ("protein", "carbs")}
    out |= {c: round_half_up(F.col(c) * portion * cooked, 1) for c in ("calories", "fat")}
    return df.withColumns(out)


def best_entry(entries: DataFrame) -> DataFrame:
    """Per dish the third-party entry of its own query before a generic one, then the most logged."""
    order = F.struct(F.col("specific").cast("int"), "log_count", F.negative("entry_id"))
    return entries.groupBy("dish_id").agg(F.max_by(F.struct("entry_id", "calories", "protein", "carbs", "fat", "log_count"), order).alias("e")).select("dish_id", "e.*")


def resolve_nutrition(dishes: DataFrame, published: DataFrame, third: DataFrame, estimated: DataFrame) -> DataFrame:
    """Published before third-party before estimated nutrition, with the tier and its confidence."""
    cols = ["calories", "protein", "carbs", "fat"]

    def tier(df, name, confidence):
        return df.select("dish_id", F.struct(*cols, F.lit(name).alias("tier"), confidence.cast("double").alias("confidence")).alias(name))

    third_sure = F.when(F.col("log_count") >= 100, 0.8).when(F.col("log_count") >= 10, 0.7).otherwise(0.6)
    out = dishes.select("dish_id")
    for df, name, sure in ((published, "published", F.lit(0.95)), (third, "third_party", third_sure), (estimated, "estimated", F.col("confidence"))):
        out = out.join(tier(df, name, sure), "dish_id", "left")
    return out.select("dish_id", F.coalesce("published", "third_party", "estimated").alias("n")).select("dish_id", "n.*")


def cross_validate(df: DataFrame, low: str, high: str, reference: str) -> DataFrame:
    """Deviation of the mid calories from a reference and the band it falls in."""
    mid = (F.col(low) + F.col(high)) / 2
    off = F.try_divide(F.abs(mid - F.col(reference)), F.col(reference))
    band = F.when(off.isNull(), "unknown").when(off <= 0.15, "high").when(off <= 0.3, "medium").otherwise("low")
    return df.withColumn("deviation", off).withColumn("band", band)
