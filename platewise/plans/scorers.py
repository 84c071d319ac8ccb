"""Batch contracts for external models, with the deterministic fallback where there is none.

A scorer is a plain Python callable from a list of rows (dicts) to a list of results, one each or
None; it runs inside the tasks, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.text import glp1_label
from platewise.operators.aggregates import ensemble
from platewise.operators.sinks import upsert

Scorer = Callable[[list[dict]], list]
FLAGS = ["vegan", "vegetarian", "gluten_free", "dairy_free", "nut_free", "halal", "kosher"]


def _scored(df: DataFrame, scorer: Scorer | None, size: int, schema: str, names: list[str], missing: tuple, failed: tuple) -> DataFrame:
    """``df`` with the scorer's columns; ``missing`` where it gives None, ``failed`` where a batch raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), size):
                rows = pdf.iloc[i : i + size].to_dict("records")
                try:
                    got = scorer(rows) if scorer else [failed] * len(rows)
                except Exception:  # a failing model must not fail the job
                    got = [failed] * len(rows)
                out += [missing if g is None else g for g in got]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{base}, {schema}")


def verify_food(df: DataFrame, scorer: Scorer | None = None, keep_from: float = 0.7, size: int = 50) -> DataFrame:
    """Items that are food. No scorer or a failed batch keeps all at .8; a missing result counts .5."""
    out = _scored(df, scorer, size, "is_food boolean, food_confidence double, reason string", ["is_food", "food_confidence", "reason"], (True, 0.5, "no result"), (True, 0.8, "not verified"))
    return out.where(F.col("is_food") & (F.col("food_confidence") >= keep_from))


def analyse_dishes(df: DataFrame, scorer: Scorer | None = None, size: int = 20) -> DataFrame:
    """Dishes with dietary flags; without an analysis all are unknown at confidence 0, with a warning."""
    empty = (*[None] * len(FLAGS), 0.0, "analysis failed")
    schema = ", ".join(f"{f} boolean" for f in FLAGS) + ", dietary_confidence double, analysis_warning string"
    out = _scored(df, scorer, size, schema, [*FLAGS, "dietary_confidence", "analysis_warning"], empty, empty)
    return out.withColumn("is_glp1", glp1_label("name", "description"))


def summarise(dishes: DataFrame, reviews: DataFrame, scorer: Scorer | None = None, most: int = 20) -> DataFrame:
    """A summary per dish from its newest ``most`` reviews; the fallback states count and mean."""
    stats = reviews.groupBy("dish_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("rating").alias("mean_rating"))
    if scorer is None:
        plain = F.concat(F.lit("Based on "), F.col("n_reviews"), F.lit(" reviews, rated "), F.format_number("mean_rating", 1), F.lit(" on average."))
        out = dishes.join(stats, "dish_id", "left")
        return out.withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0))).withColumn("summary", F.coalesce(plain, F.lit("No reviews yet.")))
    from platewise.operators.rank import top_k_per_group

    newest = top_k_per_group(reviews, ["dish_id"], [F.col("date").desc_nulls_last(), F.asc("text")], most)
    texts = newest.groupBy("dish_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "text")))["text"], "\n").alias("texts"))
    rows = dishes.join(stats, "dish_id", "left").join(texts, "dish_id", "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))
    some = _scored(rows.where("n_reviews > 0"), lambda r: [(s,) if s is not None else None for s in scorer(r)], 20, "summary string", ["summary"], (None,), (None,))
    return some.drop("texts").unionByName(rows.where("n_reviews = 0").drop("texts").withColumn("summary", F.lit("No reviews yet.")))


def apply_photo_analyses(dishes: DataFrame, analyses: DataFrame, accept: float = 0.4) -> DataFrame:
    """Dishes with the ensemble of their accepted photo analyses written in."""
    good = analyses.where(F.col("confidence") >= accept)
    e = ensemble(good, "dish_id", ["calories", "protein", "carbs", "fat"])
    new = e.select("dish_id", *[F.col(f"{c}_{b}").alias(f"{c}_{b}") for c in ("calories", "protein", "carbs", "fat") for b in ("min", "max")], F.col("confidence").alias("macro_confidence"), F.col("n_photos").alias("photo_count"))
    new = new.withColumn("calories_min", F.floor(F.col("calories_min") + 0.5).cast("int")).withColumn("calories_max", F.floor(F.col("calories_max") + 0.5).cast("int"))
    return upsert(dishes, new.join(dishes.select("dish_id"), "dish_id", "left_semi"), ["dish_id"], keep_nulls=True)
