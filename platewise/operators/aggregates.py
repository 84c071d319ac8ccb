"""Aggregations over feedback, photos, reviews, crawls and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.numbers import round_half_up
from platewise.operators.filters import FEEDBACK_TYPES
from platewise.operators.joins import truth_match


def dish_counts(restaurants: DataFrame, dishes: DataFrame) -> DataFrame:
    n = dishes.where("is_available").groupBy("restaurant_id").agg(F.count("dish_id").alias("n_dishes"))
    return restaurants.join(n, "restaurant_id")


def child_counts(parent: DataFrame, child: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Children per parent, zero included."""
    n = child.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return parent.join(n, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def feedback_counts(feedback: DataFrame, now, days: int = 30) -> DataFrame:
    """Votes of each type per dish over the last days, as columns."""
    recent = feedback.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))
    return recent.groupBy("dish_id").agg(*[F.count_if(F.col("feedback_type") == t).alias(t) for t in FEEDBACK_TYPES])


MIN_REPORTS, MIN_NET, PORTION_STEP = 3, 2, 0.12  # fixed values


def adjust_portions(dishes: DataFrame, counts: DataFrame) -> DataFrame:
    """Scale macros of dishes whose portions are reported bigger or smaller, by 12 %.

    It takes three reports and a net of two; calories scale at both ends, the others at the top.
    """
    more, less = F.coalesce("portion_bigger", F.lit(0)), F.coalesce("portion_smaller", F.lit(0))
    enough = (more + less >= MIN_REPORTS) & F.col("calories_min").isNotNull()
    factor = F.when(enough & (more - less >= MIN_NET), 1 + PORTION_STEP).when(enough & (less - more >= MIN_NET), 1 - PORTION_STEP).otherwise(1.0)
    out = dishes.join(counts.select("dish_id", "portion_bigger", "portion_smaller"), "dish_id", "left").withColumn("factor", factor)
    for c in ("calories_min", "calories_max"):
        out = out.withColumn(c, round_half_up(F.col(c) * F.col("factor")).cast("int"))
    for c in ("protein_max", "carbs_max", "fat_max"):
        out = out.withColumn(c, round_half_up(F.col(c) * F.col("factor"), 1))
    return out.drop("portion_bigger", "portion_smaller")


def flag_unavailable(dishes: DataFrame, counts: DataFrame) -> DataFrame:
    votes = counts.select("dish_id", "dish_unavailable")
    gone = F.coalesce("dish_unavailable", F.lit(0)) >= MIN_REPORTS
    return dishes.join(votes, "dish_id", "left").withColumn("is_available", F.col("is_available") & ~gone).drop("dish_unavailable")


def submitted_photos(feedback: DataFrame, now, days: int = 7) -> DataFrame:
    recent = F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days))
    return feedback.where((F.col("feedback_type") == "photo_submission") & recent)


def with_outliers(df: DataFrame, key: str, value: str) -> DataFrame:
    """Marks values further from their group's median than twice the median deviation (or half the median).

    Groups of fewer than three have no outliers. One shuffle by the key.
    """
    w = Window.partitionBy(key)
    out = df.withColumn("_m", F.median(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    out = out.withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    out = out.withColumn("_mad", F.median("_d").over(w))
    far = (F.col("_n") >= 3) & (F.col("_d") > F.greatest(F.col("_mad") * 2, F.col("_m") * 0.5))
    return out.withColumn("is_outlier", far).drop("_m", "_n", "_d", "_mad")


def ensemble(photos: DataFrame, key: str, values: list[str], by: str = "calories") -> DataFrame:
    """Per dish the means of the photos that are no outliers, with a confidence that grows with their number.

    If all are outliers all count. The range is 10 % above .8 confidence, else 20 %.
    """
    marked = with_outliers(photos, key, by)
    none_left = F.min(F.col("is_outlier")).over(Window.partitionBy(key))
    used = marked.withColumn("_use", ~F.col("is_outlier") | none_left)
    n = F.count_if("_use")
    mean = {v: F.avg(F.when(F.col("_use"), F.col(v))).alias(v) for v in values}
    sure = F.avg(F.when(F.col("_use"), F.col("confidence")))
    out = used.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_photos"), F.count_if(~F.col("_use")).alias("n_outliers"), F.least(F.lit(1.0), sure * (1 + F.log2(n) / 10)).alias("sure"), *mean.values()
    )
    margin = F.when(F.col("sure") > 0.8, 0.1).otherwise(0.2)
    ranges = [c for v in values for c in (round_half_up(F.col(v) * (1 - margin), 1).alias(f"{v}_min"), round_half_up(F.col(v) * (1 + margin), 1).alias(f"{v}_max"))]
    return out.select(key, "n_photos", "n_outliers", round_half_up("sure", 3).alias("confidence"), *[round_half_up(F.col(v), 1).alias(v) for v in values], *ranges)


def sum_nutrients(ingredients: DataFrame, key: str = "photo_id") -> DataFrame:
    """Sums per photo of the ingredients whose lookup succeeded."""
    found = ingredients.where(F.col("calories").isNotNull())
    return found.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("calories", "protein", "carbs", "fat")])


def review_stats(matches: DataFrame, summaries: DataFrame) -> DataFrame:
    """Counts by source and the share of praise among praise and complaints (of one at least)."""
    n = matches.groupBy("dish_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("source") == "google").alias("n_google"), F.count_if(F.col("source") == "yelp").alias("n_yelp"), F.avg("rating").alias("average_rating")
    )
    praise, complaint = F.size(F.coalesce("praises", F.array().cast("array<string>"))), F.size(F.coalesce("complaints", F.array().cast("array<string>")))
    s = summaries.select("dish_id", round_half_up(praise / F.greatest(praise + complaint, F.lit(1)) * 100).cast("int").alias("positive_pct"))
    return n.join(s, "dish_id", "left")


def delivery_ratings(items: DataFrame) -> DataFrame:
    """Per dish the rating of the first platform that has one; "most liked" on any platform counts."""
    has = F.col("thumbs_up_pct").isNotNull()
    first = F.min_by(F.when(has, F.struct("thumbs_up_pct", "rating_count")), F.when(has, F.col("platform")))
    return items.groupBy("dish_id").agg(first.alias("f"), F.bool_or("is_most_liked").alias("is_most_liked")).select("dish_id", "f.thumbs_up_pct", "f.rating_count", "is_most_liked")


def richest(items: DataFrame, key: str, weights: dict[str, int], position: str) -> DataFrame:
    """The most complete record of each key by weighted non-null columns; of equal ones the first."""
    score = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), w).otherwise(0) for c, w in weights.items()), F.lit(0))
    w = Window.partitionBy(key).orderBy(F.desc("richness"), F.asc(position))
    return items.withColumn("richness", score).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedup_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def archive_stale(items: DataFrame, crawls: DataFrame, now) -> DataFrame:
    """Archive what a crawl did not see again, unless the crawl itself looks broken.

    Where fewer than a fifth of the active items of a (restaurant, source), or fewer than three,
    were seen, nothing of it is archived. ``crawls`` has restaurant_id, source and crawled_at; all
    restaurants are handled at once.
    """
    keyed = items.join(crawls, ["restaurant_id", "source"], "left")
    active = F.col("archived_at").isNull()
    seen = active & (F.col("last_seen_at") >= F.col("crawled_at"))
    counts = keyed.where(F.col("crawled_at").isNotNull()).groupBy("restaurant_id", "source").agg(F.count_if(active).alias("n_active"), F.count_if(seen).alias("n_seen"))
    out = keyed.join(counts, ["restaurant_id", "source"], "left")
    tripped = F.coalesce((F.col("n_active") > 0) & (F.col("n_seen") < F.greatest(F.col("n_active") * 0.2, F.lit(3.0))), F.lit(False))
    gone = active & (F.col("last_seen_at") < F.col("crawled_at")) & ~tripped
    out = out.withColumn("breaker_tripped", tripped)
    out = out.withColumn("archived_reason", F.when(gone, F.lit("menu_removed"))).withColumn("archived_at", F.when(gone, now).otherwise(F.col("archived_at")))
    return out.drop("crawled_at", "n_active", "n_seen")


def classifier_eval(items: DataFrame, truth: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Accuracy by true type, and overall, of items (item_id, restaurant, name, item_type)."""
    if corrections is not None:
        c = corrections.select(F.lower("name").alias("k"), "correct_type").dropDuplicates(["k"])
        truth = truth.withColumn("k", F.lower("name")).join(c, "k", "left").withColumn("label", F.coalesce("correct_type", "label")).drop("k", "correct_type")
    m = truth_match(items, truth).join(items.select("item_id", "item_type").hint("merge"), "item_id")
    right = (F.col("item_type") == F.col("label")).cast("double")
    by_type = m.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"), F.count(right).alias("of"))
    overall = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("right").alias("right"), F.sum("of").alias("of")).select(F.lit("all").alias("label"), "n", "right", "of")
    return by_type.unionByName(overall).select("label", "n", F.try_divide("right", "of").alias("accuracy"))


def scraper_eval(items: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall of known items per restaurant, and the known non-items that were scraped.

    ``truth`` has restaurant, name and is_item; a known name is found if an item's name equals it or
    either contains the other.
    """
    from platewise.functions.text import eval_key

    i = items.select("restaurant", eval_key("name").alias("a")).distinct()
    t = truth.select("restaurant", eval_key("name").alias("b"), "is_item").where("b <> ''").distinct()
    found = t.join(i, (t["restaurant"] == i["restaurant"]) & (F.contains("a", "b") | F.contains("b", "a")), "left_semi").withColumn("hit", F.lit(True))
    all_ = t.join(found, ["restaurant", "b", "is_item"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    known = F.count_if("is_item")
    return all_.groupBy("restaurant").agg(
        F.try_divide(F.count_if(F.col("is_item") & F.col("hit")), known).alias("recall"), F.count_if(F.col("is_item") & ~F.col("hit")).alias("missed"), F.count_if(~F.col("is_item") & F.col("hit")).alias("false_items")
    )


def flag_eval(pred: DataFrame, truth: DataFrame, flags: list[str], critical: list[str], count_nulls: bool = False) -> DataFrame:
    """Scores of flag predictions per model: accuracy, caution on unknowns, safety failures.

    A prediction counts where it is not null (or always with ``count_nulls``). It is right if it
    equals the truth; a false on a null truth is caution and right, too. A true on a false critical
    flag is a safety failure.
    """
    long = lambda df, name: df.select(*[c for c in ("model", "dish_id") if c in df.columns], F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias(name)) for f in flags])))
    both = long(pred, "p").join(long(truth, "t"), ["dish_id", "flag"])
    p, t = F.col("p"), F.col("t")
    if not count_nulls:
        both = both.where(p.isNotNull())
    right = p.eqNullSafe(t) | (t.isNull() & (p == F.lit(False)))
    unknown = t.isNull()
    return both.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("accuracy"),
        F.try_divide(F.count_if(unknown & (p == F.lit(False))), F.count_if(unknown)).alias("conservatism"),
        F.count_if((p == F.lit(True)) & (t == F.lit(False)) & F.col("flag").isin(critical)).alias("safety_failures"),
        F.count_if((p == F.lit(False)) & (t == F.lit(True))).alias("false_negatives"),
    )


def theme_coverage(out: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of expected themes (array) of which a word over three letters occurs in the summary."""
    t = truth.select("dish_id", F.explode("themes").alias("theme"))
    words = F.filter(F.split(F.lower("theme"), r"\s+"), lambda w: F.length(w) > 3)
    both = out.select("model", "dish_id", F.lower("summary").alias("summary")).join(t, "dish_id")
    hit = F.exists(words, lambda w: F.contains(F.col("summary"), w))
    return both.groupBy("model").agg(F.avg(hit.cast("double")).alias("coverage"))


def eval_report(scores: DataFrame, monthly: int = 1000) -> DataFrame:
    """Means over runs per model, projected monthly cost, and whether it is the most accurate one."""
    r = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("accuracy").alias("accuracy"), F.sum("safety_failures").alias("safety_failures"), F.avg("latency_ms").alias("latency_ms"), (F.avg("cost") * monthly).alias("monthly_cost")
    )
    best = F.max_by("model", F.struct("accuracy", "model")).over(Window.partitionBy(F.lit(1)))  # a row a model
    return r.withColumn("is_best", F.col("model") == best)


def cleanup_report(df: DataFrame, reason: str, name: str, samples: int = 3) -> DataFrame:
    """Rows by reason, most first, with a few least names."""
    w = Window.partitionBy(reason).orderBy(name)
    few = df.where(F.col(reason).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples)
    few = few.groupBy(reason).agg(F.array_sort(F.collect_list(name)).alias("samples"))
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n")).join(few, reason).orderBy(F.desc("n"), reason)


def menu_by_category(dishes: DataFrame) -> DataFrame:
    """A restaurant's menu as one row a section ("Other" for none), dishes by name."""
    entry = F.struct("name", "dish_id", "price")
    return dishes.groupBy("restaurant_id", F.coalesce("category", F.lit("Other")).alias("section")).agg(F.array_sort(F.collect_list(entry)).alias("dishes"))


def page_with_total(df: DataFrame, order: list, limit: int, offset: int) -> tuple[DataFrame, int]:
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


def update_area_totals(areas: DataFrame, found: DataFrame) -> DataFrame:
    n = found.groupBy("area_id").agg(F.count(F.lit(1)).alias("last_found"))
    out = areas.drop("last_found").join(n, "area_id", "left").withColumn("last_found", F.coalesce("last_found", F.lit(0)))
    return out.withColumn("total_found", F.col("total_found") + F.col("last_found"))


