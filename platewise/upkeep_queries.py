"""More registered queries: names, detectors, sources, filters, projections and upkeep.

Where a rule judges texts, each row of the table gets one of some labelled examples by its key, and the
SQL states the labels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import categories as C
from platewise.functions import flags as FG
from platewise.functions import numbers as N
from platewise.functions import text as T
from platewise.operators import aggregates as A
from platewise.operators import filters as FL
from platewise.operators import joins as J
from platewise.operators import rank as R
from platewise.operators import sinks as K
from platewise.plans import nutrition as NU
from platewise.plans import scorers as UD
from platewise.plans import search as SE
from platewise.plans import vector_index as V
from platewise.queries import NOW, QUERIES, SQL, now, query, r6, wait_sql
from platewise.sources import feeds as FE
from platewise.sources import menus as M
from platewise.sources.bindings import bound, with_sql
from platewise.sources.stored import stored_path
from platewise.streaming import limits as L

__all__ = ["QUERIES", "SQL"]


def example(key: str | Column, rows: list[tuple], i: int) -> Column:
    """The ``i``-th value of the example that a key has."""
    k = F.col(key) if isinstance(key, str) else key
    return F.element_at(F.array(*[F.lit(r[i]).cast("string") for r in rows]), (k % len(rows) + 1).cast("int"))


def labels_sql(rows: list[tuple], names: list[str], first: int) -> str:
    """``c(i, ...)``: what is said of each example."""

    def lit(v):
        return "null" if v is None else str(v).lower() if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"

    values = ", ".join("(" + ", ".join([str(i), *map(lit, r[first:])]) + ")" for i, r in enumerate(rows))
    return f"(values {values}) c(i, {', '.join(names)})"


def labelled(rows: list[tuple], names: list[str], first: int) -> str:
    return f"select p_partkey, {', '.join(names)} from part join {labels_sql(rows, names, first)} on i = p_partkey % {len(rows)}"


def parts(spark, sf_dir, *cols: str) -> DataFrame:
    return FE.load(spark, sf_dir, "part", ["p_partkey", *cols])


def joined(c) -> Column:
    return F.array_join(c, "|")


# --- detectors --------------------------------------------------------------------------------

# name, section; whether it is a listing. "Classico" holds the name of a mixed drink, and those are sought inside words.
DRINKS = [
    ("Pinot Noir", None, True), ("Chardonnay", None, True), ("Cabernet Sauvignon", None, True), ("Barolo", None, True), ("Prosecco", None, True), ("Barolo Bussia 2021", None, True),
    ("Marchese Antinori Chianti 2019", None, True), ("Some Random Name", "Red Wine", True), ("House Selection", "By the Glass", True), ("Reserve Blend", "Wine List", True), ("Grand Marnier", None, True),
    ("Don Julio 1942 Añejo", None, True), ("Mezcal Union Uno Joven", None, True), ("Ketel One Vodka", None, True), ("Bulleit", "Bourbon", True), ("Patron Silver", "Tequila", True), ("Greenport IPA", None, True),
    ("Brooklyn Lager", None, True), ("6% abv – New York", None, True), ("Stella Artois", "Draft Beer", True), ("Blue Moon", "On Tap", True), ("Vodka Rigatoni", None, False), ("Spicy Shrimp Vodka Rigatoni", None, False),
    ("Bourbon Glazed Ribs", None, False), ("Baked Eggs Alla Vodka", None, False), ("Tequila Lime Shrimp", None, False), ("Rum Cake", None, False), ("Whiskey Burger", None, False), ("Cabernet Braised Short Ribs", None, False),
    ("Mezcal Me Maybe", None, False), ("Basil Gimlet", None, False), ("Tequila Sunrise", "Mimosas", False), ("Vodka Martini", None, False), ("Busnel Calvados", None, True), ("Julius Marc de Galilee", None, True),
    ("Patron Tequila", None, True), ("Vodka Stolichnaya", None, True), ("Gin & Juice Remix", None, False), ("Sandeman Tawny Port", None, True), ("Port Wine Reduction", None, False), ("Marsala Sauce", None, False),
    ("Sherry Vinegar Glaze", None, False), ("Luxardo Sambuca", None, True), ("Luxardo Sambuca Classico", None, False), ("House Pour", "By the bottle", True), ("Brut Rosé", "Sparkling", True), ("Anything", "Champage Selections", True), ("Night Cap", "After Dinner Menu", True),
    ("Ruby", "Ports", True), ("Porter House", None, False), ("Cloudy 6.5% ABV", None, True), ("Aperol Spritz", None, False), ("Chicken Curry", None, False), ("Rum Raisin Soft Serve", "Rum Cakes", False), (None, None, False),
]


@query("wines_and_spirits", labelled(DRINKS, ["listed"], 2))
def wines_and_spirits(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.select("p_partkey", C.is_wine_or_spirit(example("p_partkey", DRINKS, 0), example("p_partkey", DRINKS, 1)).alias("listed"))


JUNK = [
    ("Margarita", None, None, "drink"), ("Old Fashioned", None, None, "drink"), ("Sangria Pitcher", None, None, "drink"), ("Chicken Margherita Pizza", None, None, None), ("Mango Lassi", None, None, "drink"),
    ("Free Parking", None, None, "junk"), ("Rooftop", None, "pool and gym access", "junk"), ("Sunday", None, None, "junk"), ("French Fries", None, None, "side"), ("Ranch (2 oz)", None, None, "side"),
    ("Side of Rice", None, None, "side"), ("Noodle Refill", None, None, "side"), ("6 pcs", None, None, "side"), ("Lamb Vindaloo", "Cocktails", None, "drink"), ("2019 | Barolo Riserva", None, None, "drink"),
    ("2019 | Merlot", None, None, "drink"), ("Beef Stew", None, "cooked in beer", None), ("Ax", None, None, "junk"), ("Shrimp Boil with " + "a" * 75, None, None, None), ("Call 212-555-0100", None, None, "junk"),
    ("Key Card", None, None, "junk"), ("Patio Available", None, None, "junk"), ("Happy Hour 5 to 7", None, None, "junk"), ("Plates", None, "we use locally sourced produce", "junk"),
    ("Notice", None, "consuming raw or undercooked meats", "junk"), ("Hair Dryer", None, None, "junk"), ("Doorman", None, None, "junk"), ("24-hour Desk", None, None, "junk"), ("Near Times Square", None, None, "junk"),
    ("Sauce Choices", None, "see blackboard", "junk"), ("Kae-dama", None, None, "side"), ("Tonkotsu (Noodle Refill)", None, None, "side"), ("Spare Ribs", None, None, None),
]


@query("junk_labels", labelled(JUNK, ["reason"], 3))
def junk_labels(spark, sf_dir):
    name, category, description = (example("p_partkey", JUNK, i) for i in range(3))
    return parts(spark, sf_dir).select("p_partkey", C.junk_reason(name, category, description).alias("reason"))


RULES = [  # name, category; food, worth, dish, cocktail, dessert, combo, kids, basic
    ("Chicken Pad Thai", None, True, True, True, False, False, False, False, False),
    ("Chocolate Cake", "Desserts", True, True, True, False, True, False, False, False),
    ("Kids Chicken Combo", None, True, True, True, False, False, True, True, False),
    ("Coke", "Beverages", True, False, True, False, False, False, False, True),
    ("Negroni", "Bar", True, True, True, True, False, False, False, False),
    ("Side of Sauce", None, True, False, True, False, False, False, False, False),
    ("http://menu.example", None, False, True, False, False, False, False, False, False),
    ("Large", None, True, False, True, False, False, False, False, False),
    ("Ketchup", None, True, False, False, False, False, False, False, False),
    ("Ridge Estate Lytton Springs", None, True, True, False, False, False, False, False, False),
    ("Opus One 2015", None, True, True, False, False, False, False, False, False),
    ("House Dressing 2 oz", None, True, True, False, False, False, False, False, False),
    ("Open 11:30 Daily", None, True, True, False, False, False, False, False, False),
    ("Macallan 12 Year", None, True, True, False, False, False, False, False, False),
    ("miso black cod with rice", None, True, True, True, False, False, False, False, False),
    ("Inferno", None, True, True, True, False, False, False, False, False),
    ("Weekend Brunch Events", None, True, True, False, False, False, False, False, False),
    ("Dinner for 2 Bundle", None, True, True, False, False, False, True, False, False),
    ("Mojito Sorbet", None, True, True, True, True, True, False, False, False),
    ("Gluten Free Option", None, True, False, True, False, False, False, False, False),
    ("Lunch Special", None, True, False, True, False, False, False, False, False),
    ("Mojito", "Drinks", True, True, True, True, False, False, False, False),
    ("12.50", None, False, True, False, False, False, False, False, False),
]


@query("dish_rules", labelled(RULES, ["food", "worth", "dish", "cocktail", "dessert", "combo", "kids", "basic"], 2))
def dish_rules(spark, sf_dir):
    n, c = example("p_partkey", RULES, 0), example("p_partkey", RULES, 1)
    return parts(spark, sf_dir).select(
        "p_partkey", C.likely_food(n, F.lit(None).cast("string")).alias("food"), C.worth_recommending(n, c).alias("worth"), C.looks_like_dish(n).alias("dish"), C.is_cocktail(n, c).alias("cocktail"),
        C.is_dessert(n, c).alias("dessert"), C.is_combo(n).alias("combo"), C.is_kids(n).alias("kids"), C.is_basic_drink(n).alias("basic"),
    )


TYPES = [  # name, category; pre-tag, type, promoted
    ("Tiramisu", None, "dessert", "dessert", True), ("Mashed Potato", "Side Dishes", "side", "side", False), ("Extra Cheese", "Add-ons", "addon", "addon", False), ("Ranch Cup", "Sauces", "condiment", "condiment", False),
    ("Mini Burger", "Kids Menu", "kids", "kids", False), ("Family Meal Deal", None, "combo", "combo", False), ("Merlot", None, "alcohol", "alcohol", False), ("Margarita", None, "drink", "drink", True),
    ("Coke", None, "drink", "drink", False), ("Chicken Curry", None, "unknown", "dish", True), ("Free Wifi", None, "unknown", "non_food", False), ("Ketchup", None, "unknown", "condiment", False),
    ("Gift Card", None, "unknown", "non_food", False), ("Extra Rice", None, "unknown", "side", False),
]


@query("item_types", labelled(TYPES, ["pretag", "item_type", "promoted"], 2))
def item_types(spark, sf_dir):
    n, c = example("p_partkey", TYPES, 0), example("p_partkey", TYPES, 1)
    out = parts(spark, sf_dir).select("p_partkey", n.alias("name"), c.alias("category"))
    out = out.withColumn("item_type", C.classify("name", "category", F.lit(None).cast("string")))
    return out.select("p_partkey", C.pretag("name", "category").alias("pretag"), "item_type", C.promotable("item_type", "name", "category").alias("promoted"))


@query(
    "place_types",
    """select p_partkey, case p_partkey % 4 when 0 then 'Thai|Greek' when 1 then '' when 2 then 'Korean' else 'Thai' end as cuisines, case p_partkey % 3 when 0 then 1 when 1 then 4 end as price_level from part""",
)
def place_types(spark, sf_dir):
    k = F.col("p_partkey")
    types = F.when(k % 4 == 0, "thai_restaurant bar greek_restaurant").when(k % 4 == 1, "bar cafe").when(k % 4 == 2, "korean_restaurant").otherwise("thai_restaurant thai_restaurant")
    code = F.when(k % 3 == 0, "PRICE_LEVEL_INEXPENSIVE").when(k % 3 == 1, "PRICE_LEVEL_VERY_EXPENSIVE").otherwise("PRICE_LEVEL_UNSPECIFIED")
    return parts(spark, sf_dir).select("p_partkey", joined(C.cuisines(F.split(types, " "))).alias("cuisines"), C.price_level(code).alias("price_level"))


# --- texts ------------------------------------------------------------------------------------


@query(
    "text_rules",
    """select p_partkey, p_name || ' & <x> é 😀 "' as decoded, p_name || ' x' as spaced, '''' || p_name || ''' - "x"...' as plain, p_name as wine, 'Elm ' || p_partkey as city, case when p_partkey % 2 = 0 then 'NY' end as state,
  p_partkey % 101 as pct, 1000 + p_partkey as votes, lower(p_name) || ' v2' as eval_key, p_partkey % 3 = 0 as glp1, case p_partkey % 4 when 0 then 1.0 when 1 then 0.0 when 2 then 0.5 else 0.0 end as address from part""",
)
def text_rules(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    rating = T.parse_rating(F.concat(k % 101, F.lit("% ("), F.format_number(k + 1000, 0), F.lit(")")))
    place = T.parse_address(F.concat(F.lit("1 Road, Elm "), k, F.when(k % 2 == 0, ", NY 10001, USA").otherwise(", Kent, UK")))
    one = F.concat(F.when(k % 4 == 2, "Main Street, ").otherwise("12 Main Street, "), k)
    two = F.when(k % 4 == 0, "12 main street").when(k % 4 == 1, "13 Main Street, NY").when(k % 4 == 2, "Main Street").otherwise(None)
    return parts(spark, sf_dir, "p_name").select(
        "p_partkey", T.decode_entities(F.concat(n, F.lit(" &amp; &lt;x&gt; &#233; &#x1F600; &quot;"))).alias("decoded"), T.norm_space(F.concat(F.lit("  "), n, F.lit(" \t x "))).alias("spaced"),
        T.norm_unicode(F.concat(F.lit("‘"), n, F.lit("’ – “x”…"))).alias("plain"), T.strip_wine_number(F.concat(F.lit("204 "), n, F.lit(" [GLS]"))).alias("wine"), place["city"].alias("city"), place["state"].alias("state"),
        rating["pct"].cast("bigint").alias("pct"), rating["n"].cast("bigint").alias("votes"), T.eval_key(F.concat(F.upper(n), F.lit("!  (v2)"))).alias("eval_key"),
        T.glp1_label(n, F.when(k % 3 == 0, "Our GLP-1 friendly plate")).alias("glp1"), T.address_similarity(one, two).cast("decimal(2,1)").alias("address"),
    )


@query(
    "food_phrases",
    """select p_partkey, case p_partkey % 3 when 0 then 'lox' when 1 then p_name else array_to_string(list_concat([p_name || ' with lemon butter', p_name, split_part(p_name, ' ', 2) || ' lemon', 'citrus butter'],
    list_filter(string_split(p_name, ' '), lambda w: length(w) > 4), ['citron', 'butter']), '|') end as phrases,
  cast(100 + p_partkey % 900 as double) as calories, cast(p_partkey % 90 as double) as protein, case when p_partkey % 2 = 0 then cast(p_partkey % 50 as double) end as carbs from part""",
)
def food_phrases(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    carbs = F.when(k % 2 == 0, F.concat(F.lit(" and "), k % 50, F.lit(" g of carbs"))).otherwise("")
    page = F.concat(F.lit("Our menu. "), F.upper(n), F.lit(" has "), 100 + k % 900, F.lit(" kcal, "), k % 90, F.lit(" g protein"), carbs, F.lit("."))
    near = T.nutrition_near(page, n)
    name = F.when(k % 3 == 0, "Smoked Salmon").when(k % 3 == 1, F.concat(F.lit("Grilled "), n)).otherwise(F.concat(F.lit("Fresh "), n, F.lit(" with Lemon  Butter")))
    synonyms = {"smoked salmon": "lox", "lemon butter": "citrus butter", "lemon": "citron"}
    return parts(spark, sf_dir, "p_name").select("p_partkey", joined(T.food_queries(name, synonyms)).alias("phrases"), near["calories"].alias("calories"), near["protein"].alias("protein"), near["carbs"].alias("carbs"))


@query(
    "ingredients",
    """select p_partkey, case p_partkey % 4 when 0 then replace(p_name, ' ', ', ') when 1 then 'rice, ' || replace(p_name, ' ', ', ') when 2 then p_name end as ingredients,
  case p_partkey % 3 when 0 then 'vegan' when 1 then 'gluten_free|spicy' else '' end as tags, case p_partkey % 3 when 0 then '*' when 1 then '' else '†' end as marks from part""",
)
def ingredients(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    listed = F.replace(n, F.lit(" "), F.lit(", "))
    text = F.when(k % 4 == 0, F.concat(F.lit("Contains: "), listed, F.lit("."))).when(k % 4 == 1, F.concat(F.lit("rice, "), listed)).when(k % 4 == 2, F.concat(F.lit("Crisp, served with "), n)).otherwise(n)
    raw = F.concat(n, F.when(k % 3 == 0, " (VG)*").when(k % 3 == 1, " (gf) 🌶").otherwise("†"))
    a = M.raw_annotations(raw, F.lit(None).cast("string"))
    return parts(spark, sf_dir, "p_name").select("p_partkey", M.ingredients_from_description(text).alias("ingredients"), joined(a["tags"]).alias("tags"), joined(a["marks"]).alias("marks"))


@query(
    "array_fields",
    """select p_partkey, p_partkey % 2 = 0 as meets, case when p_partkey % 2 = 0 then 'Thai|a|b' else 'x|a|b' end as merged, 'a, b' as said, case when p_partkey % 3 = 0 then 'none' else 'a' end as first from part""",
)
def array_fields(spark, sf_dir):
    k = F.col("p_partkey")
    mine = F.array(F.when(k % 2 == 0, "Thai").otherwise("x"), F.lit("a"))
    some = F.array(F.lit("a"), F.lit("b"))
    return parts(spark, sf_dir).select(
        "p_partkey", FG.overlaps(mine, ["THAI", "Greek"]).alias("meets"), joined(FG.arrays_union(mine, F.lit(None).cast("array<string>"), some)).alias("merged"), FG.arrays_join(some).alias("said"),
        FG.arrays_first(F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(some), "none").alias("first"),
    )


# --- sources ----------------------------------------------------------------------------------


@query(
    "item_annotations",
    with_sql("dishes")
    + """ select restaurant_id as page_id, lower(name) || ' ' || dish_id as name, calories_min as calories, cast(floor(protein_min) as int) as protein, case when dish_id % 2 = 0 then 'milk|nuts' else '' end as allergens,
  case when dish_id % 2 = 1 then 'rice|egg' else '' end as ingredients from dishes""",
)
def item_annotations(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    said = F.when(F.col("dish_id") % 2 == 0, "Contains: milk, nuts.").otherwise("Ingredients: rice, egg.")
    entry = F.concat(F.lit("<li><h3>"), "name", F.lit(" "), "dish_id", F.lit("</h3><p>"), "calories_min", F.lit(" cal, "), F.floor("protein_min"), F.lit("g protein. "), said, F.lit("</p></li>"))
    pages = d.groupBy(F.col("restaurant_id").alias("page_id")).agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(entry), ""), F.lit("</ul>")).alias("html"))
    out = M.menu_item_annotations(pages)
    return out.select("page_id", "name", "calories", "protein", joined("allergens").alias("allergens"), joined("ingredients").alias("ingredients"))


@query(
    "review_feeds",
    """select o_orderkey % 50 as restaurant_id, 'order ' || o_orderkey as text, cast(1 + o_orderkey % 5 as double) as rating, 'u' || o_custkey as author, o_orderdate as date, case when o_orderkey % 2 = 0 then 'google' else 'yelp' end as source from orders""",
)
def review_feeds(spark, sf_dir):
    o = FE.load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    k, who = F.col("o_orderkey"), F.concat(F.lit("u"), F.col("o_custkey"))
    base = [(k % 50).alias("restaurant_id"), F.concat(F.lit("order "), k).alias("text"), (1 + k % 5).alias("rating")]
    google = o.where(k % 2 == 0).select(*base, who.alias("author_name"), F.col("o_orderdate").alias("publish_time"))
    yelp = o.where(k % 2 == 1).select(*base, F.struct(who.alias("name")).alias("user"), F.col("o_orderdate").alias("time_created"))
    return FE.normalise_reviews(google, yelp)


@query("forecast_hours", with_sql("grid") + " select 'v' || restaurant_id as venue_name, dow as day, hour, cast(floor(busyness / 10) * 10 as int) as busyness, busyness >= 80 as is_peak, busyness < 20 as is_quiet from grid")
def forecast_hours(spark, sf_dir):
    (g,) = bound(spark, sf_dir, "grid")
    hours = F.collect_list(F.struct(F.col("hour"), F.floor(F.col("busyness") / 10).cast("double").alias("intensity_nr"))).alias("hour_analysis")
    pick = lambda c: F.collect_list(F.when(c, F.col("hour")))
    day = g.groupBy("restaurant_id", "dow").agg(hours, pick(F.col("busyness") >= 80).alias("busy_hours"), pick(F.col("busyness") < 20).alias("quiet_hours"))
    day = day.select(F.concat(F.lit("v"), "restaurant_id").alias("venue_name"), F.struct(F.struct(F.col("dow").alias("day_int")).alias("day_info"), "hour_analysis", "busy_hours", "quiet_hours").alias("d"))
    return FE.flatten_forecast(day.groupBy("venue_name").agg(F.collect_list("d").alias("analysis")))


@query(
    "food_nutrients",
    "select p_partkey, p_name as description, 10.0 + p_partkey % 500 as calories, case when p_partkey % 3 = 0 then 0.0 else p_partkey % 70 end as protein, 1.0 * (p_partkey % 40) as carbs, 2.5 as fat, 0.0 as fiber from part",
)
def food_nutrients(spark, sf_dir):
    k = F.col("p_partkey")
    of = lambda i, v: F.struct(F.lit(i).alias("nutrientId"), v.cast("double").alias("value"))
    known = F.array(of(1004, F.lit(2.5)), of(1005, k % 40), of(1008, 10 + k % 500))
    foods = parts(spark, sf_dir, "p_name").select(k.alias("fdcId"), F.col("p_name").alias("description"), F.lit("Foundation").alias("dataType"), F.when(k % 3 == 0, known).otherwise(F.concat(known, F.array(of(1003, k % 70)))).alias("foodNutrients"))
    return NU.food_macros(foods).select(F.col("fdcId").alias("p_partkey"), "description", "calories", "protein", "carbs", "fat", "fiber")


@query("analyses", "select event_id, case when event_id % 4 = 0 then null else cast(json_extract(props, '$.k') as int) end as k, case when event_id % 4 = 0 then 'not the expected JSON' end as error from events")
def analyses(spark, sf_dir):
    e = FE.load(spark, sf_dir, "events", ["event_id", "props"])
    text = F.when(F.col("event_id") % 4 == 0, "I cannot tell.").when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    good, bad = FE.parse_analysis(e.withColumn("text", text), "text", "k int")
    none = F.lit(None)
    return good.select("event_id", F.col("parsed.k").alias("k"), none.cast("string").alias("error")).unionByName(bad.select("event_id", none.cast("int").alias("k"), "error"))


@query("corrected_labels", with_sql("dishes") + " select dish_id, case when lower(name) in ('small ring', 'red widget') then 'side' else category end as expected_type from dishes")
def corrected_labels(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    fixes = d.select(F.upper("name").alias("name"), F.lit("side").alias("correct_type")).where("name in ('SMALL RING', 'RED WIDGET')")
    return FE.corrected_truth(d.select("dish_id", "name", F.col("category").alias("expected_type")), fixes).select("dish_id", "expected_type")


@query(
    "backfill_items",
    with_sql("dishes")
    + " select dish_id, lower(name) as name_normalized, 'backfill' as source, case when is_available then 'dish' else 'unknown' end as item_type from dishes d where not exists (select 1 from dishes e where e.vegan and e.restaurant_id = d.restaurant_id and lower(e.name) = lower(d.name))",
)
def backfill_items(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    have = d.where("vegan").select("restaurant_id", F.lower("name").alias("name_normalized"))
    return FE.backfill_menu_items(d, have).select("dish_id", "name_normalized", "source", "item_type")


@query("union_sources", "select c_custkey as id, 'customer' as kind, c_name as name, null as extra from customer union all select s_suppkey, 'supplier', s_name, 'x' from supplier")
def union_sources(spark, sf_dir):
    c = FE.load(spark, sf_dir, "customer", ["c_custkey", "c_name"]).select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    s = FE.load(spark, sf_dir, "supplier", ["s_suppkey", "s_name"]).select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.lit("x").alias("extra"))
    return FE.union_sources(c, s)


@query(
    "union_first",
    "with t as (select lower(p_name) as k, p_name as name, 1 as tier from part union all select lower(p_type), lower(p_type), 0 from part union all select lower(p_name), upper(p_name), 2 from part), f as (select k, min((tier, name)) as m from t group by 1) select m[2] as name, m[1] as tier from f order by tier, name limit 40",
)
def union_first(spark, sf_dir):
    p = parts(spark, sf_dir, "p_name", "p_type")
    return FE.union_first([p.select(F.lower("p_type").alias("name")), p.select(F.col("p_name").alias("name")), p.select(F.upper("p_name").alias("name"))], "name", 40)


# --- filters ----------------------------------------------------------------------------------


@query("cuisine_overlap", with_sql("restaurants") + " select restaurant_id from restaurants where cuisine in ('Thai', 'Greek')")
def cuisine_overlap(spark, sf_dir):
    (r,) = bound(spark, sf_dir, "restaurants")
    return FL.cuisine_filter(r.withColumn("cuisines", F.array("cuisine", F.lit("Fusion"))), ["thai", "GREEK"]).select("restaurant_id")


@query("stale_items", with_sql("items") + " select item_id, line from items where line % 5 = 0 or last_seen_at < timestamp '1998-06-01' - interval 90 day")
def stale_items(spark, sf_dir):
    (i,) = bound(spark, sf_dir, "items")
    i = i.withColumn("done_at", F.when(F.col("line") % 5 != 0, F.col("last_seen_at")))
    return FL.stale(i, "done_at", 90, F.expr("timestamp_ntz '1998-06-01 00:00:00'")).select("item_id", "line")


@query(
    "due_areas",
    """with a as (select c_custkey as area_id, c_nationkey % 4 as priority, 1 + c_custkey % 30 as days, case when c_custkey % 6 <> 0 then timestamp '2024-01-01' + to_days(cast(c_custkey % 30 as int)) end as last from customer)
select area_id from a where last is null or last < timestamp '2024-01-31' - to_days(cast(days as int)) order by priority, last nulls first, area_id limit 50""",
)
def due_areas(spark, sf_dir):
    c = FE.load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    k = F.col("c_custkey")
    last = F.when(k % 6 != 0, F.expr("timestamp_ntz '2024-01-01 00:00:00'") + F.make_dt_interval(days=(k % 30).cast("int")))
    areas = c.select(k.alias("area_id"), (F.col("c_nationkey") % 4).alias("priority"), (1 + k % 30).cast("int").alias("interval_days"), last.alias("last_discovered_at"))
    return FL.due_areas(areas, F.expr("timestamp_ntz '2024-01-31 00:00:00'"), 50).select("area_id")


QUEUE = "case when line = 3 then 'unknown' else 'dish' end"


@query(
    "review_queue",
    with_sql("items")
    + f""", i as (select *, {QUEUE} as item_type, line <= 4 as card, case when line <> 2 then audit_confidence end as score from items where source <> 'R')
select 'low_confidence' as mode, item_id, line from i where audit_confidence < 0.7 union all select 'unknown', item_id, line from i where item_type = 'unknown' union all select 'unscored', item_id, line from i where card and score is null""",
)
def review_queue(spark, sf_dir):
    (i,) = bound(spark, sf_dir, "items")
    i = i.withColumn("item_type", F.expr(QUEUE)).withColumn("is_dish_card", F.col("line") <= 4).withColumn("dish_card_confidence", F.when(F.col("line") != 2, F.col("audit_confidence")))
    i = i.withColumn("source", F.when(F.col("source") == "R", "backfill").otherwise(F.col("source")))
    frames = [FL.review_queue(i, m).select(F.lit(m).alias("mode"), "item_id", "line") for m in ("low_confidence", "unknown", "unscored")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


PLACES = [("Hilton Midtown", "bar", True), ("Thai Inn", "restaurant", True), ("Innsbruck Grill", "restaurant", False), ("Corner Deli", "grocery_store", True), ("Corner Deli", "restaurant", False), ("Spa Cafe", "cafe", False)]


@query("non_restaurants", f"select s_suppkey from supplier join {labels_sql(PLACES, ['gone'], 2)} on i = s_suppkey % {len(PLACES)} where gone")
def non_restaurants(spark, sf_dir):
    s = FE.load(spark, sf_dir, "supplier", ["s_suppkey"])
    s = s.select("s_suppkey", example("s_suppkey", PLACES, 0).alias("name"), F.array(F.lit("point"), example("s_suppkey", PLACES, 1)).alias("types"))
    return FL.non_restaurant(s).select("s_suppkey")


FORMATS = [
    ("Beef Stew", "good", "$12", "", ""), ("Ox", "good", "$12", "name_too_short", ""), ("x" * 81, "good", "$12", "name_too_long", ""), ("Beef <b>Stew", "good", "$12", "markup", ""), ("Beef Stew", "free parking", "$12", "junk", ""),
    ("12.50", "good", "$12", "only_digits", ""), ("1999 | Port", "good", "$900", "wine_code", "price_high"), ("Beef Stew", "", "", "", "no_description_or_price"), ("Beef Stew", "", "$0.10", "", "price_low"), (None, None, None, "name_too_short", "no_description_or_price"),
]


@query("item_formats", labelled(FORMATS, ["errors", "warnings"], 3))
def item_formats(spark, sf_dir):
    p = parts(spark, sf_dir).select("p_partkey", *[example("p_partkey", FORMATS, i).alias(c) for i, c in enumerate(("name", "description", "price"))])
    return FL.validate_items(p).select("p_partkey", joined("errors").alias("errors"), joined("warnings").alias("warnings"))


@query(
    "notifications_due",
    """with e as (select event_id, user_id, event_type as type, cast(extract(hour from ts) as int) as h from events), p as (select distinct user_id, user_id % 4 as k from events where user_id % 4 <> 0)
select event_id from e left join p using (user_id) where k is null or (k = 1 and type in ('click', 'view')) or (k = 2 and h >= 7 and h < 22) or (k = 3 and not (h >= 9 and h < 17))""",
)
def notifications_due(spark, sf_dir):
    e = FE.load(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "ts"]).select("event_id", "user_id", F.col("event_type").alias("type"), F.lit("push").alias("channel"), F.hour("ts").alias("hour"))
    k = F.col("user_id") % 4
    prefs = e.select("user_id").distinct().where(k != 0).select(
        "user_id", F.array(F.lit("push"), F.lit("mail")).alias("channels"), F.when(k == 1, F.array(F.lit("click"), F.lit("view"))).alias("types"),
        F.when(k == 2, 22).when(k == 3, 9).alias("quiet_from"), F.when(k == 2, 7).when(k == 3, 17).alias("quiet_to"),
    )
    return FL.eligible_notifications(e, prefs).select("event_id")


@query("old_summaries", "select p_partkey from part where p_partkey % 4 in (1, 2)")
def old_summaries(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "Guests say it is fine").when(k % 4 == 1, "The guests say").when(k % 4 == 2, F.col("p_name"))
    return FL.old_summaries(parts(spark, sf_dir, "p_name").withColumn("summary", F.when(k % 8 == 3, "").otherwise(text)), ["Guests say", "Diners"]).select("p_partkey")


@query("drinks_listed", f"select p_partkey from part join {labels_sql([*DRINKS, ('Coke', None, True), ('Tap Water', None, True)], ['listed'], 2)} on i = p_partkey % {len(DRINKS) + 2} where listed")
def drinks_listed(spark, sf_dir):
    rows = [*DRINKS, ("Coke", None, True), ("Tap Water", None, True)]
    p = parts(spark, sf_dir).select("p_partkey", example("p_partkey", rows, 0).alias("name"), example("p_partkey", rows, 1).alias("category"))
    return FL.drinks_listed(p).select("p_partkey")


@query(
    "request_prints",
    """select c_custkey, 'query:' || case when c_custkey % 2 = 0 then 'pad thai' else 'all' end || ':halal|vegan:none:none:default:cal' || case when c_custkey % 3 = 0 then '500' else 'none' end || ':protnone:alnone:waitnone:'
  || printf('%.3f', c_custkey % 90 + 0.25) || ',' || printf('%.3f', -74.0) || ':r2.0' as fingerprint from customer""",
)
def request_prints(spark, sf_dir):
    k = F.col("c_custkey")
    raw = FE.load(spark, sf_dir, "customer", ["c_custkey"]).select(
        k, k.cast("string").alias("limit"), F.when(k % 2 == 0, " Pad Thai ").alias("q"), (k % 90 + 0.25).cast("string").alias("lat"), F.lit("-74").alias("lng"), F.lit("vegan , Halal").alias("diet"),
        F.when(k % 3 == 0, "500").alias("calorie_limit"), *[F.lit(None).cast("string").alias(x) for x in ("radius", "goal", "protein_min", "cuisines", "max_wait", "sort", "categories", "allergens")], k.cast("string").alias("offset"),
    )
    return FL.query_fingerprint(FL.validate_requests(raw)).select("c_custkey", "fingerprint")


# --- projections ------------------------------------------------------------------------------


@query(
    "result_records",
    with_sql("dishes", "restaurants", "reviews", "grid")
    + f""" select d.dish_id, d.calories_max, r.restaurant_name, v.average_rating, {wait_sql("g.busyness")} as wait from dishes d join restaurants r using (restaurant_id) left join reviews v using (dish_id)
left join (select * from grid where dow = 1 and hour = 12) g using (restaurant_id) where d.is_available and r.is_active""",
)
def result_records(spark, sf_dir):
    from platewise.queries import _tables

    found = SE.candidates(*_tables(spark, sf_dir), SE.SearchSpec(dow=1, hour=12))
    out = SE.shape_results(found)
    return out.select("dish_id", F.col("macros.calories_max").alias("calories_max"), F.col("restaurant.restaurant_name").alias("restaurant_name"), F.col("review_summary.average_rating").alias("average_rating"), F.col("logistics.wait").alias("wait"))


@query(
    "macro_labels",
    with_sql("dishes")
    + """, x as (select dish_id, case dish_id % 4 when 0 then 'Published by restaurant' when 1 then 'Community data' when 2 then 'Estimated from photos' else 'Unknown' end as label, case when dish_id % 5 <> 0 then macro_confidence end as c from dishes)
select dish_id, label as macro_label, case when c is null then label else label || ' (' || cast(floor(c * 100 + 0.5) as int) || '% confidence)' end as macro_text from x""",
)
def macro_labels(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    k = F.col("dish_id")
    d = d.withColumn("macro_source", F.when(k % 4 == 0, "published").when(k % 4 == 1, "third_party").when(k % 4 == 2, "vision_ai"))
    d = d.withColumn("macro_confidence", F.when(k % 5 != 0, F.col("macro_confidence")))
    return SE.dish_detail(d).select("dish_id", "macro_label", "macro_text")


@query(
    "restaurant_records",
    with_sql("restaurants", "offers")
    + """, o as (select restaurant_id, string_agg(distinct 'p' || line, ',' order by 'p' || line) as d from offers where line <= 4 and line % 2 = 0 group by 1)
select restaurant_id, coalesce(d, '') as delivery from restaurants left join o using (restaurant_id)""",
)
def restaurant_records(spark, sf_dir):
    r, o = bound(spark, sf_dir, "restaurants", "offers")
    delivery = o.where("line <= 4").select("restaurant_id", F.concat(F.lit("p"), "line").alias("platform"), F.lit(1.5).alias("fee"), F.lit(30).alias("minutes"), (F.col("line") % 2 == 0).alias("is_available")).distinct()
    return SE.restaurant_detail(r, delivery).select("restaurant_id", F.array_join("delivery.platform", ",").alias("delivery"))


# --- joins ------------------------------------------------------------------------------------


@query("rated_dishes", with_sql("dishes", "reviews") + " select dish_id, name from dishes where dish_id in (select dish_id from reviews where average_rating >= 4)")
def rated_dishes(spark, sf_dir):
    d, v = bound(spark, sf_dir, "dishes", "reviews")
    return J.semi(d, v.where("average_rating >= 4"), "dish_id").select("dish_id", "name")


@query(
    "photo_files",
    """select p_partkey as id, case p_partkey % 4 when 3 then null else 'img/' || replace(lower(p_name), ' ', '-') || '-' || p_partkey || case p_partkey % 4 when 2 then '-v2.jpg' else '.jpg' end end as file,
  case p_partkey % 4 when 0 then 'exact' when 1 then 'case' when 2 then 'fuzzy' end as tier from part where p_partkey % 4 <> 3""",
)
def photo_files(spark, sf_dir):
    k = F.col("p_partkey")
    # one restaurant's names would be unlike each other; here the key keeps them apart
    name = F.concat("p_name", F.lit(" "), k)
    p = parts(spark, sf_dir, "p_name")
    dishes = p.select(k.alias("id"), F.when(k % 4 == 2, F.concat(name, F.lit("!"))).when(k % 4 == 3, F.md5(name)).otherwise(name).alias("name"))
    file = F.concat(F.lit("img/"), F.replace(F.lower(name), F.lit(" "), F.lit("-")), F.when(k % 4 == 2, "-v2.jpg").otherwise(".jpg"))
    file = F.when(k % 4 == 3, F.concat(F.lit("img/"), F.md5("p_name"), k, F.lit(".jpg"))).otherwise(file)
    files = p.select(file.alias("file"), F.when(k % 4 == 0, name).when(k % 4 == 1, F.upper(name)).otherwise("-").alias("name"))
    return J.match_photos(dishes, files)


@query(
    "business_ids",
    with_sql("restaurants")
    + " select restaurant_id, case restaurant_id % 3 when 0 then 'b2' when 1 then 'b3' else 'b1' end as business_id, case restaurant_id % 3 when 0 then 0 when 1 then 1 else 2 end as tier from restaurants",
)
def business_ids(spark, sf_dir):
    (r,) = bound(spark, sf_dir, "restaurants")
    k = F.col("restaurant_id")
    names = {1: F.lit("Other place"), 2: F.when(k % 3 == 0, F.upper("restaurant_name")).otherwise("Another"), 3: F.when(k % 3 == 2, "Third").otherwise(F.concat(F.lit("The "), "restaurant_name"))}
    frames = [r.select("restaurant_id", F.lit(i).alias("place"), F.lit(f"b{i}").alias("business_id"), c.alias("name")) for i, c in names.items()]
    return J.match_business(r.select("restaurant_id", F.col("restaurant_name").alias("name")), frames[0].unionByName(frames[1]).unionByName(frames[2]))


MENTIONS = [  # dish, review, whether it says so
    ("Stir-Fry Noodles", "the stir-fry noodles are great", True), ("Crispy Duck (Half)", "We had the Crispy Duck (half) again", True), ("Pad Thai", "the padded iPad", False), ("Pad", "an ipad on the table", True),
    ("Spicy Basil Chicken", "chicken with spicy basil", True), ("Spicy Basil Chicken", "basil chicken", False), ("House Salad", "a house of salad", False), ("Red Curry with Tofu", "Tofu in CURRY", True), ("Grilled Corn", "popcorn, grilled", False),
]


@query("review_mentions", f"select p_partkey as dish_id, p_partkey as review_id from part join {labels_sql(MENTIONS, ['hit'], 2)} on i = p_partkey % {len(MENTIONS)} where hit")
def review_mentions(spark, sf_dir):
    """Each dish with a restaurant and a review of its own."""
    p, k = parts(spark, sf_dir), F.col("p_partkey")
    dishes = p.select(k.alias("dish_id"), k.alias("restaurant_id"), example("p_partkey", MENTIONS, 0).alias("name"))
    reviews = p.select(k.alias("review_id"), k.alias("restaurant_id"), example("p_partkey", MENTIONS, 1).alias("text"))
    return J.reviews_for_dishes(dishes, reviews)


@query(
    "review_mentions_all",
    with_sql("dishes", "feedback")
    + """, r as (select feedback_id as review_id, d.restaurant_id, 'I liked the ' || lower(d.name) || ' here' as text from feedback join dishes d using (dish_id)),
w as (select dish_id, restaurant_id, lower(name) as name, list_filter(string_split(lower(name), ' '), lambda w: length(w) >= 4 and w <> 'plate') as words from dishes)
select distinct w.dish_id, r.review_id from w join r using (restaurant_id) where case when len(words) = 0 then contains(r.text, w.name)
  else regexp_matches(r.text, '\\b' || w.name || '\\b') or len(list_filter(words, lambda x: not regexp_matches(r.text, '\\b' || x || '\\b'))) = 0 end""",
)
def review_mentions_all(spark, sf_dir):
    d, f = bound(spark, sf_dir, "dishes", "feedback")
    reviews = f.join(d, "dish_id").select(F.col("feedback_id").alias("review_id"), "restaurant_id", F.concat(F.lit("I liked the "), F.lower("name"), F.lit(" here")).alias("text"))
    return J.reviews_for_dishes(d, reviews)


@query(
    "truth_labels",
    with_sql("dishes")
    + """, t as (select distinct lower(name) as b, 'general' as tr, 'g' as label from dishes where dairy_free union select distinct lower(name), cast(restaurant_id as varchar), 'own' from dishes where vegan
  union select split_part(lower(name), ' ', 1), 'general', 'head' from dishes)
select dish_id as item_id, b as truth_name, label from dishes d join t on (tr = 'general' or tr = cast(d.restaurant_id as varchar)) and (contains(lower(d.name), b) or contains(b, lower(d.name)))
qualify row_number() over (partition by dish_id order by tr = 'general', lower(d.name) <> b, length(b) desc, b, label) = 1""",
)
def truth_labels(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    place = F.col("restaurant_id").cast("string")
    truth = d.where("dairy_free").select(F.upper("name").alias("name"), F.lit("general").alias("restaurant"), F.lit("g").alias("label"))
    truth = truth.unionByName(d.where("vegan").select("name", place.alias("restaurant"), F.lit("own").alias("label")))
    truth = truth.unionByName(d.select(F.split("name", " ")[0].alias("name"), F.lit("general").alias("restaurant"), F.lit("head").alias("label")))
    return J.truth_match(d.select(F.col("dish_id").alias("item_id"), place.alias("restaurant"), "name"), truth)


@query(
    "food_matches",
    "with f as (select min(p_partkey) as food_id, p_name from part group by 2) select p_partkey as id, f.food_id, 1.0 as score from part join f using (p_name)",
)
def food_matches(spark, sf_dir):
    p = parts(spark, sf_dir, "p_name")
    foods = p.groupBy(F.col("p_name").alias("description")).agg(F.min("p_partkey").alias("food_id")).withColumn("data_type", F.lit("Foundation"))
    out = J.match_foods(p.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name")), foods, {})
    return out.select("id", "food_id", F.round("score", 6).cast("decimal(2,1)").alias("score"))


@query(
    "food_confidence",
    """select p_partkey, round(case p_partkey % 5 when 0 then 1.0 when 1 then 0.375 + 0.1 when 2 then 0.9 when 3 then 0.75 + 0.15 - 0.1 else 0.0 end, 6) as score from part""",
)
def food_confidence(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    query_ = F.when(k % 5 == 1, F.concat(F.split(n, " ")[0], F.lit(" qqq"))).when(k % 5 == 4, "qqq").otherwise(n)
    text = F.when(k % 5 == 3, F.concat(n, F.lit(" one two three four five six seven"))).otherwise(n)
    text = F.when(k % 5 == 1, F.concat(n, F.lit(" raw"))).otherwise(text)
    kind = F.when((k % 5 == 0) | (k % 5 == 1), "Foundation").otherwise("Branded")
    kind = F.when(k % 5 == 4, "Branded").otherwise(kind)
    return parts(spark, sf_dir, "p_name").select("p_partkey", r6(NU.food_confidence(text, query_, kind), "score"))


@query(
    "item_links",
    with_sql("dishes")
    + """, k as (select restaurant_id, lower(name) as k, min(dish_id) as found from dishes where is_available group by 1, 2)
select d.dish_id as item_id, case when d.dish_id % 3 = 0 then -1 else found end as dish_id from dishes d left join k on k.restaurant_id = d.restaurant_id and k.k = lower(d.name)""",
)
def item_links(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    items = d.select(F.col("dish_id").alias("item_id"), "restaurant_id", F.upper("name").alias("name"), F.when(F.col("dish_id") % 3 == 0, F.lit(-1)).cast("bigint").alias("dish_id"))
    return J.link_items(items, d.where("is_available")).select("item_id", "dish_id")


@query(
    "similar_in_reach",
    with_sql("dishes", "restaurants")
    + f""", v as (select dish_id, restaurant_id, lat, lng, (calories_min - 500) / 250.0 as a, (protein_min - 25) / 15.0 as b, (carbs_min - 45) / 30.0 as c, (fat_min - 20) / 15.0 as d from dishes join restaurants using (restaurant_id)),
s as (select * from v where dish_id = 7), x as (select v.dish_id, (v.a*s.a + v.b*s.b + v.c*s.c + v.d*s.d) / (sqrt(v.a*v.a + v.b*v.b + v.c*v.c + v.d*v.d) * sqrt(s.a*s.a + s.b*s.b + s.c*s.c + s.d*s.d)) as similarity
  from v, s where v.restaurant_id <> s.restaurant_id and {N.haversine_sql("v.lat", "v.lng", "s.lat", "s.lng")} <= 2.0)
select dish_id, round(similarity, 6) as similarity from x where similarity > 0.5 order by similarity desc, dish_id limit 25""",
)
def similar_in_reach(spark, sf_dir):
    d, r = bound(spark, sf_dir, "dishes", "restaurants")
    d = J.with_restaurant(d, r).withColumn("vec", N.macro_vector("calories_min", "protein_min", "carbs_min", "fat_min"))
    found = d.where("dish_id = 7").select("vec", "restaurant_id", "lat", "lng").first()
    if found is None:
        return d.select("dish_id", F.lit(0.0).alias("similarity")).limit(0)
    return R.similar(d, found.asDict(), min_similarity=0.5, n=25, miles=2.0).select("dish_id", r6(F.col("similarity"), "similarity"))


@query(
    "similar_names_in_reach",
    with_sql("restaurants")
    + rf""", n as (select restaurant_id as id, lower(restaurant_name) as n from restaurants where {N.haversine_sql("lat", "lng", 40.75, -73.97)} <= 2.0),
t as (select id, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(n, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) as t from n),
q as (select restaurant_id as id, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(restaurant_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) as t from restaurants),
s as (select q.id as query_id, t.id as row_id, len(list_intersect(q.t, t.t)) / cast(len(q.t) + len(t.t) - len(list_intersect(q.t, t.t)) as double) as score from q, t)
select query_id, row_id, round(score, 6) as score from s where score > 0.6 qualify row_number() over (partition by query_id order by score desc, row_id) <= 3""",
)
def similar_names_in_reach(spark, sf_dir):
    (r,) = bound(spark, sf_dir, "restaurants")
    named = r.select(F.col("restaurant_id").alias("id"), F.col("restaurant_name").alias("name"), "lat", "lng")
    return J.similar_names(named, named.select("id", "name"), 0.6, 3, 40.75, -73.97, 2.0).select("query_id", "row_id", r6(F.col("score"), "score"))


@query(
    "weighted_words",
    with_sql("dishes")
    + """ select dish_id, round(((case when name like '%ring' then 1.0 else 0 end) + (case when description like 'ring%' then 0.4 else 0 end)) / 3, 6) as rank
from (select dish_id, name, case when dish_id % 3 = 0 then 'rings' else 'bolts' end as description from dishes) where name like '%ring' or description like 'ring%'""",
)
def weighted_words(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    d = d.select("dish_id", "name", F.when(F.col("dish_id") % 3 == 0, "the rings").otherwise("of bolts").alias("description"))
    return SE.token_search(d, "RINGS", {"name": 1.0, "description": 0.4}, "dish_id", None).select("dish_id", r6(F.col("rank"), "rank"))


@query(
    "phrases_and_others",
    with_sql("dishes") + " select dish_id from dishes where (name = 'small ring' or name like '% bolt') and name <> 'red bolt' and description like '%grilled'",
)
def phrases_and_others(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    d = d.withColumn("text", F.concat(F.when(F.col("name") == "small ring", F.lit("bolt ")).otherwise(""), "name"))
    one = SE.token_search(d, '"grilled" bolt -red', {"text": 1.0, "description": 0.4}, "dish_id", None).select("dish_id")
    return one


@query(
    "search_words",
    with_sql("restaurants", "dishes")
    + """, f as (select dish_id, protein_max from dishes join restaurants using (restaurant_id) where is_available and is_active and name like '%gear' order by case when dish_id % 7 = 0 then 7 else 6 end, dish_id limit 200)
select * from f order by protein_max desc, dish_id limit 30""",
)
def search_words(spark, sf_dir):
    from platewise.queries import _tables

    spec = SE.SearchSpec(q="gears", goal="max_protein", sort="macro_match", limit=30, per_restaurant=1 << 30, per_cuisine=1 << 30)
    return SE.search(*_tables(spark, sf_dir), spec).select("dish_id", "protein_max")


@query(
    "search_sorts",
    with_sql("restaurants", "dishes", "grid")
    + f""", f as (select dish_id, {wait_sql("g.busyness")} as wait, floor({N.haversine_sql("lat", "lng", 40.75, -73.97)} * 100 + 0.5) / 100 as distance from dishes join restaurants using (restaurant_id)
  left join (select * from grid where dow = 1 and hour = 12) g using (restaurant_id) where is_available and is_active)
select * from (select dish_id, 'wait_time' as sort from f order by coalesce(wait, 1e9), dish_id limit 40) union all select * from (select dish_id, 'distance' from f order by distance, dish_id limit 40)""",
)
def search_sorts(spark, sf_dir):
    from platewise.queries import _tables

    base = {"lat": 40.75, "lng": -73.97, "radius": None, "dow": 1, "hour": 12, "limit": 40, "per_restaurant": 1 << 30, "per_cuisine": 1 << 30}
    frames = [SE.search(*_tables(spark, sf_dir), SE.SearchSpec(sort=m, **base)).select("dish_id", F.lit(m).alias("sort")) for m in ("wait_time", "distance")]
    return frames[0].unionByName(frames[1])


@query(
    "fuzzy_items",
    "select p_partkey as left_id, p_partkey as right_id from part where length(p_name) >= 5",
)
def fuzzy_items(spark, sf_dir):
    """Names with a letter too many, in restaurants of one dish each; the best partner is the dish itself."""
    p = parts(spark, sf_dir, "p_name").where("length(p_name) >= 5")
    dishes = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("restaurant_id"), F.col("p_name").alias("name"))
    items = dishes.withColumn("name", F.concat(F.upper("name"), F.lit("s")))
    return J.match_items(items, dishes).select("left_id", "right_id")


@query(
    "vetoed_places",
    with_sql("restaurants") + " select restaurant_id as left_id, restaurant_id as right_id from restaurants where restaurant_id % 3 <> 1",
)
def vetoed_places(spark, sf_dir):
    """Names unlike all others: another house number keeps a pair apart, a missing one does not if the street is the same."""
    (r,) = bound(spark, sf_dir, "restaurants")
    k = F.col("restaurant_id")
    ours = r.select(k.alias("id"), F.md5("restaurant_name").alias("name"), F.concat(k + 1000, F.lit(" Main Street, New York")).alias("address"))
    theirs = ours.withColumn("address", F.when(F.col("id") % 3 == 1, F.concat(F.col("id") + 90_000, F.lit(" Main Street"))).when(F.col("id") % 3 == 2, "Main Street, NY").otherwise(F.col("address")))
    return J.match_places(ours, theirs, 0.75).select("left_id", "right_id")


# --- upkeep -----------------------------------------------------------------------------------

LATE = "timestamp '1998-06-01 00:00:00'"


def late() -> Column:
    return F.expr("timestamp_ntz '1998-06-01 00:00:00'")


@query(
    "archive_and_restore",
    with_sql("items")
    + f""", a as (select *, archived_at is null and last_seen_at < timestamp '1993-01-01' as hit from items)
select item_id, line, case when line = 2 then null when hit then {LATE} else archived_at end as archived_at, case when line <> 2 and hit then 'menu_removed' end as archived_reason from a""",
)
def archive_and_restore(spark, sf_dir):
    (i,) = bound(spark, sf_dir, "items")
    i = i.withColumn("archived_reason", F.lit(None).cast("string"))
    out = K.restore(K.archive(i, F.col("last_seen_at") < F.expr("timestamp_ntz '1993-01-01 00:00:00'"), "menu_removed", late()), F.col("line") == 2)
    return out.select("item_id", "line", "archived_at", "archived_reason")


@query(
    "kept_items",
    with_sql("items")
    + f" select item_id, line from items where (item_id, line) not in (select (item_id, line) from items where line % 4 <> 0 and audit_confidence >= 0.9 and archived_at <= {LATE} - interval 7 day)",
)
def kept_items(spark, sf_dir):
    """All items asked to be deleted for good; those stay that a rule protects."""
    (i,) = bound(spark, sf_dir, "items")
    i = i.withColumn("key", F.col("item_id") * 10 + F.col("line")).withColumn("archived_reason", F.when(F.col("line") % 4 == 0, "menu_removed").otherwise("junk"))
    kept, _ = K.hard_delete(i, i.select("key"), late(), "key")
    return kept.select("item_id", "line")


@query(
    "reviewed_items",
    with_sql("dishes")
    + """, x as (select dish_id, case dish_id % 5 when 1 then 'alcohol' when 2 then 'side' else 'dish' end as item_type, dish_id % 5 = 0 as is_rejected from dishes)
select dish_id as item_id, item_type, is_rejected, not is_rejected and item_type <> 'alcohol' as is_dish_card from x""",
)
def reviewed_items(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    k = F.col("dish_id") % 5
    items = d.select(F.col("dish_id").alias("item_id"), F.lit("dish").alias("item_type"), F.lit(True).alias("is_dish_card"))
    action = F.when(k == 0, "reject").when(k.isin(1, 2), "retype").otherwise("approve")
    decisions = d.where(k <= 3).select(F.col("dish_id").alias("item_id"), action.alias("action"), F.when(k == 1, "alcohol").when(k == 2, "side").alias("new_type"))
    return K.apply_decisions(items, decisions).select("item_id", "item_type", "is_rejected", "is_dish_card")


@query(
    "reviewed_photos",
    with_sql("photos") + " select photo_id, dish_id, photo_id % 7 = 2 as demoted from photos where photo_id % 7 <> 1 and dish_id % 11 <> 0",
)
def reviewed_photos(spark, sf_dir):
    (p,) = bound(spark, sf_dir, "photos")
    k = F.col("photo_id") % 7
    action = F.when(F.col("dish_id") % 11 == 0, "remove_all").when(k == 1, "reject").when(k == 2, "demote").otherwise("approve")
    return K.apply_photo_decisions(p, p.select("photo_id", "dish_id", action.alias("action"))).select("photo_id", "dish_id", "demoted")


@query(
    "read_notifications",
    """with l as (select event_id, user_id, ts, case when event_id % 10 = 0 then ts end as old from events), o as (select event_id, ts + interval 1 hour as one from events where event_id % 3 = 0),
u as (select user_id, max(ts) as last from events where event_type = 'click' group by 1)
select event_id, coalesce(old, least(one, case when ts <= last then last end)) as read_at from l left join o using (event_id) left join u using (user_id)""",
)
def read_notifications(spark, sf_dir):
    e = FE.load(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"])
    log = e.select(F.col("event_id").alias("notification_id"), "user_id", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 10 == 0, F.col("ts")).alias("read_at"))
    one = e.where("event_id % 3 = 0").select(F.col("event_id").alias("notification_id"), F.lit(None).cast("bigint").alias("user_id"), (F.col("ts") + F.expr("interval 1 hour")).alias("ts"))
    every = e.where("event_type = 'click'").select(F.lit(None).cast("bigint").alias("notification_id"), "user_id", "ts")
    return K.fold_reads(log, one.unionByName(every)).select(F.col("notification_id").alias("event_id"), "read_at")


@query(
    "checked_feedback",
    with_sql("feedback")
    + """ select feedback_id, case when feedback_id % 6 = 0 then 'unknown type' when feedback_id % 6 = 1 then 'no dish' when feedback_id % 6 = 2 then 'bad photo url' when feedback_type = 'photo_submission' and feedback_id % 6 <> 3 then 'no photo url' end as reason from feedback""",
)
def checked_feedback(spark, sf_dir):
    (f,) = bound(spark, sf_dir, "feedback")
    k = F.col("feedback_id") % 6
    f = f.withColumn("feedback_type", F.when(k == 0, "applause").otherwise(F.col("feedback_type"))).withColumn("dish_id", F.when(k != 1, F.col("dish_id")))
    f = f.withColumn("photo_url", F.when(k == 2, "ftp://x y").when(k == 3, "https://p.example/1.jpg"))
    good, bad = K.append_feedback(f)
    return good.select("feedback_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("feedback_id", "reason"))


@query("area_totals", "select s_nationkey as area_id, count(*) as last_found, 5 * s_nationkey + count(*) as total_found from supplier group by 1 union all select n_nationkey, 0, 5 * n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier)")
def area_totals(spark, sf_dir):
    n = FE.load(spark, sf_dir, "nation", ["n_nationkey"]).select(F.col("n_nationkey").alias("area_id"), (F.col("n_nationkey") * 5).alias("total_found"))
    s = FE.load(spark, sf_dir, "supplier", ["s_nationkey"]).select(F.col("s_nationkey").alias("area_id"))
    return A.update_area_totals(n, s).select("area_id", "last_found", "total_found")


@query("paged_feedback", with_sql("feedback") + " select feedback_id, (select count(*) from feedback where feedback_type = 'portion_bigger') as total from feedback where feedback_type = 'portion_bigger' order by created_at desc, feedback_id limit 20 offset 40")
def paged_feedback(spark, sf_dir):
    (f,) = bound(spark, sf_dir, "feedback")
    page, n = A.page_with_total(f.where("feedback_type = 'portion_bigger'"), [F.desc("created_at"), F.asc("feedback_id")], 20, 40)
    return page.select("feedback_id", F.lit(n).cast("bigint").alias("total"))


# --- aggregates and evaluation ----------------------------------------------------------------


@query("photo_nutrients", "select l_orderkey as photo_id, sum(100 + l_partkey % 50) as calories, sum(l_quantity) as protein from lineitem where l_linenumber <> 3 group by 1")
def photo_nutrients(spark, sf_dir):
    i = FE.load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    calories = F.when(F.col("l_linenumber") != 3, 100 + F.col("l_partkey") % 50)
    i = i.select(F.col("l_orderkey").alias("photo_id"), calories.alias("calories"), F.col("l_quantity").alias("protein"), F.lit(1.0).alias("carbs"), F.lit(1.0).alias("fat"))
    return A.sum_nutrients(i).select("photo_id", "calories", "protein")


@query(
    "review_totals",
    with_sql("feedback")
    + """ select dish_id, count(*) as n_reviews, count(*) filter (feedback_id % 2 = 0) as n_google, count(*) filter (feedback_id % 2 = 1) as n_yelp, round(avg(cast(1 + feedback_id % 5 as double)), 6) as average_rating,
  case dish_id % 3 when 0 then 67 when 1 then 0 end as positive_pct from feedback group by 1""",
)
def review_totals(spark, sf_dir):
    (f,) = bound(spark, sf_dir, "feedback")
    m = f.select("dish_id", F.when(F.col("feedback_id") % 2 == 0, "google").otherwise("yelp").alias("source"), (1 + F.col("feedback_id") % 5).cast("double").alias("rating"))
    two = F.array(F.lit("good"), F.lit("fast"))
    s = f.select("dish_id").distinct().where("dish_id % 3 <> 2").select("dish_id", F.when(F.col("dish_id") % 3 == 0, two).alias("praises"), F.when(F.col("dish_id") % 3 == 0, F.array(F.lit("cold"))).alias("complaints"))
    return A.review_stats(m, s).select("dish_id", "n_reviews", "n_google", "n_yelp", r6(F.col("average_rating"), "average_rating"), "positive_pct")


@query(
    "delivery_ratings",
    with_sql("offers")
    + """, x as (select dish_id, min(line) filter (line % 2 = 0) as p, bool_or(quantity > 49) as liked from offers group by 1)
select dish_id, case when p is not null then 50 + dish_id % 50 + p end as thumbs_up_pct, liked as is_most_liked from x""",
)
def delivery_ratings(spark, sf_dir):
    (o,) = bound(spark, sf_dir, "offers")
    pct = F.when(F.col("line") % 2 == 0, 50 + F.col("dish_id") % 50 + F.col("line"))
    items = o.select("dish_id", F.col("line").alias("platform"), pct.alias("thumbs_up_pct"), F.lit(9).alias("rating_count"), (F.col("quantity") > 49).alias("is_most_liked"))
    return A.delivery_ratings(items).select("dish_id", "thumbs_up_pct", "is_most_liked")


@query(
    "classifier_scores",
    with_sql("dishes")
    + """, t as (select dish_id, case when name = 'small ring' then 'side' else category end as label, case when dish_id % 4 = 0 then 'PROMO' else category end as said from dishes)
select label, count(*) as n, round(avg(case when said = label then 1.0 else 0.0 end), 6) as accuracy from t group by 1 union all select 'all', count(*), round(avg(case when said = label then 1.0 else 0.0 end), 6) from t""",
)
def classifier_scores(spark, sf_dir):
    """Each dish is an item of a restaurant of its own, labelled by its category but for one corrected name."""
    (d,) = bound(spark, sf_dir, "dishes")
    own = F.concat(F.lit("r"), "dish_id")
    items = d.select(F.col("dish_id").alias("item_id"), own.alias("restaurant"), F.upper("name").alias("name"), F.when(F.col("dish_id") % 4 == 0, "PROMO").otherwise(F.col("category")).alias("item_type"))
    truth = d.select(own.alias("restaurant"), "name", F.col("category").alias("label"))
    fixes = d.where("name = 'small ring'").select(F.upper("name").alias("name"), F.lit("side").alias("correct_type"))
    return A.classifier_eval(items, truth, fixes).select("label", "n", r6(F.col("accuracy"), "accuracy"))


@query(
    "scraper_scores",
    with_sql("dishes")
    + """, t as (select distinct 'r' || restaurant_id as restaurant, lower(name) as b, category <> 'PROMO' as is_item from dishes), i as (select distinct 'r' || restaurant_id as restaurant, lower(name) as a from dishes where dish_id % 3 <> 0),
h as (select t.*, exists (select 1 from i where i.restaurant = t.restaurant and (contains(a, b) or contains(b, a))) as hit from t)
select restaurant, round(count(*) filter (is_item and hit) / nullif(cast(count(*) filter (is_item) as double), 0), 6) as recall, count(*) filter (is_item and not hit) as missed, count(*) filter (not is_item and hit) as false_items from h group by 1""",
)
def scraper_scores(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    place = F.concat(F.lit("r"), "restaurant_id")
    out = A.scraper_eval(d.where("dish_id % 3 <> 0").select(place.alias("restaurant"), "name"), d.select(place.alias("restaurant"), "name", (F.col("category") != "PROMO").alias("is_item")))
    return out.select("restaurant", r6(F.col("recall"), "recall"), "missed", "false_items")


@query(
    "theme_scores",
    with_sql("dishes") + " select 'm' || dish_id % 2 as model, round(avg((case when dish_id % 2 = 0 then 1.0 else 0 end + 0) / 2), 6) as coverage from dishes group by 1",
)
def theme_scores(spark, sf_dir):
    """Two themes: the dish's noun, which every other summary says, and one that none does."""
    (d,) = bound(spark, sf_dir, "dishes")
    noun = F.concat(F.element_at(F.split("name", " "), -1), F.lit("xx"))
    out = d.select(F.concat(F.lit("m"), F.col("dish_id") % 2).alias("model"), "dish_id", F.when(F.col("dish_id") % 2 == 0, F.concat(F.lit("Fine "), noun)).otherwise("Fine").alias("summary"))
    return A.theme_coverage(out, d.select("dish_id", F.array(F.concat(F.lit("the "), noun), F.lit("odd waiters")).alias("themes"))).select("model", r6(F.col("coverage"), "coverage"))


@query(
    "model_report",
    """with s as (select 'm' || o_orderkey % 3 as model, cast(o_orderkey % 101 as double) / 100 as accuracy, o_orderkey % 2 as f, cast(o_orderkey % 900 as double) as l, 0.25 as c from orders),
r as (select model, count(*) as runs, avg(accuracy) as a, sum(f) as safety_failures, avg(l) as l, avg(c) * 1000 as m from s group by 1)
select model, runs, round(a, 6) as accuracy, safety_failures, round(l, 6) as latency_ms, round(m, 6) as monthly_cost, row_number() over (order by a desc, model desc) = 1 as is_best from r""",
)
def model_report(spark, sf_dir):
    o, k = FE.load(spark, sf_dir, "orders", ["o_orderkey"]), F.col("o_orderkey")
    s = o.select(F.concat(F.lit("m"), k % 3).alias("model"), ((k % 101).cast("double") / 100).alias("accuracy"), (k % 2).alias("safety_failures"), (k % 900).cast("double").alias("latency_ms"), F.lit(0.25).alias("cost"))
    out = A.eval_report(s)
    return out.select("model", "runs", r6(F.col("accuracy"), "accuracy"), "safety_failures", r6(F.col("latency_ms"), "latency_ms"), r6(F.col("monthly_cost"), "monthly_cost"), "is_best")


@query("cleanup_samples", with_sql("dishes") + " select category, count(*) as n, array_to_string(list_sort(list(name order by name))[1:3], '|') as samples from dishes group by 1")
def cleanup_samples(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    return A.cleanup_report(d, "category", "name").select("category", "n", joined("samples").alias("samples"))


@query(
    "best_entries",
    with_sql("offers")
    + " select dish_id, offer_id * 10 + line as entry_id from offers qualify row_number() over (partition by dish_id order by line % 3 = 0 desc, cast(quantity as int) desc, offer_id * 10 + line) = 1",
)
def best_entries(spark, sf_dir):
    (o,) = bound(spark, sf_dir, "offers")
    one = F.lit(1.0)
    e = o.select("dish_id", (F.col("offer_id") * 10 + F.col("line")).alias("entry_id"), (F.col("line") % 3 == 0).alias("specific"), F.col("quantity").cast("int").alias("log_count"), *[one.alias(c) for c in ("calories", "protein", "carbs", "fat")])
    return NU.best_entry(e).select("dish_id", "entry_id")


# --- nutrition, busyness and batch models -----------------------------------------------------


@query(
    "portions",
    """with x as (select p_partkey, cast(p_partkey % 300 as double) as v, least(greatest(cast((p_partkey * 37 % 12000) as double) - 3000, 1), 5000) / 100 as g, case p_partkey % 4 when 0 then 1.2 when 1 then 0.95 when 2 then 1.35 else 1.0 end as f from part)
select p_partkey, floor(v * g * cast(f as double) * 10 + 0.5) / 10 as calories, floor(v * g * 10 + 0.5) / 10 as protein from x""",
)
def portions(spark, sf_dir):
    k = F.col("p_partkey")
    v = (k % 300).cast("double")
    how = F.when(k % 4 == 0, "Fried").when(k % 4 == 1, "grilled").when(k % 4 == 2, "deep-fried").otherwise("pickled")
    p = parts(spark, sf_dir).select("p_partkey", *[v.alias(c) for c in ("calories", "protein", "carbs", "fat")], ((k * 37 % 12000) - 3000).alias("grams"), how.alias("preparation"))
    return NU.scale_macros(p).select("p_partkey", "calories", "protein")


@query(
    "current_busyness",
    with_sql("grid")
    + f""", x as (select restaurant_id, dow, hour, case when hour % 3 <> 0 then busyness end as live, case when hour % 4 <> 0 then 50.0 end as fc from grid)
select restaurant_id, dow, hour, coalesce(live, fc, 0) as busyness, coalesce(live > fc, false) as busier, case when coalesce(live, fc) is not null then {wait_sql("coalesce(live, fc)")} end as wait from x""",
)
def current_busyness(spark, sf_dir):
    (g,) = bound(spark, sf_dir, "grid")
    b = N.current_busyness(F.when(F.col("hour") % 3 != 0, F.col("busyness")), F.when(F.col("hour") % 4 != 0, F.lit(50.0)))
    return g.select("restaurant_id", "dow", "hour", b["busyness"].alias("busyness"), b["busier"].alias("busier"), b["wait"].alias("wait"))


@query("verified_food", with_sql("dishes") + " select dish_id, case when dish_id % 3 = 0 then 0.9 else 0.75 end as food_confidence from dishes where dish_id % 3 <> 2 and not (dish_id % 3 = 0 and name like '%bolt')")
def verified_food(spark, sf_dir):
    """The scorer knows every third dish surely, doubts the next and says nothing of the last."""
    (d,) = bound(spark, sf_dir, "dishes")

    def scorer(rows):
        return [(not r["name"].endswith("bolt"), 0.9, "") if r["dish_id"] % 3 == 0 else (True, 0.75, "") if r["dish_id"] % 3 == 1 else None for r in rows]

    return UD.verify_food(d.select("dish_id", "name"), scorer).select("dish_id", "food_confidence")


@query(
    "analysed_dishes",
    with_sql("dishes")
    + """ select dish_id, case when dish_id % 2 = 0 then contains(name, 'ring') end as vegan, case when dish_id % 2 = 0 then 0.9 else 0.0 end as dietary_confidence, case when dish_id % 2 = 1 then 'analysis failed' end as analysis_warning, dish_id % 4 = 0 as is_glp1 from dishes""",
)
def analysed_dishes(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")

    def scorer(rows):
        return [("ring" in r["name"], None, None, None, None, None, None, 0.9, None) if r["dish_id"] % 2 == 0 else None for r in rows]

    d = d.select("dish_id", "name", F.when(F.col("dish_id") % 4 == 0, "Ozempic friendly").otherwise("plain").alias("description"))
    return UD.analyse_dishes(d, scorer).select("dish_id", "vegan", "dietary_confidence", "analysis_warning", "is_glp1")


@query(
    "summaries",
    with_sql("dishes", "feedback")
    + """, n as (select dish_id, count(*) as n, avg(cast(1 + feedback_id % 5 as double)) as m from feedback where dish_id % 2 = 0 group by 1)
select dish_id, coalesce(n, 0) as n_reviews, case when n is null then 'No reviews yet.' else 'Based on ' || n || ' reviews, rated ' || printf('%.1f', m) || ' on average.' end as summary from dishes left join n using (dish_id)""",
)
def summaries(spark, sf_dir):
    d, f = bound(spark, sf_dir, "dishes", "feedback")
    reviews = f.where("dish_id % 2 = 0").select("dish_id", (1 + F.col("feedback_id") % 5).cast("double").alias("rating"), F.lit("fine").alias("text"), F.col("created_at").alias("date"))
    return UD.summarise(d.select("dish_id", "name"), reviews).select("dish_id", "n_reviews", "summary")


@query(
    "model_summaries",
    with_sql("dishes", "feedback")
    + """, r as (select dish_id, feedback_id from feedback qualify row_number() over (partition by dish_id order by created_at desc, 'r' || feedback_id) <= 20), n as (select dish_id, count(*) as n from feedback group by 1), k as (select dish_id, count(*) as k from r group by 1)
select dish_id, coalesce(n, 0) as n_reviews, case when n is null then 'No reviews yet.' when dish_id % 3 <> 0 then k || ' texts' end as summary from dishes left join n using (dish_id) left join k using (dish_id)""",
)
def model_summaries(spark, sf_dir):
    d, f = bound(spark, sf_dir, "dishes", "feedback")

    def scorer(rows):
        return [f"{r['texts'].count(chr(10)) + 1} texts" if r["dish_id"] % 3 else None for r in rows]

    reviews = f.select("dish_id", F.lit(4.0).alias("rating"), F.concat(F.lit("r"), "feedback_id").alias("text"), F.col("created_at").alias("date"))
    return UD.summarise(d.select("dish_id", "name"), reviews, scorer).select("dish_id", "n_reviews", "summary")


@query(
    "photo_macros",
    with_sql("dishes")
    + """, g as (select l_partkey as dish_id, count(*) as n, avg(0.3 + l_linenumber / 10.0) as c from lineitem where l_linenumber >= 2 group by 1),
s as (select dish_id, n, floor(least(1.0, c * (1 + log2(n) / 10)) * 1000 + 0.5) / 1000 as sure, least(1.0, c * (1 + log2(n) / 10)) as raw from g)
select dish_id, coalesce(cast(floor(floor(500 * (1 - cast(case when raw > 0.8 then 0.1 else 0.2 end as double)) * 10 + 0.5) / 10 + 0.5) as int), calories_min) as calories_min, coalesce(sure, macro_confidence) as macro_confidence from dishes left join s using (dish_id)""",
)
def photo_macros(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    i = FE.load(spark, sf_dir, "lineitem", ["l_partkey", "l_linenumber"])
    value = [F.lit(v).alias(c) for c, v in (("calories", 500.0), ("protein", 20.0), ("carbs", 30.0), ("fat", 10.0))]
    seen = i.select(F.col("l_partkey").alias("dish_id"), *value, (0.3 + F.col("l_linenumber") / 10.0).alias("confidence")).where("confidence > 0.45")
    return UD.apply_photo_analyses(d.withColumn("photo_count", F.lit(0).cast("bigint")), seen).select("dish_id", "calories_min", r6(F.col("macro_confidence"), "macro_confidence"))


@query(
    "dish_records",
    with_sql("dishes") + " select dish_id, case when dish_id % 2 = 0 then 0.95 else 0.7 end as dietary_confidence, case when dish_id % 3 = 0 then calories_min end as calories_max, case when dish_id % 3 = 0 then 'published' end as macro_source from dishes",
)
def dish_records(spark, sf_dir):
    from platewise.plans.menus import to_dish

    (d,) = bound(spark, sf_dir, "dishes")
    k = F.col("dish_id")
    items = d.select(F.col("dish_id").alias("restaurant_id"), "name", "description", "category", "price", F.when(k % 2 == 0, F.array(F.lit("vegan"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.when(k % 3 == 0, F.col("calories_min")).alias("menu_calories"))
    return to_dish(items).select(F.col("restaurant_id").alias("dish_id"), "dietary_confidence", "calories_max", "macro_source")


MENU = f"""m as (select restaurant_id, lower(name) as k, min(dish_id) as d from dishes where dish_id % 3 <> 0 group by 1, 2), s as (select restaurant_id, lower(name) as k from dishes where dish_id % 2 = 0 group by 1, 2),
a as (select s.restaurant_id, count(*) + (select count(*) from m x where x.restaurant_id = s.restaurant_id and not exists (select 1 from s y where y.restaurant_id = x.restaurant_id and y.k = x.k)) as active,
  (select count(*) from m x where x.restaurant_id = s.restaurant_id) as seen from s group by 1)"""


@query(
    "crawled_menus",
    with_sql("dishes")
    + f""", {MENU}
select restaurant_id, k as name_normalized, m.k is not null as seen, s.k is null as is_new, m.k is null and a.active > 0 and a.seen >= greatest(a.active * 0.2, 3.0) as archived
from (select * from m) m full join (select * from s) s using (restaurant_id, k) left join a using (restaurant_id)""",
)
def crawled_menus(spark, sf_dir):
    """A crawl of two thirds of the dishes against a state that has half of them."""
    from platewise.plans.menus import COLUMNS, menu_pipeline

    (d,) = bound(spark, sf_dir, "dishes")
    before, at = F.expr("timestamp_ntz '1998-01-01 00:00:00'"), late()
    raw = d.where("dish_id % 3 <> 0").select("restaurant_id", F.lit("site").alias("source"), F.col("dish_id").alias("position"), F.concat(F.lit("7. "), F.upper("name"), F.lit(" - $9")).alias("name"), "description", F.lit("Mains").alias("category"), F.lit("$9.00").alias("price"))
    none = lambda t: F.lit(None).cast(t)
    state = d.where("dish_id % 2 = 0").select(
        "restaurant_id", F.lower("name").alias("name_normalized"), F.lit("site").alias("source"), "name", "description", F.lit("Mains").alias("category"), F.lit(9).cast("decimal(8,2)").alias("price"), F.array().cast("array<string>").alias("tags"),
        F.lit("dish").alias("item_type"), before.alias("first_seen_at"), before.alias("last_seen_at"), none("timestamp_ntz").alias("archived_at"), none("string").alias("archived_reason"), F.lit(True).alias("is_dish_card"), none("bigint").alias("dish_id"),
    ).dropDuplicates(["restaurant_id", "name_normalized"])
    crawls = d.select("restaurant_id", F.lit("site").alias("source"), at.alias("crawled_at")).distinct()
    items, _ = menu_pipeline(raw, state.select(COLUMNS), d.where("1 = 0").select("dish_id", "restaurant_id", "name"), crawls, at)
    return items.select("restaurant_id", "name_normalized", (F.col("last_seen_at") == at).alias("seen"), (F.col("first_seen_at") == at).alias("is_new"), F.col("archived_at").isNotNull().alias("archived"))


@query(
    "reroute_similar",
    with_sql("dishes", "restaurants", "grid")
    + f""", v as (select dish_id, restaurant_id, (calories_min - 500) / 250.0 as a, (protein_min - 25) / 15.0 as b, (carbs_min - 45) / 30.0 as c, (fat_min - 20) / 15.0 as d from dishes), s as (select * from v where dish_id = 7),
x as (select v.dish_id, v.restaurant_id, (v.a*s.a + v.b*s.b + v.c*s.c + v.d*s.d) / (sqrt(v.a*v.a + v.b*v.b + v.c*v.c + v.d*v.d) * sqrt(s.a*s.a + s.b*s.b + s.c*s.c + s.d*s.d)) as similarity from v, s where v.restaurant_id <> s.restaurant_id),
g as (select restaurant_id, busyness, {wait_sql("busyness")} as wait from grid where dow = 6 and hour = 20)
select dish_id, 45 - wait as saved, round(similarity, 6) as similarity from x join g using (restaurant_id) where x.similarity > 0.2 and busyness < 50 and 45 - wait > 0 order by x.similarity desc, dish_id limit 12""",
)
def reroute_similar(spark, sf_dir):
    """Dishes like one that has a long wait, at places that are calm."""
    d, r, g = bound(spark, sf_dir, "dishes", "restaurants", "grid")
    d = d.withColumn("vec", N.macro_vector("calories_min", "protein_min", "carbs_min", "fat_min"))
    found = d.where("dish_id = 7").select("vec", "restaurant_id").first()
    if found is None:
        return d.select("dish_id", F.lit(0).alias("saved"), F.lit(0.0).alias("similarity")).limit(0)
    near = R.similar(d, found.asDict(), min_similarity=0.2, n=None)
    return SE.reroute(near, g, 45, 6, 20, 12).select("dish_id", "saved", r6(F.col("similarity"), "similarity"))


ORDERS = {"max_protein": "protein_max desc", "min_calories": "calories_min", "min_fat": "fat_min", "min_carbs": "carbs_min", "glp1_friendly": "protein_max desc", "none": "dish_id desc"}


@query("goal_orders", with_sql("dishes") + " union all ".join(f" select * from (select dish_id, '{g}' as goal from dishes order by {o}, dish_id limit 150)" for g, o in ORDERS.items()))
def goal_orders(spark, sf_dir):
    (d,) = bound(spark, sf_dir, "dishes")
    frames = [R.goal_order(d, g, 150).select("dish_id", F.lit(g).alias("goal")) for g in ORDERS]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(
    "over_limit_minute",
    """with w as (select unnest(generate_series(0, 5)) as k), x as (select time_bucket(interval 10 second, ts) - k * interval 10 second as start, event_type as route, ts from events, w)
select start, route, count(*) as n from x where ts >= start and ts < start + interval 60 second group by 1, 2 having count(*) > 1""",
)
def over_limit_minute(spark, sf_dir):
    """All requests of a route as one client, over the trailing minute."""
    from platewise.streaming import jobs as ST

    e = FE.load(spark, sf_dir, "events", ["ts", "event_type"]).select("ts", F.lit("all").alias("client"), F.col("event_type").alias("route"))
    return ST.over_limit(e, {t: 1 for t in ("click", "view", "error", "signup", "purchase")}).select("start", "route", "n")


@query(
    "kept_requests",
    """with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
r as (select event_id, user_id, k, ts as last, true as kept from e where k = 1
  union all select e.event_id, e.user_id, e.k, case when e.ts >= r.last + interval 6 hour then e.ts else r.last end, e.ts >= r.last + interval 6 hour from r join e on e.user_id = r.user_id and e.k = r.k + 1)
select event_id, kept from r""",
)
def kept_requests(spark, sf_dir):
    """Of a user's requests, those six hours or more after the last one that counted."""
    e = FE.load(spark, sf_dir, "events", ["event_id", "user_id", "ts"])
    return L.first_of_repeats(e, ["user_id"], 6 * 3600, ["event_id"]).select("event_id", "kept")


@query(
    "limited_requests",
    """with recursive e as (select event_id, user_id, event_type, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events),
r as (select event_id, user_id, event_type, k, [ts] as times, 0 as in_window, true as admitted, cast(null as double) as retry_after from e where k = 1
  union all select event_id, user_id, event_type, k, case when len(f) < 2 then list_append(f, ts) else f end, len(f), len(f) < 2,
    case when len(f) >= 2 then epoch_us(f[1] + interval 12 hour) / 1e6 - epoch_us(ts) / 1e6 end
  from (select e.*, list_filter(r.times, lambda x: x > e.ts - interval 12 hour) as f from r join e on e.user_id = r.user_id and e.event_type = r.event_type and e.k = r.k + 1))
select event_id, cast(in_window as int) as in_window, admitted, round(retry_after, 3) as retry_after from r""",
)
def limited_requests(spark, sf_dir):
    """Two requests of a kind in any twelve hours; requests over the limit do not count."""
    e = FE.load(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "ts"])
    out = L.admitted(e, ["user_id", "event_type"], F.lit(2), 12 * 3600, ["event_id"])
    return out.select("event_id", "in_window", "admitted", F.round("retry_after", 3).alias("retry_after"))


@query(
    "trailing_counts",
    "select event_id, count(*) over (partition by user_id, event_type order by ts range between interval '11:59:59.999999' preceding and current row) as n from events",
)
def trailing_counts(spark, sf_dir):
    """All requests of a kind in the twelve hours up to each."""
    e = FE.load(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "ts"])
    return L.trailing_counts(e, ["user_id", "event_type"], 12 * 3600).select("event_id", "n")


def recalled(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Whether nine of ten pairs (id, near) were found, and the number of ids; the exact search is done once."""
    shared = found.groupBy("id", "near").agg(F.count(F.lit(1)).alias("k"))
    both = exact.select("id", "near").join(shared, ["id", "near"], "left")
    out = both.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.count(F.lit(1)).alias("all"), F.count_distinct("id").alias("n"))
    return out.select((F.col("k") >= 0.9 * F.col("all")).alias("recalled"), "n")


@query("nearest_by_lists", "select true as recalled, count(*) as n from embeddings")
def nearest_by_lists(spark, sf_dir):
    """Whether the index finds at least nine of ten of the five nearest vectors of every row."""
    e = FE.load(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    exact = R.similar_all(e, "vec_id", "embedding", 5)
    found = R.similar_by_lists(e, "vec_id", "embedding", 5)
    return recalled(exact, found)


@query("nearest_by_index", "select true as recalled, count(*) as n from embeddings")
def nearest_by_index(spark, sf_dir):
    """Whether the stored index finds at least nine of ten of the five nearest vectors of every row."""
    e = FE.load(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    index = V.build(e, "vec_id", "embedding", stored_path(spark, "vectors", f"{sf_dir} {uuid.uuid4()}"), list_rows=100)
    found = V.search(index, e, "vec_id", "embedding", 5, V.probes_of(index, 5))
    exact = R.similar_all(e, "vec_id", "embedding", 5)
    return recalled(exact, found)
