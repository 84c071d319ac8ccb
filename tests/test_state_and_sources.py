import datetime as dt
import json

from pyspark.sql import functions as F

from platewise.operators import sinks as K
from platewise.plans import menus as P
from platewise.plans import nutrition as NU
from platewise.plans import scorers as U
from platewise.plans import search as SE
from platewise.sources import feeds as FE
from platewise.sources import menus as M

T0, T1, T2 = (dt.datetime(2024, 1, d) for d in (1, 10, 20))


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", 1.0, T0), (2, "b", 2.0, None)], "k int, v string, w double, archived_at timestamp")
    u = spark.createDataFrame([(1, "x", None), (3, "y", 5.0)], "k int, v string, w double")
    got = {r.k: r for r in K.upsert(t, u, ["k"], revive=["archived_at"]).collect()}
    assert got[1].v == "x" and got[1].w is None and got[1].archived_at is None and got[2].v == "b" and got[3].w == 5.0
    kept = {r.k: r.w for r in K.upsert(t, u, ["k"], keep_nulls=True).collect()}
    assert kept == {1: 1.0, 2: 2.0, 3: 5.0}
    first = {r.k: r.v for r in K.upsert(t, u, ["k"], insert_only=["v"]).collect()}
    assert first == {1: "a", 2: "b", 3: "y"}


def test_archive_and_delete(spark):
    rows = [(1, "junk", 0.95, T0), (2, "menu_removed", 0.95, T0), (3, "junk", 0.5, T0), (4, "junk", 0.95, None), (5, "junk", 0.95, T2)]
    df = spark.createDataFrame(rows, "item_id int, archived_reason string, audit_confidence double, archived_at timestamp")
    kept, refused = K.hard_delete(df, df.select("item_id"), F.lit(dt.datetime(2024, 1, 21)))
    assert sorted(r.item_id for r in kept.collect()) == [2, 3, 4, 5]
    assert {r.item_id: r.refused for r in refused.collect()} == {2: "reason is not junk", 3: "confidence below 0.9", 4: "not archived", 5: "archived less than 7 days ago"}
    back = K.restore(df, F.col("item_id") == 1).where("item_id = 1").first()
    assert back.archived_at is None and back.archived_reason is None
    again = K.archive(K.restore(df, F.col("item_id") == 1), F.col("item_id") == 1, "junk", F.lit(T2)).where("item_id = 1").first()
    assert again.archived_at == T2


def test_folds(spark):
    m = spark.createDataFrame([(1, 1), (1, 2)], "u int, d int")
    e = spark.createDataFrame([(1, 1), (1, 3), (1, 2), (1, 2)], "u int, d int")
    assert sorted(map(tuple, K.fold_toggles(m, e, ["u", "d"]).collect())) == [(1, 2), (1, 3)]
    log = spark.createDataFrame([(1, 7, T0, None), (2, 7, T2, None), (3, 8, T0, T1)], "notification_id int, user_id int, created_at timestamp, read_at timestamp")
    reads = spark.createDataFrame([(None, 7, T1), (3, 8, T2)], "notification_id int, user_id int, ts timestamp")
    assert {r.notification_id: r.read_at for r in K.fold_reads(log, reads).collect()} == {1: T1, 2: None, 3: T1}
    fb = spark.createDataFrame([(1, "portion_bigger", None), (2, "nonsense", None), (3, "photo_submission", ""), (4, "photo_submission", "https://x/y.jpg"), (None, "portion_bigger", None)], "dish_id int, feedback_type string, photo_url string")
    good, bad = K.append_feedback(fb)
    assert sorted(r.dish_id for r in good.collect()) == [1, 4] and bad.count() == 3


def test_decisions_and_merge(spark):
    items = spark.createDataFrame([(1, "unknown", True), (2, "dish", True), (3, "dish", True)], "item_id int, item_type string, is_dish_card boolean")
    d = spark.createDataFrame([(1, "retype", "alcohol"), (2, "reject", None)], "item_id int, action string, new_type string")
    got = {r.item_id: (r.item_type, r.is_dish_card, r.is_rejected) for r in K.apply_decisions(items, d).collect()}
    assert got == {1: ("alcohol", False, False), 2: ("dish", False, True), 3: ("dish", True, False)}
    dishes = spark.createDataFrame([(1, 1, "PAD THAI", T1), (2, 1, "Pad Thai $9.50", T0), (3, 2, "Pad Thai", T0)], "dish_id int, restaurant_id int, name string, created_at timestamp")
    photos = spark.createDataFrame([(10, 1), (11, 3)], "photo_id int, dish_id int")
    kept, kids = K.merge_duplicates(dishes, {"photos": photos})
    assert sorted(r.dish_id for r in kept.collect()) == [2, 3]
    assert sorted((r.photo_id, r.dish_id) for r in kids["photos"].collect()) == [(10, 2), (11, 3)]


RAW = "restaurant_id int, source string, position int, name string, description string, category string, price string"


def test_two_crawls(spark):
    state = spark.createDataFrame([], "restaurant_id int, name_normalized string, source string, name string, description string, category string, price decimal(8,2), tags array<string>, item_type string, first_seen_at timestamp, last_seen_at timestamp, archived_at timestamp, archived_reason string, is_dish_card boolean, dish_id bigint")
    dishes = spark.createDataFrame([], "dish_id bigint, restaurant_id int, name string, description string, category string, price decimal(8,2)")
    names = ["Pad Thai (V)", "GREEN CURRY", "Tom Yum Soup", "Mango Sticky Rice", "Pinot Noir"]
    crawl = lambda ns, at: (spark.createDataFrame([(1, "web", i, n, None, None, "$9") for i, n in enumerate(ns)], RAW), spark.createDataFrame([(1, "web", at)], "restaurant_id int, source string, crawled_at timestamp"))
    raw, c = crawl(names, T0)
    items, made = P.menu_pipeline(raw, state, dishes, c, F.lit(T0))
    items = spark.createDataFrame(items.collect(), items.schema)
    assert {r.name: r.item_type for r in items.collect()}["Pinot Noir"] == "alcohol"
    assert sorted(r.name for r in made.collect()) == ["Green Curry", "Mango Sticky Rice", "Pad Thai", "Tom Yum Soup"]
    made = spark.createDataFrame(made.collect(), made.schema)
    raw, c = crawl(names[:4], T1)  # four of five seen: the fifth is archived
    items, more = P.menu_pipeline(raw, items.select(*state.columns), made, c, F.lit(T1))
    got = {r.name: r.archived_reason for r in items.collect()}
    assert got["Pinot Noir"] == "menu_removed" and got["Pad Thai"] is None and more.count() == 0
    items = spark.createDataFrame(items.select(*state.columns).collect(), state.schema)
    raw, c = crawl(["Pad Thai"], T2)  # one of four: the crawl is not believed
    items, _ = P.menu_pipeline(raw, items, made, c, F.lit(T2))
    got = {r.name: (r.archived_reason, r.breaker_tripped) for r in items.collect()}
    assert got["Green Curry"] == (None, True)
    items = spark.createDataFrame(items.select(*state.columns).collect(), state.schema)
    raw, c = crawl(names, T2)  # all again: the archived one is revived, first seen times stay
    items, _ = P.menu_pipeline(raw, items, made, c, F.lit(T2))
    r = items.where("name = 'Pinot Noir'").first()
    assert r.archived_at is None and r.first_seen_at == T0 and r.last_seen_at == T2


def test_menu_pages(spark):
    ld = {"@type": "Restaurant", "hasMenu": {"hasMenuSection": [{"name": "Mains", "hasMenuItem": [{"name": "Pad Thai", "description": "rice noodles, egg, tofu", "offers": {"price": "14.99"}}]}]}}
    pages = [
        (1, "u", '<div class="menu-item"><h3>Pad Thai</h3><p class="description">noodles</p><span class="price">$14.99</span></div><div class="menu-item"><h3>Green Curry</h3><span>$12.99</span></div>'),
        (2, "u", "<h2>Appetizers</h2><ul><li>Spring Rolls $5.99</li><li>Satay $7</li></ul><h2>Mains</h2><ul><li>Larb - spicy pork</li></ul>"),
        (3, "u", "<p>Welcome</p>"),
        (4, "u", f'<script type="application/ld+json">{json.dumps(ld)}</script>'),
        (5, "u", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.name, r.price, r.category) for r in M.menu_from_html(df).collect())
    assert [g[:3] for g in got] == [(1, "Green Curry", "$12.99"), (1, "Pad Thai", "$14.99"), (2, "Larb", None), (2, "Satay", "$7"), (2, "Spring Rolls", "$5.99")]
    assert got[2][3] == "Mains" and got[4][3] == "Appetizers"
    r = M.menu_from_jsonld(df).collect()
    assert [(x.name, x.price, x.category, x.menu_ingredients) for x in r] == [("Pad Thai", "$14.99", "Mains", "rice noodles, egg, tofu")]


def test_json_recovery(spark):
    texts = ['{"a": 1}', 'Sure:\n```json\n{"a": 2}\n```', '```\n{"a": 3}\n```', 'the answer is {"a": 4}, ok', "nothing", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", FE.extract_json(F.col("t"), "a int")["a"].alias("a")).orderBy("i")
    assert [r.a for r in df.collect()] == [1, 2, 3, 4, None, None, None]


def test_feeds(spark):
    df = spark.createDataFrame([("V", [((0, "Mon"), [12], [9], [(9, 1.0), (12, 9.5)])])], "venue_name string, analysis array<struct<day_info:struct<day_int:int,day_text:string>,busy_hours:array<int>,quiet_hours:array<int>,hour_analysis:array<struct<hour:int,intensity_nr:double>>>>")
    assert sorted(map(tuple, FE.flatten_forecast(df).collect())) == [("V", 0, 9, 10, False, True), ("V", 0, 12, 95, True, False)]
    g = spark.createDataFrame([(1, "good", 5, "A", "d")], "restaurant_id int, text string, rating int, author_name string, publish_time string")
    y = spark.createDataFrame([(1, "bad", 1, ("B",), "e")], "restaurant_id int, text string, rating int, user struct<name:string>, time_created string")
    assert sorted((r.author, r.source) for r in FE.normalise_reviews(g, y).collect()) == [("A", "google"), ("B", "yelp")]
    foods = spark.createDataFrame([(1, "chicken", "Foundation", [(1008, 165.0), (1003, 31.0)])], "fdcId int, description string, dataType string, foodNutrients array<struct<nutrientId:int,value:double>>")
    r = NU.food_macros(foods).first()
    assert (r.calories, r.protein, r.fat, r.fiber) == (165.0, 31.0, 0.0, 0.0)
    portions = spark.createDataFrame([(100.0, 10.0, 1.0, 5.0, g, p) for g, p in ((100.0, None), (200.0, None), (1e9, None), (100.0, "fried"))], "calories double, protein double, carbs double, fat double, grams double, preparation string")
    assert [r.calories for r in NU.scale_macros(portions).collect()] == [100.0, 200.0, 5000.0, 120.0]


def test_scorers(spark):
    items = spark.createDataFrame([(1, "Soup", "hot"), (2, "Parking", ""), (3, "Ozempic-friendly bowl", "")], "id int, name string, description string")
    assert U.verify_food(items).count() == 3
    assert U.verify_food(items, lambda rows: [(True, 0.9, "") if r["name"] == "Soup" else None for r in rows]).count() == 1

    def broken(rows):
        raise RuntimeError

    assert U.verify_food(items, broken).count() == 3
    got = {r.id: (r.vegan, r.dietary_confidence, r.is_glp1) for r in U.analyse_dishes(items).collect()}
    assert got[1] == (None, 0.0, False) and got[3][2]
    reviews = spark.createDataFrame([(1, "ok", 4.0, "d"), (1, "good", 5.0, "e")], "dish_id int, text string, rating double, date string")
    d = spark.createDataFrame([(1,), (2,)], "dish_id int")
    assert {r.dish_id: r.summary for r in U.summarise(d, reviews).collect()} == {1: "Based on 2 reviews, rated 4.5 on average.", 2: "No reviews yet."}
    assert {r.dish_id: r.summary for r in U.summarise(d, reviews, lambda rows: [r["texts"] for r in rows]).collect()} == {1: "good\nok", 2: "No reviews yet."}


def test_query_language(spark):
    assert SE.parse_query('spicy "pad thai" tofu or egg -peanut') == ([["spicy"], ["tofu", "egg"]], ["pad thai"], ["peanut"])
    rows = [(1, "Spicy Pad Thai with tofu"), (2, "Spicy pad thai, egg and peanuts"), (3, "Thai pad spicy tofu"), (4, "Spicy pad thai with egg")]
    df = spark.createDataFrame(rows, "id int, name string")
    assert sorted(r.id for r in SE.token_search(df, 'spicy "pad thai" tofu or egg -peanut', {"name": 1.0}, "id").collect()) == [1, 4]
