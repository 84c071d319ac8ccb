import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from platewise.streaming import jobs as ST
from platewise.streaming import limits as L


def ts(minute, second=0, hour=12, day=1):
    return dt.datetime(2024, 1, day, hour, minute, second)


def replay(spark, tmp_path, rows, schema, name):
    """Each list of rows as a file of its own, read in order as a stream."""
    src = str(tmp_path / name)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).withColumn("n", F.lit(i)).write.mode("append").parquet(src)
    return spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src).drop("n")


def test_traffic_matches_batch(spark, tmp_path):
    rows = [[(1, ts(5), 20.0), (2, ts(6), 30.0)], [(1, ts(50), 90.0), (1, ts(1), 10.0)], [(2, ts(59), 70.0)]]
    schema = "restaurant_id int, ts timestamp, busyness double"
    out = str(tmp_path / "grid")
    q = ST.stream_traffic(replay(spark, tmp_path, rows, schema, "src"), out, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = {(r.restaurant_id, r.dow, r.hour): r.busyness for r in spark.read.parquet(out).collect()}
    batch = ST.traffic_slots(spark.createDataFrame(sum(rows, []), schema))
    assert got == {(r.restaurant_id, r.dow, r.hour): r.busyness for r in batch.collect()} == {(1, 1, 12): 90.0, (2, 1, 12): 70.0}


def test_a_batch_rewrites_its_own_folders(spark, tmp_path):
    schema = "restaurant_id int, ts timestamp, busyness double"
    out = str(tmp_path / "grid")
    many = ST.traffic_slots(spark.createDataFrame([(i, ts(5), 20.0) for i in range(500)], schema))
    assert ST.merge_slots(many, out) == ST.BUCKETS

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/bucket=*/*.parquet")}

    def rows():
        return sorted(map(tuple, spark.read.parquet(out).collect()), key=str)

    first, new = files(), ST.traffic_slots(spark.createDataFrame([(i, ts(50), 90.0) for i in range(10)] + [(11, ts(1), 5.0)], schema))
    assert ST.merge_slots(new, out) <= 11 and len(set(first) - set(files())) <= 11
    merged = rows()
    assert len(merged) == 500 and sum(r[3] == 90.0 for r in merged) == 10 and not any(r[3] == 5.0 for r in merged)
    ST.merge_slots(new, out)  # a batch that runs again
    assert rows() == merged


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_dedup(spark, tmp_path):
    rows = [[("a", ts(0)), ("a", ts(3)), ("b", ts(4))], [("a", ts(9)), ("c", ts(9))]]
    got = run(spark, ST.stream_dedup(replay(spark, tmp_path, rows, "place string, ts timestamp", "req"), "place"), "dedup")
    assert sorted(r.place for r in got) == ["a", "b", "c"]


def test_trailing_limit(spark, tmp_path):
    rows = [[("c", "crawl", ts(0, s)) for s in range(7)], [("c", "crawl", ts(1, 1)), ("d", "crawl", ts(1, 1))]]
    stream = replay(spark, tmp_path, rows, "client string, route string, ts timestamp", "lim")
    got = run(spark, ST.stream_over_limit(stream, {"crawl": 5}), "limits")
    assert sorted((r.client, r.ts.second, round(r.retry_after)) for r in got) == [("c", 5, 55), ("c", 6, 54)]


def test_feedback_windows(spark):
    rows = [(1, "portion_bigger", ts(0, day=d)) for d in (1, 2, 3)] + [(2, "dish_unavailable", ts(0, day=d)) for d in (1, 2, 3)] + [(3, "portion_bigger", ts(0))]
    df = spark.createDataFrame(rows, "dish_id int, feedback_type string, created_at timestamp")
    got = ST.decisions(ST.feedback_votes(df)).where("start <= timestamp '2024-01-01' and end > timestamp '2024-01-03'").collect()
    assert {(r.dish_id, r.portion, r.unavailable) for r in got} == {(1, "bigger", False), (2, "same", True)}


def test_sliding_limit(spark):
    df = spark.createDataFrame([("c", "crawl", ts(0, s)) for s in range(7)], "client string, route string, ts timestamp")
    got = ST.over_limit(df, {"crawl": 5}).collect()
    assert {r.n for r in got} == {7} and len(got) == 6


LIMIT_ROWS = [("c", "crawl", s) for s in (0, 0, 5, 10, 12, 59, 60, 61, 64, 70, 131, 132, 500)] + [("d", "crawl", 3), ("d", "free", 3), ("d", "free", 4), (None, "crawl", 7), (None, "crawl", 8)]


def by_hand(rows, limits, seconds):
    times, out = {}, []
    for client, route, s in sorted(rows, key=lambda r: r[2]):
        held = [x for x in times.get((client, route), []) if x > s - seconds]
        ok = route not in limits or len(held) < limits[route]
        out.append((client, route, s, len(held), ok, None if ok else float(held[0] + seconds - s)))
        times[client, route] = held + [s] * (ok and route in limits)
    return sorted(out, key=str)


def requests(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, r, start + dt.timedelta(seconds=s), s) for c, r, s in rows], "client string, route string, ts timestamp, s int")


def test_admitted_requests(spark):
    for limits in ({"crawl": 2}, {"crawl": 1}, {"crawl": 5, "free": 1}):
        got = L.admitted(requests(spark, LIMIT_ROWS), ["client", "route"], L.limit_of(limits), 60)
        assert sorted((tuple(r) for r in got.select("client", "route", "s", *L.FOLDED).collect()), key=str) == by_hand(LIMIT_ROWS, limits, 60)
    assert L.admitted(requests(spark, []), ["client", "route"], L.limit_of({"crawl": 2}), 60).count() == 0


def test_batch_limits_equal_the_stream(spark, tmp_path):
    rows = [r for r in LIMIT_ROWS if r[0] == "c"]
    batch = L.admitted(requests(spark, rows), ["client", "route"], L.limit_of({"crawl": 3}), 60).where("not admitted")
    parts = [[tuple(r) for r in requests(spark, rows).drop("s").collect()]]
    stream = replay(spark, tmp_path, parts, "client string, route string, ts timestamp", "exact")
    got = run(spark, ST.stream_over_limit(stream, {"crawl": 3}), "exact_limits")
    assert sorted((r.ts, r.in_window, r.retry_after) for r in got) == sorted((r.ts, r.in_window, r.retry_after) for r in batch.collect())


def test_repeats_equal_the_stream(spark, tmp_path):
    minutes = [0, 3, 9, 10, 15, 19, 20, 21, 55]
    rows = [("a", ts(m)) for m in minutes] + [("b", ts(4))]
    df = spark.createDataFrame(rows, "place string, ts timestamp")
    kept = sorted((r.place, r.ts) for r in L.first_of_repeats(df, ["place"]).where("kept").collect())
    assert [t.minute for p, t in kept if p == "a"] == [0, 10, 20, 55]
    stream = replay(spark, tmp_path, [rows[:5], rows[5:]], "place string, ts timestamp", "repeats")
    assert sorted((r.place, r.ts) for r in run(spark, L.stream_first_of_repeats(stream, "place"), "kept")) == kept


def test_trailing_counts(spark):
    got = L.trailing_counts(requests(spark, LIMIT_ROWS), ["client", "route"], 60).collect()
    want = sorted((str(c), r, s, sum(c2 == c and r2 == r and s - 60 < s2 <= s for c2, r2, s2 in LIMIT_ROWS)) for c, r, s in LIMIT_ROWS)
    assert sorted((str(r.client), r.route, r.s, r.n) for r in got) == want


def test_streamed_votes_equal_stored_ones(spark, tmp_path):
    rows = [(1, "portion_bigger", ts(0, day=d)) for d in (1, 2, 3)] + [(2, "dish_unavailable", ts(0, day=d)) for d in (1, 2, 2)]
    late = [(9, "portion_bigger", dt.datetime(2024, 6, 1))]
    schema = "dish_id int, feedback_type string, created_at timestamp"
    stream = replay(spark, tmp_path, [rows, late, late], schema, "votes")
    got = [r for r in run(spark, ST.decisions(ST.stream_votes(stream, "1 day")), "voted") if r.dish_id != 9]
    want = ST.decisions(ST.feedback_votes(spark.createDataFrame(rows, schema))).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))
