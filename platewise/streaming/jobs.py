"""Structured Streaming jobs over traffic, requests and feedback.

Each takes a streaming DataFrame and gives one (or starts a query), so any source that Spark reads
can feed them; the same functions run on batch frames where that makes sense.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.numbers import day_of_week, wait_minutes
from platewise.operators.aggregates import MIN_NET, MIN_REPORTS
from platewise.operators.filters import FEEDBACK_TYPES

LIMITS = {"search": 60, "crawl": 5, "api": 100, "photo": 20, "auth": 5}  # fixed values: requests a minute


def traffic_slots(snapshots: DataFrame) -> DataFrame:
    """Latest busyness of each (restaurant, day, hour) among snapshots, by event time."""
    keyed = snapshots.withColumn("dow", day_of_week("ts")).withColumn("hour", F.hour("ts"))
    last = F.max_by(F.struct("busyness", "ts"), F.struct("ts", "busyness")).alias("s")
    out = keyed.groupBy("restaurant_id", "dow", "hour").agg(last).select("restaurant_id", "dow", "hour", "s.*")
    return out.withColumn("wait", wait_minutes("busyness"))


BUCKETS = 64  # folders of the stored grid


def merge_slots(new: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Merge slots into the grid at ``path`` by key, the newer event time wins; returns how many folders were written.

    The grid lies in folders by hash of the restaurant. A batch reads and writes the folders of its own
    restaurants only, and merging the same batch again changes nothing.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64("restaurant_id"), F.lit(buckets)).cast("int")
    new = new.select("restaurant_id", "dow", "hour", "busyness", "ts").withColumn("bucket", bucket)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = new.unionByName(spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)))
    last = F.max_by(F.struct("busyness", "ts"), F.struct("ts", "busyness")).alias("s")
    out = new.groupBy("bucket", "restaurant_id", "dow", "hour").agg(last).select("restaurant_id", "dow", "hour", "s.*", "bucket")
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def stream_traffic(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep the weekly grid at ``path`` (see :func:`merge_slots`): 168 rows a restaurant, whatever the number of snapshots read."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_slots(traffic_slots(batch), path, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def stream_dedup(stream: DataFrame, key: str, within: str = "10 minutes") -> DataFrame:
    """One request for each key within the time."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def over_limit(events: DataFrame, limits: dict[str, int] | None = None, window: str = "60 seconds", slide: str = "10 seconds", watermark: str | None = None) -> DataFrame:
    """Sliding windows in which a client made more requests of a route class than allowed."""
    limits = limits or LIMITS
    allowed = F.try_element_at(F.create_map(*[F.lit(v) for kv in limits.items() for v in kv]), F.col("route"))
    df = events.withWatermark("ts", watermark) if watermark else events
    n = df.groupBy(F.window("ts", window, slide), "client", "route").agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumn("allowed", allowed).where(F.col("n") > F.col("allowed"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "client", "route", "n", "allowed")


def stream_over_limit(stream: DataFrame, limits: dict[str, int] | None = None, seconds: int = 60) -> DataFrame:
    """Exact trailing window: each request that exceeds the limit of the last minute, with the time to wait.

    The state of a client and route is the times of its last minute, at most the limit of them; it goes
    when the watermark has passed them by.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    limits = limits or LIMITS

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        client, route = key
        allowed = limits.get(route)
        times = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(pd.concat([b.ts for b in batches]).tolist()):
            now = t.timestamp()
            times = [x for x in times if x > now - seconds]
            if allowed is not None and len(times) >= allowed:
                out.append((client, route, t, len(times), times[0] + seconds - now))
            else:
                times.append(now)
        state.update((times,))
        last = int((times[-1] + 2 * seconds) * 1000) if times else 0
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame(out, columns=["client", "route", "ts", "in_window", "retry_after"])

    schema = "client string, route string, ts timestamp, in_window int, retry_after double"
    timed = stream.withWatermark("ts", f"{seconds} seconds")
    return timed.groupBy("client", "route").applyInPandasWithState(run, schema, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def feedback_votes(feedback: DataFrame, days: int = 30) -> DataFrame:
    """Votes of each type per dish in windows of ``days`` days, a day apart: every window with a vote.

    Votes are added up by dish and day first. A day enters the windows that begin up to ``days`` - 1 days
    before it and leaves those that begin behind it, so two changes a day are summed along the starts and
    the windows are written out as they leave; nothing holds ``days`` rows for each day of votes.
    """
    kind = feedback.schema["created_at"].dataType.simpleString()
    day = F.to_date("created_at").alias("day")
    votes = [F.sum((F.col("feedback_type") == t).cast("int")).alias(t) for t in FEEDBACK_TYPES]
    daily = feedback.where("created_at is not null").groupBy("dish_id", day).agg(*votes)
    names = [*FEEDBACK_TYPES, "days"]
    change = lambda at, sign: F.struct(at.alias("start"), *[(sign * F.coalesce(t, F.lit(0))).alias(t) for t in FEEDBACK_TYPES], F.lit(sign).cast("bigint").alias("days"))
    changes = daily.select("dish_id", F.explode(F.array(change(F.date_sub("day", days - 1), 1), change(F.date_add("day", 1), -1))).alias("c")).select("dish_id", "c.*")
    changes = changes.groupBy("dish_id", "start").agg(*[F.sum(t).alias(t) for t in names])
    w = Window.partitionBy("dish_id").orderBy("start")
    runs = changes.select("dish_id", "start", F.lead("start").over(w).alias("next"), *[F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(t) for t in names]).where("days > 0")
    rolled = runs.select("dish_id", F.explode(F.sequence("start", F.date_sub("next", 1))).alias("start"), *FEEDBACK_TYPES).withColumn("start", F.col("start").cast(kind))
    end = F.expr(f"start + interval {days} days")
    return rolled.select(F.struct(F.col("start"), end.alias("end")).alias("window"), "dish_id", *FEEDBACK_TYPES)


def stream_votes(feedback: DataFrame, watermark: str) -> DataFrame:
    """The same on a stream: daily votes, then windows over the days."""
    votes = [F.sum((F.col("feedback_type") == t).cast("int")).alias(t) for t in FEEDBACK_TYPES]
    daily = feedback.withWatermark("created_at", watermark).groupBy(F.window("created_at", "1 day"), "dish_id").agg(*votes)
    daily = daily.withColumn("at", F.window_time("window")).drop("window")
    return daily.groupBy(F.window("at", "30 days", "1 day"), "dish_id").agg(*[F.sum(t).alias(t) for t in FEEDBACK_TYPES])


def decisions(votes: DataFrame) -> DataFrame:
    """What the votes of a window decide: portion factor and unavailability."""
    more, less = F.col("portion_bigger"), F.col("portion_smaller")
    enough = more + less >= MIN_REPORTS
    portion = F.when(enough & (more - less >= MIN_NET), "bigger").when(enough & (less - more >= MIN_NET), "smaller").otherwise("same")
    out = votes.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "dish_id", portion.alias("portion"), (F.col("dish_unavailable") >= MIN_REPORTS).alias("unavailable"))
    return out.where("portion <> 'same' or unavailable")


def stream_feedback(stream: DataFrame, path: str, checkpoint: str):
    """Append each finished window's decisions to ``path``."""
    out = decisions(stream_votes(stream, "1 day"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
