"""State changes as new snapshots: upserts, archiving, deletes, folds and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.text import clean_name

JUNK_REASONS = ["junk", "duplicate", "non_food"]  # fixed values


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], insert_only: list[str] | None = None, keep_nulls: bool = False, revive: list[str] | None = None) -> DataFrame:
    """The table after an insert-or-update by key.

    Columns in ``insert_only`` are set for new rows alone; with ``keep_nulls`` a null update keeps
    the stored value; ``revive`` columns (archive marks) are cleared on rows that come again. Write
    the result to a new place, since the target is still being read.
    """
    insert_only, revive = insert_only or [], revive or []
    t = target.withColumn("_t", F.lit(True)).alias("t")
    u = updates.withColumn("_u", F.lit(True)).alias("u")
    cond = None
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}"))
        cond = c if cond is None else cond & c
    both = t.join(u, cond, "full_outer")
    new = F.col("u._u").isNotNull()
    out = []
    for c in target.columns:
        if c in keys:
            v = F.when(F.col("t._t").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"u.{c}"))
        elif c in revive:
            v = F.when(new, F.lit(None)).otherwise(F.col(f"t.{c}"))
        elif c not in updates.columns:
            v = F.col(f"t.{c}")
        elif c in insert_only:
            v = F.when(F.col("t._t").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"u.{c}"))
        elif keep_nulls:
            v = F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}"))
        else:
            v = F.when(new, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}"))
        out.append(v.alias(c))
    return both.select(*out)


def archive(df: DataFrame, pred: Column, reason: str, now) -> DataFrame:
    """Soft-delete rows that are not archived yet."""
    hit = F.coalesce(pred, F.lit(False)) & F.col("archived_at").isNull()
    return df.withColumn("archived_reason", F.when(hit, reason).otherwise(F.col("archived_reason"))).withColumn("archived_at", F.when(hit, now).otherwise(F.col("archived_at")))


def restore(df: DataFrame, pred: Column) -> DataFrame:
    hit = F.coalesce(pred, F.lit(False))
    return df.withColumn("archived_at", F.when(~hit, F.col("archived_at"))).withColumn("archived_reason", F.when(~hit, F.col("archived_reason")))


def hard_delete(df: DataFrame, ids: DataFrame, now, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(kept rows, refused requests with the rule they break): only sure junk, archived for a week, goes."""
    asked = df.join(ids.select(key).distinct(), key, "left_semi")
    why = (
        F.when(~F.coalesce(F.col("archived_reason").isin(JUNK_REASONS), F.lit(False)), "reason is not junk")
        .when(F.coalesce("audit_confidence", F.lit(0.0)) < 0.9, "confidence below 0.9")
        .when(F.col("archived_at").isNull(), "not archived")
        .when(F.col("archived_at") > now - F.make_dt_interval(days=F.lit(7)), "archived less than 7 days ago")
    )
    judged = asked.withColumn("refused", why)
    kept = df.join(judged.where("refused is null").select(key), key, "left_anti")
    return kept, judged.where("refused is not null").select(key, "refused")


def fold_toggles(members: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Membership after a log of toggles: an odd number of them turns it over."""
    odd = events.groupBy(*keys).agg((F.count(F.lit(1)) % 2 == 1).alias("odd")).where("odd").select(*keys)
    stay = members.join(odd, keys, "left_anti")
    return stay.select(*keys).unionByName(odd.join(members, keys, "left_anti"))


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given ids."""
    return {name: df.join(ids.select(key), key, "left_anti") for name, df in tables.items()}


def merge_duplicates(dishes: DataFrame, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One dish, the earliest, per restaurant and cleaned name; children point to it."""
    cleaned = dishes.withColumn("name", F.coalesce(clean_name("name"), F.col("name")))
    w = Window.partitionBy("restaurant_id", F.lower("name")).orderBy("created_at", "dish_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mapped = cleaned.withColumn("keeper", F.first("dish_id").over(w))
    moves = mapped.where("keeper <> dish_id").select("dish_id", "keeper")
    out = {n: c.join(moves, "dish_id", "left").withColumn("dish_id", F.coalesce("keeper", "dish_id")).drop("keeper") for n, c in children.items()}
    return mapped.where("keeper = dish_id").drop("keeper"), out


def quarantine(df: DataFrame, valid: Column, error: Column, now) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with error, attempts and time)."""
    ok = F.coalesce(valid, F.lit(False))
    bad = df.where(~ok).withColumn("error", error).withColumn("attempts", F.lit(1)).withColumn("failed_at", now)
    return df.where(ok), bad


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items after review: reject archives, retype sets the type, alcohol is never a dish card.

    ``decisions`` has item_id, action (reject, retype, approve) and new_type.
    """
    d = decisions.select("item_id", "action", "new_type")
    out = items.join(d, "item_id", "left")
    kind = F.when(F.col("action") == "retype", F.col("new_type")).otherwise(F.col("item_type"))
    out = out.withColumn("item_type", kind)
    rejected = F.coalesce(F.col("action") == "reject", F.lit(False))
    card = F.col("is_dish_card") & ~rejected & (F.coalesce("item_type", F.lit("")) != "alcohol")
    return out.withColumn("is_rejected", rejected).withColumn("is_dish_card", card).drop("action", "new_type")


def apply_photo_decisions(photos: DataFrame, decisions: DataFrame) -> DataFrame:
    """Photos after review: reject drops one, remove_all drops a dish's, demote sends it to the end."""
    gone = decisions.where("action = 'reject'").select("photo_id")
    dishes = decisions.where("action = 'remove_all'").select("dish_id").distinct()
    low = decisions.where("action = 'demote'").select("photo_id", F.lit(True).alias("demoted")).distinct()
    out = photos.join(gone, "photo_id", "left_anti").join(dishes, "dish_id", "left_anti").join(low, "photo_id", "left")
    return out.withColumn("demoted", F.coalesce("demoted", F.lit(False)))


def fold_reads(log: DataFrame, reads: DataFrame) -> DataFrame:
    """Notifications with the first read event written in where unread; an event without id reads all of a user."""
    one = reads.where("notification_id is not null").groupBy("notification_id").agg(F.min("ts").alias("one"))
    all_ = reads.where("notification_id is null").groupBy("user_id").agg(F.max("ts").alias("last_all"))
    out = log.join(one, "notification_id", "left").join(all_, "user_id", "left")
    covered = F.when(F.col("created_at") <= F.col("last_all"), F.col("last_all"))
    return out.withColumn("read_at", F.coalesce("read_at", F.least("one", covered))).drop("one", "last_all")


def append_feedback(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): known type, a dish, and an http(s) photo URL where one is needed."""
    from platewise.operators.filters import FEEDBACK_TYPES

    url = F.coalesce("photo_url", F.lit(""))
    why = (
        F.when(~F.coalesce(F.col("feedback_type").isin(FEEDBACK_TYPES), F.lit(False)), "unknown type")
        .when(F.col("dish_id").isNull(), "no dish")
        .when((url != "") & ~url.rlike("^https?://[^ ]+$"), "bad photo url")
        .when((F.col("feedback_type") == "photo_submission") & (url == ""), "no photo url")
    )
    judged = events.withColumn("reason", why)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
