"""Trailing request limits and repeat suppression, on stored events and on streams.

Only requests that were let through count against a limit, so whether one passes depends on those
before it: a fold over each client's times, not a window count. With a limit of one it is repeat
suppression: a request counts again once the time has passed since the last that counted.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDED = ["in_window", "admitted", "retry_after"]


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_counts(events: DataFrame, keys: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """``events`` with n: the requests of the same keys in the ``seconds`` up to each, itself included."""
    frame = Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("n", F.count(F.lit(1)).over(frame))


def runs(events: DataFrame, keys: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """``events`` with _slot and _run: stretches of a key's requests that no empty slot of ``seconds`` parts.

    Requests of different runs are further apart than ``seconds``, so each run is folded by itself. Runs
    are found on the counts by key and slot, which are made before anything is shuffled by key.
    """
    slotted = events.withColumn("_slot", F.floor(micros(ts) / F.lit(seconds * 1_000_000)))
    slots = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    begins = F.coalesce((F.col("_slot") - F.lag("_slot").over(order) > 1).cast("int"), F.lit(0))
    slots = slots.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order)).drop("_n", "_begins")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_slot"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return slotted.alias("a").join(slots.alias("b"), cond).select("a.*", "b._run")


def admitted(events: DataFrame, keys: list[str], allowed: Column, seconds: int, order: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """``events`` with in_window, admitted and retry_after.

    ``in_window`` counts the admitted requests of the same keys less than ``seconds`` before; a request is
    admitted while they are fewer than ``allowed`` (null: no limit), else ``retry_after`` has the
    seconds until the oldest of them has passed. Equal times go by ``order``. A run (see :func:`runs`) is
    read as a stream and keeps the times of its last ``seconds``, at most ``allowed`` of them. Requests without
    a time are left out.
    """
    order = order or []
    at = [*keys, "_run"]
    cut = runs(events.where(F.col(ts).isNotNull()).withColumn("_allowed", allowed.cast("int")), keys, seconds, ts).withColumn("_t", micros(ts))
    dealt = cut.repartition(*at).sortWithinPartitions(*at, "_t", *order)
    span = seconds * 1_000_000

    kept = [f.name for f in events.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, deque()
        for batch in batches:
            counts, passes, waits = [], [], []
            keyed = zip(*(batch[k].to_pylist() for k in at))
            for key, t, most in zip(keyed, batch["_t"].to_pylist(), batch["_allowed"].to_pylist()):
                if key != now:
                    now, times = key, deque()
                while times and times[0] <= t - span:
                    times.popleft()
                counts.append(len(times))
                passes.append(most is None or len(times) < most)
                waits.append(None if passes[-1] else (times[0] + span - t) / 1e6 if times else float(seconds))
                if most is not None and passes[-1]:
                    times.append(t)
            found = [pa.array(counts, pa.int32()), pa.array(passes, pa.bool_()), pa.array(waits, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch[k] for k in kept] + found, names=kept + FOLDED)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, in_window int, admitted boolean, retry_after double")


def limit_of(limits: dict[str, int], route: str = "route") -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in limits.items() for v in kv]), F.col(route))


def first_of_repeats(events: DataFrame, keys: list[str], seconds: int = 600, order: list[str] | None = None) -> DataFrame:
    """``events`` with kept: false for requests within ``seconds`` of the last kept one of their keys."""
    return admitted(events, keys, F.lit(1), seconds, order).withColumnRenamed("admitted", "kept").drop("in_window", "retry_after")


def stream_first_of_repeats(stream: DataFrame, key: str, seconds: int = 600) -> DataFrame:
    """The kept requests (key, ts) of a stream; the state of a key is the time of its last kept one."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(pd.concat([b.ts for b in batches]).tolist()):
            if last is None or t.timestamp() >= last + seconds:
                out.append((*of, t))
                last = t.timestamp()
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame(out, columns=[key, "ts"])

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.withWatermark("ts", f"{seconds} seconds")
    return timed.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, ts timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)
