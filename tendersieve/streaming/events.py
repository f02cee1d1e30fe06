"""Event streams: windows, change capture, standing rules, digests. Every function takes a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def watermarked(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str) -> DataFrame:
    w = F.window("ts", width)
    rows = watermarked(events).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select(c("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    rows = watermarked(events).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return rows.select(c("window.start").alias("start"), c("window.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    rows = watermarked(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", c("w.start").alias("start"), "n")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's events once; on a stream within the watermark."""
    return watermarked(events).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def digest(events: DataFrame, width: str) -> DataFrame:
    """Per user and window: how many events, of which types (sorted)."""
    rows = watermarked(events).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("types"))
    return rows.select("user_id", c("window.start").alias("start"), "n", "types")


def changes(history: DataFrame, key: str, order: list[str], field: str) -> DataFrame:
    """Change capture over snapshots: each row against the next of its key, where the field differs."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = history.select(key, *order, c(field).alias("before"), F.lead(field).over(w).alias("after"), F.lead(F.struct(*order)).over(w).alias("next"))
    return rows.where(c("next").isNotNull() & ~c("before").eqNullSafe(c("after"))).drop("next")


def matches(events: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row a standing rule (name -> condition in SQL) and event it fits; rules are literals of the plan."""
    fits = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in rules.items()]))
    return events.select("event_id", "ts", F.explode(fits).alias("rule"))


def late(events: DataFrame, seen_until: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late): split at the watermark of what has been seen."""
    bound = F.lit(seen_until).cast("timestamp") - F.expr(f"interval {delay}")
    return events.where(c("ts") >= bound), events.where(c("ts") < bound)


def retry_due(failures: DataFrame, now: str, base_s: int, most_s: int) -> DataFrame:
    """Failures whose exponential back-off has passed."""
    wait = F.least(F.lit(float(base_s)) * F.pow(F.lit(2.0), c("retries")), F.lit(float(most_s)))
    return failures.where(F.unix_seconds(F.lit(now).cast("timestamp")) >= F.unix_seconds(c("last_attempt").cast("timestamp")) + wait)


def streaming_changes(snapshots: DataFrame, key: str, field: str) -> DataFrame:
    """``changes`` on a stream: the last value of each key is kept as state; rows (key, before, after)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, known = (state.get[0], True) if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        found = []
        for value in rows[field]:
            if known and value != last:
                found.append((k[0], last, value))
            last, known = value, True
        state.update((last,))
        yield pd.DataFrame(found, columns=[key, "before", "after"])

    kind = snapshots.schema[field].dataType.simpleString()
    own = snapshots.schema[key].dataType.simpleString()
    return snapshots.groupBy(key).applyInPandasWithState(step, f"{key} {own}, before {kind}, after {kind}", f"last {kind}", "append", GroupStateTimeout.NoTimeout)


def union_timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """Events of several tables as one timeline (at, kind, key)."""
    named = [df.select("at", F.lit(k).alias("kind"), "key") for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)
