"""Streams of samples and changes. Timestamps are event times in column ``ts``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType, DoubleType, StringType, TimestampType

KEYS = ["entity_id", "property"]
SAMPLE = StructType([StructField("entity_id", LongType()), StructField("property", StringType()), StructField("ts", TimestampType()), StructField("value", DoubleType())])


def rolling(samples: DataFrame, width: str = "60 seconds", late: str = "5 seconds", slide: str | None = None) -> DataFrame:
    """Windowed min, max, sum, count, mean and deviation per series; later samples than ``late`` are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = samples.withWatermark("ts", late).groupBy(window, *KEYS)
    out = grouped.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"))
    return out.select(F.col("window.start").alias("window_start"), *KEYS, "min", "max", "sum", "count", "mean", "stddev")


def sessions(samples: DataFrame, gap: str, late: str = "5 seconds") -> DataFrame:
    """(session_start, session_end, keys, count): runs of samples with no longer pause than ``gap``."""
    grouped = samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *KEYS).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *KEYS, "count")


def ingest(samples: DataFrame, tolerance_seconds: float = 5.0, arrival: str | None = None) -> DataFrame:
    """What each series keeps, by its own clock: too late samples go, then repeats of the value before.

    The state of a series is its last time and value. Samples of one batch count
    as arriving in the order of the column ``arrival``; without one, in the order
    of their times, so that only samples of earlier batches make them late.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ts, last_value = state.get if state.exists else (None, None)
        for rows in parts:
            rows = rows.sort_values(arrival or "ts", kind="stable")
            keep = []
            for ts, value in zip(rows["ts"], rows["value"]):
                now = ts.value
                late = last_ts is not None and now < last_ts - int(tolerance_seconds * 1e9)
                keep.append(not late and value != last_value)
                if not late:
                    last_value = value if last_ts is None or now >= last_ts else last_value
                    last_ts = now if last_ts is None else max(last_ts, now)
            yield rows.loc[keep, SAMPLE.names]
        state.update((last_ts, last_value))

    return samples.groupBy(*KEYS).applyInPandasWithState(run, SAMPLE, StructType([StructField("ts", LongType()), StructField("value", DoubleType())]), "append", GroupStateTimeout.NoTimeout)


def change_feed(changes: DataFrame, labels: list[str] | None = None, kinds: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """A subscription: changes of some labels and kinds that meet a condition."""
    out = changes if not labels else changes.where(F.col("label").isin(labels))
    out = out if not kinds else out.where(F.col("change").isin(kinds))
    return out if condition is None else out.where(condition)


def view(changes: DataFrame, value: str = "value") -> DataFrame:
    """A running count, sum and mean of signed changes: ``sign`` is 1 for an added row and -1 for a removed one."""
    sums = changes.groupBy().agg(F.sum("sign").alias("count"), F.sum(F.col("sign") * F.col(value)).alias("sum"))
    return sums.select("count", "sum", (F.col("sum") / F.nullif("count", F.lit(0))).alias("avg"))


def value_counts(changes: DataFrame, before: DataFrame | None = None, value: str = "value") -> DataFrame:
    """(value, n): how often each value is held after signed changes; with ``before``, after those and the earlier ones."""
    rows = changes.select(F.col(value).alias("value"), F.col("sign").cast("long").alias("n"))
    rows = rows if before is None else rows.unionByName(before)
    return rows.groupBy("value").agg(F.sum("n").alias("n")).where("n > 0")


def extremes(counts: DataFrame) -> DataFrame:
    """(min, max, values): of a view's ``value_counts``; a removed extreme gives way to the next, ``values`` holds repeats."""
    return counts.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.array_sort(F.flatten(F.collect_list(F.expr("array_repeat(value, cast(n AS int))")))).alias("values"))


def on_change(changes: DataFrame, action: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, depth: int = 8):
    """A trigger: each batch of changes runs ``action``; what that yields triggers again, at most ``depth`` times.

    A cascade that has not ended by then is an error, which stops the stream.
    """

    def batch(df: DataFrame, _: int) -> None:
        for _ in range(depth):
            if df.isEmpty():
                return
            df = action(df)
            sink(df)
        if not df.isEmpty():
            raise RuntimeError(f"changes still follow after {depth} rounds of the trigger")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
