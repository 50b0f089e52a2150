"""Time-series procedures over ``samples(entity_id, property, timestamp, value)``.

``timestamp`` is BIGINT nanoseconds. A procedure takes all series of the table at
once and answers for each (entity_id, property); filter the samples first for
one. Look-back windows take an explicit ``now``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pgspark.functions.scalar import floor_to

KEYS = ["entity_id", "property"]
SECOND = 1_000_000_000
AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double")}


#: Series are cut into slices of this many nanoseconds where neighbours are looked up: a series of any length is then
#: many groups, and only a row for each of its slices meets in one.
SLICE = 86_400 * SECOND


def _series() -> Window:
    return Window.partitionBy(*KEYS).orderBy("timestamp")


def _slices() -> Window:
    return Window.partitionBy(*KEYS).orderBy("_slice")


def value_range(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Samples of [start, end], both ends included."""
    return samples.where(F.col("timestamp").between(start, end))


def latest(samples: DataFrame) -> DataFrame:
    """(keys, timestamp, value): the last sample of each series; ties go to the larger value."""
    last = F.max(F.struct("timestamp", "value")).alias("s")
    return samples.groupBy(*KEYS).agg(last).select(*KEYS, "s.timestamp", "s.value")


def value_at(samples: DataFrame, probes: DataFrame, fill: str = "locf") -> DataFrame:
    """(keys, at, value, actual_timestamp, interpolated): the as-of value at each ``probes(keys, at)``.

    ``locf`` takes the last sample at or before, ``linear`` lies between that and
    the next (locf after the last), ``none`` needs an exact one. Without history
    there is no row. Samples and probes are one sorted stream per slice of a
    series, so no sample meets a probe it does not answer; what lies beyond a
    slice comes from the last sample before it and the first after it.
    """
    marked = samples.select(*KEYS, F.col("timestamp").alias("t"), F.col("value").alias("v"), F.lit(0).alias("probe"))
    asked = probes.select(*KEYS, F.col("at").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("probe"))
    of_slice = Window.partitionBy(*KEYS, "_slice").orderBy("t", "probe")
    before, after = of_slice.rowsBetween(Window.unboundedPreceding, 0), of_slice.rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("probe") == 0, F.struct("t", "v"))
    stream = marked.unionAll(asked).withColumn("_slice", floor_to(F.col("t"), SLICE))
    ends = stream.groupBy(*KEYS, "_slice").agg(F.max(own).alias("_last"), F.min(own).alias("_first"))
    earlier, later = _slices().rowsBetween(Window.unboundedPreceding, -1), _slices().rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(*KEYS, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"), F.first("_first", ignorenulls=True).over(later).alias("_later"))
    inner = stream.withColumn("p", F.last(own, ignorenulls=True).over(before)).withColumn("n", F.first(own, ignorenulls=True).over(after)).where("probe = 1")
    rows = inner.join(ends, [*KEYS, "_slice"]).withColumn("p", F.coalesce("p", "_earlier")).withColumn("n", F.coalesce("n", "_later")).where("p IS NOT NULL")
    exact = F.col("p.t") == F.col("t")
    if fill == "none":
        rows = rows.where(exact)
    between = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    mixed = F.when(~exact & F.col("n").isNotNull(), between).otherwise(F.col("p.v")) if fill == "linear" else F.col("p.v")
    return rows.select(*KEYS, F.col("t").alias("at"), mixed.alias("value"), F.col("p.t").alias("actual_timestamp"), (~exact).alias("interpolated"))


def gap_fill(samples: DataFrame, start: int, end: int, interval: int, fill: str = "locf") -> DataFrame:
    """``value_at`` on the clock-aligned grid of [start, end]; grid points without history are left out."""
    first = -(-start // interval) * interval
    grid = samples.select(*KEYS).distinct().select(*KEYS, F.explode(F.sequence(F.lit(first), F.lit(end), F.lit(interval))).alias("at")) if first <= end else samples.limit(0).select(*KEYS, F.col("timestamp").alias("at"))
    return value_at(samples, grid, fill)


def aggregate(samples: DataFrame, now: int, duration: int, fn: str) -> DataFrame:
    """(keys, value) over (now - duration, now]; series without samples there have no row. ``twa``: time-weighted average."""
    start = now - duration
    if fn != "twa":
        return value_range(samples, start, now).groupBy(*KEYS).agg(AGGREGATES[fn](F.col("value")).alias("value"))
    # The value at the left boundary holds until the first sample; all is divided by the whole duration.
    held = latest(samples.where(F.col("timestamp") < start)).withColumn("timestamp", F.lit(start))
    inside = value_range(samples, start, now).select(*KEYS, "timestamp", "value")
    some = inside.select(*KEYS).distinct()
    rows = inside.unionByName(held.join(some, KEYS, "left_semi"))
    rows = rows.withColumn("_slice", floor_to(F.col("timestamp"), SLICE))
    until = F.lead("timestamp").over(Window.partitionBy(*KEYS, "_slice").orderBy("timestamp"))
    inner = rows.select(*KEYS, (F.col("value") * (until - F.col("timestamp"))).alias("w"))
    # The last sample of a slice holds until the next slice's first.
    ends = rows.groupBy(*KEYS, "_slice").agg(F.min("timestamp").alias("first"), F.max(F.struct("timestamp", "value")).alias("last"))
    held = F.coalesce(F.lead("first").over(_slices()), F.lit(now)) - F.col("last.timestamp")
    weighted = inner.where("w IS NOT NULL").unionAll(ends.select(*KEYS, (F.col("last.value") * held).alias("w")))
    return weighted.groupBy(*KEYS).agg((F.sum("w") / F.lit(duration)).alias("value"))


def windows(samples: DataFrame, width: int, fn: str) -> DataFrame:
    """(keys, window_start, window_end, value): tumbling windows from each series' first sample."""
    first = samples.groupBy(*KEYS).agg(F.min("timestamp").alias("_first"))
    start = (F.col("_first") + floor_to(F.col("timestamp") - F.col("_first"), width)).alias("window_start")
    placed = samples.join(first, KEYS).select(*KEYS, "value", start)
    return placed.groupBy(*KEYS, "window_start").agg(AGGREGATES[fn](F.col("value")).alias("value")).select(*KEYS, "window_start", (F.col("window_start") + width).alias("window_end"), "value")


def gaps(samples: DataFrame, threshold: int) -> DataFrame:
    """(keys, gap_start, gap_end, duration_nanos): neighbours further apart than the threshold."""
    rows = samples.select(*KEYS, "timestamp", floor_to(F.col("timestamp"), SLICE).alias("_slice"))
    inner = rows.select(*KEYS, F.lag("timestamp").over(Window.partitionBy(*KEYS, "_slice").orderBy("timestamp")).alias("gap_start"), F.col("timestamp").alias("gap_end"))
    ends = rows.groupBy(*KEYS, "_slice").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    pairs = inner.unionAll(ends.select(*KEYS, F.lag("last").over(_slices()).alias("gap_start"), F.col("first").alias("gap_end")))
    apart = F.col("gap_end") - F.col("gap_start")
    return pairs.where(apart > threshold).select(*KEYS, "gap_start", "gap_end", apart.alias("duration_nanos"))


def _z(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    # Statistics are aggregated first and joined, so a long series is not one window in one task.
    stats = df.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    scored = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row
    return scored.where(F.col("_s") > 1e-12).withColumn("z_score", (F.col("value") - F.col("_m")) / F.col("_s")).where(F.abs("z_score") > threshold).drop("_m", "_s")


def anomalies(samples: DataFrame, threshold: float) -> DataFrame:
    """(keys, timestamp, value, z_score): samples beyond ``threshold`` standard deviations of their series."""
    return _z(samples.select(*KEYS, "timestamp", "value"), KEYS, threshold)


def peer_anomalies(samples: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(entity_id, value, z_score): latest values of ``members(entity_id)`` that stand out from the others."""
    last = latest(samples).join(members.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "value")
    return _z(last, [], threshold)


def scoped_aggregate(samples: DataFrame, members: DataFrame, fn: str) -> DataFrame:
    """(property, value, node_count, sample_count): pooled samples of ``members(entity_id)``."""
    pooled = samples.join(members.select("entity_id").distinct(), "entity_id", "left_semi")
    return pooled.groupBy("property").agg(AGGREGATES[fn](F.col("value")).alias("value"), F.countDistinct("entity_id").alias("node_count"), F.count(F.lit(1)).alias("sample_count"))


def warm(samples: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """Epoch-aligned rollup: window_start, min, max, sum, count, mean, stddev_pop, p50, p90, p95, p99.

    Deviation and quantiles of a single sample are null.
    """
    start = floor_to(F.col("timestamp"), width).alias("window_start")
    several = lambda c: F.when(F.count("value") > 1, c)
    quantile = lambda q: several(F.percentile_approx("value", q, 10_000)).alias(f"p{int(q * 100)}")
    return samples.groupBy(*KEYS, start).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count("value").alias("count"), F.avg("value").alias("mean"), several(F.stddev_pop("value")).alias("stddev"), *[quantile(q) for q in (0.5, 0.9, 0.95, 0.99)])


def percentile(samples: DataFrame, q: float, width: int = 60 * SECOND) -> DataFrame:
    """(keys, value): count-weighted mean of the windows' quantiles; q is taken to the nearest of 0.5, 0.9, 0.95, 0.99.

    Windows of a single sample have no quantile and do not count.
    """
    near = min((0.5, 0.9, 0.95, 0.99), key=lambda x: abs(x - q))
    c = F.col(f"p{int(near * 100)}")
    return warm(samples, width).groupBy(*KEYS).agg((F.sum(c * F.col("count")) / F.sum(F.when(c.isNotNull(), F.col("count")))).alias("value"))


def downsample(warm_table: DataFrame, start: int, end: int) -> DataFrame:
    """(keys, window_start, min, max, mean, total) of the rollup's windows in [start, end]."""
    return warm_table.where(F.col("window_start").between(start, end)).select(*KEYS, "window_start", "min", "max", "mean", F.col("count").alias("total"))


def hourly(warm_table: DataFrame) -> DataFrame:
    """Windows merged by hour; no deviation or quantiles, as they do not merge."""
    start = floor_to(F.col("window_start"), 3600 * SECOND).alias("window_start")
    merged = warm_table.groupBy(*KEYS, start).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("total"))
    return merged.select(*KEYS, "window_start", "min", "max", (F.col("sum") / F.col("total")).alias("mean"), "total")


def full_range(hot: DataFrame, cold: DataFrame, start: int, end: int) -> DataFrame:
    """Samples of both tiers; the hot one wins where timestamps are equal."""
    rows = value_range(hot, start, end).withColumn("_tier", F.lit(1)).unionByName(value_range(cold, start, end).withColumn("_tier", F.lit(0)))
    return rows.groupBy(*KEYS, "timestamp").agg(F.max_by("value", "_tier").alias("value"))


def upsert(samples: DataFrame, observations: DataFrame) -> DataFrame:
    """Samples and new observations; of equal series and time the observation stays, of several of one side the largest."""
    rows = samples.select(*KEYS, "timestamp", "value", F.lit(0).alias("_new")).unionAll(observations.select(*KEYS, "timestamp", "value", F.lit(1).alias("_new")))
    return rows.groupBy(*KEYS, "timestamp").agg(F.max(F.struct("_new", "value")).alias("_s")).select(*KEYS, "timestamp", "_s.value")


def ingest(samples: DataFrame, tolerance: int = 5 * SECOND, arrival: str = "arrival") -> DataFrame:
    """What a series keeps: late samples beyond the tolerance go, then repeats of the value before."""
    so_far = F.max("timestamp").over(Window.partitionBy(*KEYS).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    kept = samples.withColumn("_seen", so_far).where(F.col("_seen").isNull() | (F.col("timestamp") >= F.col("_seen") - tolerance)).drop("_seen")
    before = F.lag("value").over(_series())
    return kept.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("value"))).drop("_before")


def as_samples(df: DataFrame, entity: Column, prop: Column, ts: Column, value: Column) -> DataFrame:
    """A samples table from other columns; ``ts`` is a timestamp of microseconds."""
    nanos = F.unix_micros(ts.cast("timestamp")) * 1000
    return df.select(entity.cast("long").alias("entity_id"), prop.alias("property"), nanos.alias("timestamp"), value.cast("double").alias("value"))
