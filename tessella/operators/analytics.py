"""Operational analytics: rates, zero-filled calendars, histograms, usage totals and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hours by which calendar days are shifted against UTC.
ZONE_HOURS = 8


def percent(part: Column, whole: Column, empty: float) -> Column:
    """100 * part / whole; ``empty`` where the whole is 0."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(empty))


def satisfaction(likes: Column, total: Column) -> Column:
    """100 without any feedback."""
    return percent(likes, total, 100.0)


def success_rate(success: Column, total: Column) -> Column:
    """0 without any call."""
    return percent(success, total, 0.0)


def local_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr(f"INTERVAL {ZONE_HOURS} HOURS"))


def calendar(spark, last: str, days: int) -> DataFrame:
    """``days`` dates that end with ``last``."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date_sub(date'{last}', {days - 1}), date'{last}', interval 1 day)")).alias("day"))


def zero_filled(counts: DataFrame, frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row of ``frame`` with its value, 0 where there is none. The frame is a small calendar."""
    return F.broadcast(frame).join(counts, keys, "left").select(*keys, F.coalesce(value, F.lit(0)).alias(value))


def daily_active(events: DataFrame, ts: str, user: str, last: str, days: int) -> DataFrame:
    """(day, users): distinct users for each of the calendar's days."""
    counts = events.groupBy(local_day(F.col(ts)).alias("day")).agg(F.count_distinct(user).alias("users"))
    return zero_filled(counts, calendar(events.sparkSession, last, days), ["day"], "users")


def rolling_days(events: DataFrame, ts: str, now: str, n: int) -> DataFrame:
    """(bucket, start, calls): the n times 24 hours before ``now``, each half open, the latest first."""
    end = F.lit(now).cast("timestamp_ntz")
    age = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) - 1) / 86_400_000_000)
    counts = events.filter((F.col(ts) < end) & (age < n)).groupBy(age.cast("int").alias("bucket")).agg(F.count("*").alias("calls"))
    frame = events.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    start = F.to_date(F.expr(f"timestamp_ntz'{now}' - make_dt_interval(bucket + 1)"))
    return zero_filled(counts, frame, ["bucket"], "calls").select("bucket", start.alias("start"), "calls")


def series_summary(series: DataFrame, period: str, value: str) -> DataFrame:
    """(total, average, peak_period, peak) of a series; the earliest period of equal peaks."""
    by_period = series.groupBy(period).agg(F.sum(value).alias("v"))
    best = F.min(F.struct((-F.col("v")).alias("n"), F.col(period).alias("p"))).alias("best")
    return by_period.agg(F.sum("v").alias("total"), F.avg("v").alias("average"), best).select(
        "total", "average", F.col("best.p").alias("peak_period"), (-F.col("best.n")).alias("peak")
    )


def depth_bin(n: Column) -> Column:
    """The bin of a conversation's depth; no count is 0."""
    n = F.coalesce(n, F.lit(0))
    return F.when(n <= 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("20+")


def conversation_tokens(conversations: DataFrame, runs: DataFrame, legacy: DataFrame) -> DataFrame:
    """(conversation_id, tokens, complete): the sum of the runs that reported or are complete, and whether all are;
    without such runs the conversation's old total, if it is not 0."""
    told = runs.filter("reported > 0 or complete").groupBy("conversation_id").agg(F.sum("tokens").alias("own"), F.bool_and("complete").alias("complete"))
    old = legacy.select("conversation_id", F.nullif("total", F.lit(0)).alias("old"))
    joined = conversations.select("conversation_id").join(told, "conversation_id", "left").join(old, "conversation_id", "left")
    return joined.select("conversation_id", F.coalesce("own", "old").alias("tokens"), F.coalesce("complete", F.lit(False)).alias("complete"))


def usage_by_model(calls: DataFrame) -> DataFrame:
    """(model, calls, input, output, cached, hit_ratio, complete) by model, and a row of totals with a null model.
    The ratio of cached input has four places, and is null without input."""
    sums = calls.rollup("model").agg(
        F.count("*").alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cached").alias("cached"), F.bool_and("reported").alias("complete")
    )
    return sums.withColumn("hit_ratio", F.round(F.try_divide("cached", "input"), 4))


def milliseconds(start: Column, end: Column) -> Column:
    """The time between, or null if a bound is missing or it is negative."""
    ms = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000
    return F.when(ms >= 0, ms)


def nearest_rank(values: DataFrame, by: list[str], value: str, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, n, p50, p95): nearest-rank percentiles of the values that are not null."""
    cols = [F.expr(f"percentile_disc({q}) within group (order by {value})").alias(f"p{round(100 * q)}") for q in ranks]
    return values.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *cols)


def phase_times(boundaries: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """(key, order, ms): from each boundary to the next of the same key."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, order))
    return boundaries.select(key, order, milliseconds(F.col(at), following).alias("ms")).filter("ms is not null")


def span_means(spans: DataFrame, requests: DataFrame, cutoff: str) -> DataFrame:
    """(mean_ms): the spans of a request summed, each clipped at the cutoff, over all requests."""
    end = F.least("finish", F.lit(cutoff).cast("timestamp_ntz"))
    sums = spans.groupBy("request").agg(F.sum(F.coalesce(milliseconds(F.col("start"), end), F.lit(0.0))).alias("ms"))
    return requests.join(sums, "request", "left").agg(F.avg(F.coalesce("ms", F.lit(0.0))).alias("mean_ms"))


def changed_counts(stored: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the right counts of those rows whose stored one differs; nulls are equal to nulls."""
    joined = stored.select(key, F.col(value).alias("old")).join(actual.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))
    return joined.filter(~F.col("old").eqNullSafe(F.col(value))).select(key, value)
