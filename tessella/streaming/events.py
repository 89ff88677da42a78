"""Event logs: cursors, decoding, states of tasks, and the same windows in batch and in streams."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import materialise

#: Seconds before each further attempt; a task that failed once more than these is given up.
RETRY_AFTER = (5, 30)


def after_cursor(events: DataFrame, seq: str, cursor: str, limit: int) -> DataFrame:
    """Events after an exclusive cursor ``major-minor``, whose parts compare as numbers."""
    major, minor = (int(x) for x in cursor.split("-"))
    at = F.struct(*(F.split_part(seq, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2)))
    return events.filter(at > F.struct(F.lit(major), F.lit(minor))).orderBy(at).limit(limit)


def decoded(payload: Column, schema: str) -> Column:
    """A JSON payload; one that cannot be read is kept as text in ``raw``."""
    return F.from_json(payload, f"{schema}, raw string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "raw"})


def claimable(tasks: DataFrame, now: Column) -> DataFrame:
    """Pending tasks that are due and running ones whose lease is over, oldest first, with the attempt that begins."""
    due = ((F.col("status") == "pending") & (F.coalesce("due_at", now) <= now)) | ((F.col("status") == "running") & (F.col("lease_until") < now))
    return tasks.filter(due).withColumn("attempt", F.col("attempt") + 1).orderBy("created_at", "id")


def after_failure(attempt: Column) -> tuple[Column, Column]:
    """(status, seconds to wait) after an attempt failed."""
    status = F.when(attempt > len(RETRY_AFTER), "failed").otherwise("pending")
    wait = F.when(attempt == 1, RETRY_AFTER[0]).when(attempt == 2, RETRY_AFTER[1])
    return status, wait


def changed_if(df: DataFrame, column: str, allowed: list[str], value: Column) -> DataFrame:
    """A conditional update: rows in an allowed state get the new one; ``changed`` tells which."""
    ok = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.withColumn("changed", ok).withColumn(column, F.when(F.col("changed"), value).otherwise(F.col(column)))


def cancelled_tree(runs: DataFrame, root, ended: list[str]) -> DataFrame:
    """(id): the runs below a run (id, parent, status), itself included, that have not ended; the search goes on below ended ones."""
    level = found = materialise(runs.filter(F.col("id") == root).select("id"), "cancel")
    while True:
        level = materialise(runs.join(level.select(F.col("id").alias("parent")), "parent").select("id").join(found, "id", "left_anti").distinct(), "cancel")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return runs.join(found, "id", "left_semi").filter(~F.col("status").isin(ended)).select("id")


@lru_cache(4096)
def _cron(expression: str) -> tuple[list[int], list[int], set[int], set[int], set[int], bool]:
    """Minutes and hours in order, days, months and weekdays (0: Sunday) of a five-field expression; and whether either kind of
    day is enough, as it is if both are restricted."""
    fields = expression.split()
    bounds = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
    if len(fields) != 5:
        raise ValueError(f"{expression!r} has not five fields")
    found = []
    for part, (low, high) in zip(fields, bounds, strict=True):
        values: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if a == "*" else (int(a), int(b) if b else (high if step else int(a)))
            if not low <= first <= last <= high or (step and int(step) < 1):
                raise ValueError(f"{item!r} is not between {low} and {high}")
            values |= set(range(first, last + 1, int(step or 1)))
        found.append(values)
    minutes, hours, days, months, weekdays = found
    either = not fields[2].startswith("*") and not fields[4].startswith("*")
    return sorted(minutes), sorted(hours), days, months, {d % 7 for d in weekdays}, either


def cron_next(expression: str, zone: str, after: datetime, years: int = 8) -> datetime | None:
    """The first time after ``after`` (naive UTC) that a five-field cron expression names in a zone, as naive UTC; None if there
    is none within ``years``. If both kinds of days are restricted, either is enough.

    Days that do not fit are passed over whole, and in one that fits the first fitting hour and minute are looked up. Local
    times that a change of the clock leaves out are passed over, and those that come twice count twice."""
    minutes, hours, days, months, weekdays, either = _cron(expression)
    place = ZoneInfo(zone)
    start = after.replace(tzinfo=timezone.utc)
    day = start.astimezone(place).date()
    last = day.replace(year=day.year + years, day=min(day.day, 28))
    while day <= last:
        if day.month not in months:
            day = date(day.year + day.month // 12, day.month % 12 + 1, 1)
            continue
        by_day, by_week = day.day in days, day.isoweekday() % 7 in weekdays
        if by_day or by_week if either else by_day and by_week:
            found = None
            for fold in (0, 1):
                # times of one fold rise within a day; the first of each is after all that a change leaves out
                for h in hours:
                    first, final = (datetime.combine(day, time(h, m), place).replace(fold=fold).astimezone(timezone.utc) for m in (minutes[0], minutes[-1]))
                    if final <= start and first <= final:
                        continue
                    hit = None
                    for m in minutes:
                        local = datetime.combine(day, time(h, m), place).replace(fold=fold)
                        at = local.astimezone(timezone.utc)
                        back = at.astimezone(place)
                        if at > start and (back.hour, back.minute, back.day) == (h, m, day.day):
                            hit = at
                            break
                    if hit is not None:
                        found = hit if found is None else min(found, hit)
                        break
            if found is not None:
                return found.replace(tzinfo=None)
        day += timedelta(days=1)
    return None


def with_next_run(schedules: DataFrame, expression: str, zone: str, after: str, out: str = "next_run") -> DataFrame:
    """``schedules`` with the next time of each row's expression in its zone after a time (naive UTC); null where one of them is null
    or no time fits. An expression that is none, or an unknown zone, is an error."""

    @F.pandas_udf("timestamp_ntz")
    def next_of(e, z, t):
        import pandas as pd

        rows = zip(e, z, t, strict=True)
        found = [None if a is None or b is None or pd.isna(c) else cron_next(a, b, c.to_pydatetime()) for a, b, c in rows]
        return pd.Series(found, dtype="datetime64[ns]")

    return schedules.withColumn(out, next_of(F.col(expression), F.col(zone), F.col(after)))


def windowed(events: DataFrame, ts: Column, minutes: int = 60) -> DataFrame:
    """(start, event_type, n, value) of tumbling windows; the same expression serves batches and streams."""
    w = F.window(ts, f"{minutes} minutes")
    sums = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def stream_of(spark: SparkSession, path: str, schema, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``path`` as a stream, whether it is one file or a folder of files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if found.getFileStatus(place).isDirectory():
        return reader.parquet(f"{path}/{name}")
    return reader.option("pathGlobFilter", name).parquet(path)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What is there now goes through the stream and to Parquet; a next call with the same checkpoint goes on after it."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def appended(spark: SparkSession, log: str, run_id: str, kinds_and_payloads: DataFrame, now: Column, first_seq: int, keep_seconds: int = 7200) -> None:
    """Append events (kind, payload, n: their order) of a run to a log of Parquet files, in an envelope of version 1 with a
    sequence ``milliseconds-n`` and the time after which retention may drop it. Readers see whole batches only."""
    at = F.unix_millis(now.cast("timestamp"))
    envelope = F.struct(F.lit(1).alias("v"), F.lit(run_id).alias("run_id"), F.col("kind"), F.col("payload"))
    rows = kinds_and_payloads.select(
        F.lit(run_id).alias("run_id"), F.concat_ws("-", at, F.col("n") + first_seq).alias("seq"), F.to_json(envelope).alias("envelope"), (at + 1000 * keep_seconds).alias("drop_after")
    )
    rows.write.mode("append").parquet(log)


def retained(events: DataFrame, now_millis: int, most: int | None = None) -> DataFrame:
    """The events that a log keeps: those not past their time and, with ``most``, the latest so many of each run."""
    alive = events.filter(F.col("drop_after") > now_millis)
    if most is None:
        return alive
    order = Window.partitionBy("run_id").orderBy(*(F.split_part("seq", F.lit("-"), F.lit(i)).cast("long").desc() for i in (1, 2)))
    return alive.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")
