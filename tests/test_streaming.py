"""Stateful streams against the fold over a table, with restarts."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.streaming import events as E
from tessella.streaming import stateful as T

SCHEMA = "id long, seq long, kind string, at timestamp"
START = datetime(2024, 1, 1)


def made_events(n, seed):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        rows.append((r.randrange(12), seq, r.choice(["submit", "claim", "claim", "beat", "error", "done", "other"]), START + timedelta(minutes=40 * seq)))
    return rows


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def states(df):
    return {r["id"]: (r["status"], r["attempt"]) for r in df.collect() if r["status"] != "none"}


def test_replayed_files_and_restarts_give_the_answer_of_the_table(spark, tmp_path):
    rows = made_events(600, 1)
    whole = spark.createDataFrame(rows, SCHEMA)
    now = int((rows[-1][3] - timedelta(minutes=10) - datetime(1970, 1, 1)).total_seconds() * 1000)
    want = states(T.task_states(whole, now))
    assert {s for s, _ in want.values()} >= {"pending", "running"} and len(want) == 12
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    add_file(spark, one, rows)

    def run(folder, name):
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        return E.run_once(T.task_transitions(stream), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint"))

    assert states(T.latest_states(run(one, "one"))) == want
    for lo in (0, 150, 151, 400):  # each call goes on from the checkpoint of the one before
        add_file(spark, many, rows[lo : {0: 150, 150: 151, 151: 400, 400: 600}[lo]])
        found = run(many, "many")
    assert states(T.latest_states(found)) == want
    assert found.groupBy("id", "n").count().filter("count > 1").count() == 0  # no transition twice


def test_a_lease_ends_by_its_timer_alone(spark, tmp_path):
    folder, at = str(tmp_path / "in"), START
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(folder)
    run = lambda: E.run_once(T.task_transitions(stream()), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    add_file(spark, folder, [(1, 1, "submit", at), (1, 2, "claim", at + timedelta(minutes=1))])
    assert states(T.latest_states(run())) == {1: ("running", 1)}
    add_file(spark, folder, [(2, 3, "submit", at + timedelta(days=3))])  # another task moves the watermark
    assert states(T.latest_states(run())) == {1: ("pending", 1), 2: ("pending", 0)}


def test_rules_of_the_fold():
    lease = 1000 * T.LEASE_SECONDS
    state = T.after_event(T._NEW, "submit", 0)
    assert T.after_event(state, "done", 1) == state and T.after_event(state, "submit", 1) == state
    for attempt, wait in ((1, 5000), (2, 30_000)):
        state = T.after_event(state, "claim", state[2])
        assert state[:2] == ("running", attempt) and T.expired(state, state[3]) == state
        state = T.expired(state, state[3] + 1)
        assert state[:2] == ("pending", attempt) and T.after_event(state, "claim", state[2] - 1) == state
        assert state[2] % lease % 60_000 in {wait, 35_000}
    state = T.after_event(T.after_event(state, "claim", state[2]), "error", state[2] + 1)
    assert state[:2] == ("failed", 3) and T.after_event(state, "submit", 9)[:2] == ("pending", 0)


def test_a_log_is_followed_once_from_its_cursor(spark, tmp_path):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    payloads = lambda lo, hi: spark.createDataFrame([("k", str(i), i) for i in range(lo, hi)], "kind string, payload string, n long")
    second = lambda s: F.lit(f"2024-01-01 00:00:0{s}").cast("timestamp")
    E.appended(spark, log, "r", payloads(0, 4), second(0), 0)
    first = 1704067200000
    assert sorted(r["seq"] for r in T.follow(spark, log, f"{first}-1", out, check).collect()) == [f"{first}-2", f"{first}-3"]
    assert T.follow(spark, log, f"{first}-1", out, check).count() == 2  # nothing new, nothing twice
    E.appended(spark, log, "r", payloads(0, 2), second(1), 0)
    assert sorted(r["seq"] for r in T.follow(spark, log, f"{first}-1", out, check).collect()) == [f"{first}-2", f"{first}-3", f"{first + 1000}-0", f"{first + 1000}-1"]


def test_stages_killed_between_each_other_end_with_the_same_tables(spark, tmp_path):
    folder = str(tmp_path / "in")
    add_file(spark, folder, made_events(40, 2))
    add_file(spark, folder, made_events(30, 3))
    fails = str(tmp_path / "fails")

    def first(df):
        return df.groupBy("id", "kind").agg(F.count("*").alias("n"))

    def second(df):
        if os.path.exists(fails):
            raise RuntimeError("killed")
        return df.filter("n > 1").select("id", "n")

    def run(name):
        T.run_stages(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), [("counted", first), ("kept", second)], str(tmp_path / name), str(tmp_path / f"{name}-check"))
        return [sorted(map(tuple, spark.read.parquet(str(tmp_path / name / x)).collect())) for x in ("counted", "kept")]

    want = run("plain")
    open(fails, "w").close()
    with pytest.raises(Exception, match="killed"):
        run("broken")
    os.remove(fails)
    assert run("broken") == want and run("broken") == want


def test_a_stream_reads_a_table_that_is_a_folder_as_one_that_is_a_file(spark, tmp_path):
    rows = made_events(40, 4)
    add_file(spark, str(tmp_path / "events.parquet"), rows[:25])
    add_file(spark, str(tmp_path / "events.parquet"), rows[25:])
    add_file(spark, str(tmp_path / "other.parquet"), rows[:3])
    os.mkdir(tmp_path / "file")
    part = next(x for x in os.listdir(tmp_path / "events.parquet") if x.endswith(".parquet"))
    os.link(tmp_path / "events.parquet" / part, tmp_path / "file" / "events.parquet")

    def read(path, name):
        schema = spark.createDataFrame([], SCHEMA).schema
        return E.run_once(E.stream_of(spark, path, schema, "events.parquet"), str(tmp_path / name), str(tmp_path / f"{name}-check")).count()

    assert read(str(tmp_path), "all") == 40
    assert read(str(tmp_path / "file"), "one") in (15, 25)
