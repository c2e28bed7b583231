"""Streams fed in several batches against one batch over everything."""

import datetime as dt
import random

from pyspark.sql import functions as F

from showbill.streaming import jobs as ST
from showbill.streaming import state as KS

SIGNAL = "user_id int, k int, thumb int, saved boolean, ts timestamp, ord int"


def signals(n, seed):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        kind = rnd.choice([1, 1, -1, 0])
        out.append((rnd.randrange(3), rnd.randrange(2), kind or None, kind == 0, start + dt.timedelta(minutes=i), i))
    return out


def toggled(rows):
    state = {}
    for user, k, thumb, saved, *_ in rows:
        t, s = state.get((user, k), (0, False))
        if thumb:
            t = 0 if t == thumb else thumb
        state[user, k] = (t, s != saved)
    return state


def test_taste_over_batches(spark, tmp_path):
    rows = signals(400, 1)
    source = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], SIGNAL).coalesce(1).write.parquet(f"{source}/part={i}")
    stream = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    log = spark.read.parquet(ST.stream_taste(stream, str(tmp_path / "work")))
    assert log.select("batch").distinct().count() == 4
    want = toggled(rows)
    for table in (log, ST.compact_taste(log)):
        assert {(r["user_id"], r["k"]): (r["thumb"], r["saved"]) for r in ST.taste_state(table).collect()} == want


def test_new_showings_over_batches(spark, tmp_path):
    schema = "showing_key string, ord int, date string"
    source = str(tmp_path / "in")
    parts = [[("a", 1, "2024-01-01"), ("b", 2, "2024-01-02"), ("a", 3, "2024-01-01")], [("b", 4, "2024-01-02"), ("c", 5, "2024-01-03"), ("known", 6, "2024-01-03")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    known = spark.createDataFrame([("known",)], "showing_key string")
    out = spark.read.parquet(ST.new_showings(stream, known, str(tmp_path / "work")))
    assert sorted((r["showing_key"], r["ord"]) for r in out.collect()) == [("a", 1), ("b", 2), ("c", 5)]


def test_digest_is_sent_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, subjects in enumerate([["w1", "w2", "w1"], ["w2", "w3", "old"]]):
        spark.createDataFrame([(s,) for s in subjects], "subject string").coalesce(1).write.parquet(f"{source}/part={i}")
    stream = spark.readStream.schema("subject string").option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    out = spark.read.parquet(ST.digest_once(stream, spark.createDataFrame([("old",)], "subject string"), str(tmp_path / "work")))
    assert sorted(r["subject"] for r in out.collect()) == ["w1", "w2", "w3"]


def test_late_rows_are_dropped_and_repeats_removed(spark, tmp_path):
    source = str(tmp_path / "in")
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    parts = [[(day(1), "e", 1)], [(day(3), "e", 1)], [(day(4), "e", 1)], [(day(1, 5), "e", 1), (day(5), "e", 1)], [(day(8), "e", 1)]]
    schema = "at timestamp, event_type string, weight int"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part={i}")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")

    days = spark.read.parquet(ST.to_table(ST.signal_windows(stream(), "at", "1 day"), str(tmp_path / "a")))
    # The row of day 1 that comes after day 4 is late by then.
    assert sorted((str(r["start"])[:10], r["signals"]) for r in days.collect()) == [(f"2024-01-0{d}", 1) for d in (1, 3, 4, 5)]
    distinct = ST.distinct_recent(stream(), ["event_type"], "at", "100 days")
    assert spark.read.parquet(ST.to_table(distinct, str(tmp_path / "b"))).count() == 1


def test_quiet_source_alarm(spark, tmp_path):
    source = str(tmp_path / "in")
    at = lambda d: dt.datetime(2024, 1, d)
    for i, rows in enumerate([[("a", at(1)), ("b", at(1)), ("b", at(2))], [("b", at(3)), ("b", at(4))], [("b", at(5)), ("a", at(5))]]):
        spark.createDataFrame(rows, "s string, at timestamp").coalesce(1).write.parquet(f"{source}/part={i}")
    stream = spark.readStream.schema("s string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    out = spark.read.parquet(ST.to_table(ST.quiet_sources(stream, "s", "at"), str(tmp_path / "work")))
    assert [(r["s"], str(r["last_seen"])[:10]) for r in out.select("s", F.col("last_seen")).collect()] == [("a", "2024-01-01")]


def test_keyed_taste_over_fifty_batches(spark, tmp_path):
    from showbill.streaming import state

    rows = signals(500, 2)
    source = str(tmp_path / "in")
    for i in range(50):
        spark.createDataFrame(rows[i * 10:(i + 1) * 10], SIGNAL).coalesce(1).write.parquet(f"{source}/part={i:02d}")
    stream = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    sizes = []
    for _ in range(2):  # the second run starts from the first one's state and finds nothing new
        ST.run_now(state.stream_keyed_taste(stream).writeStream.format("noop").outputMode("update"), str(tmp_path / "work"))
        now = state.taste_now(spark, str(tmp_path / "work/progress")).collect()
        assert {(r["user_id"], r["k"]): (r["thumb"], r["saved"]) for r in now} == toggled(rows)
        sizes.append(len(now))
    assert sizes == [6, 6]


def test_alarm_when_all_sources_fall_silent(spark, tmp_path):
    import time

    from showbill.streaming import state

    source, schema = str(tmp_path / "in"), "s string, at timestamp"
    now = dt.datetime.now()
    spark.createDataFrame([("a", now), ("a", now), ("b", now + dt.timedelta(hours=1)), (None, now)], schema).coalesce(1).write.parquet(f"{source}/part=0")
    registry = spark.createDataFrame([("a", now), ("never", now), ("new", now + dt.timedelta(hours=1))], "s string, since timestamp")
    out = str(tmp_path / "out")

    def watch(until):
        stream = spark.readStream.schema(schema).parquet(f"{source}/part=*")
        query = state.silent_sources(stream, registry, "s", "at", limit_seconds=2).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="1 second").start()
        end = time.time() + 90
        while time.time() < end:
            if query.exception():
                raise query.exception()
            try:
                got = sorted((r["s"], r["last_seen"] is None, r["rows"]) for r in spark.read.parquet(out).collect())
            except Exception:  # nothing is written yet
                got = []
            if len(got) >= until:
                break
            time.sleep(1)
        query.stop()
        return got

    # one has stopped, one has never sent; the others are still within their time
    assert watch(2) == [("a", False, 2), ("never", True, 0)]
    # after a restart the state is known: a new row arms the timer again
    spark.createDataFrame([("a", dt.datetime.now())], schema).coalesce(1).write.parquet(f"{source}/part=1")
    assert watch(3) == [("a", False, 2), ("a", False, 3), ("never", True, 0)]


def test_keyed_taste_counts_by_time_then_number_and_takes_nulls_last(spark, tmp_path):
    rows = [(1, 1, 1, False, "2024-01-02", 1), (1, 1, -1, False, "2024-01-01", 9), (1, 1, 1, False, "2024-01-02", 2), (2, 1, 1, False, None, 1),
            (2, 1, -1, False, "2024-01-01", 2), (3, 1, None, True, "2024-01-01", 1), (3, 1, None, None, "2024-01-01", None), (None, 1, 1, False, "2024-01-01", 1)]
    spark.createDataFrame(rows, "user_id long, k long, thumb int, saved boolean, ts string, ord long").withColumn(
        "ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    out = KS.stream_keyed_taste(stream)
    # groups go through as rows, not as a frame each
    assert "InPandas" not in out._jdf.queryExecution().logical().toString()
    ST.run_now(out.writeStream.format("noop").outputMode("update"), str(tmp_path / "work"))
    got = {(r.user_id, r.k): (r.thumb, r.saved) for r in KS.taste_now(spark, str(tmp_path / "work/progress")).collect()}
    assert got == {(1, 1): (0, False), (2, 1): (1, False), (3, 1): (0, True)}
