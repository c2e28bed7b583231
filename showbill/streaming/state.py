"""Streams with keyed state: silence alarms from a registry and taste per reader and event.

State lives in RocksDB under the query's checkpoint, so it survives a restart and its size
follows the number of keys, not of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks_db(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


def run_one_batch(writer, folder: str) -> None:
    """Process all there is as one batch and stop; a stream with clock timers has no other end."""
    writer.option("checkpointLocation", f"{folder}/progress").trigger(once=True).start().awaitTermination()


# --- silence --------------------------------------------------------------------------------

class Silence(StatefulProcessor):
    """Latest row and number of rows of a source, with a timer at the latest sign of life plus the limit.

    A source sounds one alarm for each silence; its next row arms the timer again.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "seen long, rows long, alive long")

    def _arm(self, alive: int) -> None:
        self.handle.registerTimer(alive // 1000 + self.limit_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((None, 0, initialState.since))
        self._arm(initialState.since)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        seen, n, alive = held or (None, 0, None)
        for row in rows:
            seen, n = row.seen if seen is None else max(seen, row.seen), n + row.rows
        now = seen if alive is None else max(alive, seen)
        self.state.update((seen, n, now))
        if held and alive // 1000 != now // 1000:  # the timer before, if it has not gone off
            self.handle.deleteTimer(alive // 1000 + self.limit_ms)
        self._arm(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen, n, alive = self.state.get()
        yield Row(source=key[0], seen=seen, alarm=alive + 1000 * self.limit_ms, rows=n)

    def close(self) -> None:
        pass


def _latest(batches):
    """One row per source and task: its latest row and the number of its rows."""
    import pyarrow as pa

    held: dict = {}
    schema = pa.schema([("source", pa.string()), ("seen", pa.int64()), ("rows", pa.int64())])
    for batch in batches:
        for source, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen, n = held.get(source, (at, 0))
            held[source] = (max(seen, at), n + 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array([s for s, _ in held.values()], pa.int64()), pa.array([n for _, n in held.values()], pa.int64())], schema=schema)


def silent_sources(stream: DataFrame, registry: DataFrame, source: str, at: str, limit_seconds: int = 48 * 3600) -> DataFrame:
    """An alarm for every source that has had no row for the limit, by the clock of the cluster.

    Timers run on processing time, so alarms come while no source sends anything, and for
    sources of the ``registry`` (source, since) that have never sent. Out come source,
    last_seen (null if it never sent), alarm_at and the number of rows so far. Rows without
    source or time are no sign of life. Each task hands on one row per source, so that a
    source with very many rows sends few. The many small groups go through as rows, and a
    source's timer is known from its state.
    """
    use_rocks_db(stream.sparkSession)
    alive = stream.select(F.col(source).cast("string").alias("source"), F.unix_micros(F.col(at).cast("timestamp")).alias("seen")).where(
        "source is not null and seen is not null").mapInArrow(_latest, "source string, seen long, rows long")
    known = registry.select(F.col(source).cast("string").alias("source"), F.unix_micros(F.col("since").cast("timestamp")).alias("since")).where(
        "source is not null and since is not null").groupBy("source").agg(F.max("since").alias("since"))
    alarms = alive.groupBy("source").transformWithState(
        statefulProcessor=Silence(limit_seconds * 1000), outputStructType="source string, seen long, alarm long, rows long",
        outputMode="Append", timeMode="ProcessingTime", initialState=known.groupBy("source"))
    return alarms.select(F.col("source").alias(source), F.timestamp_micros("seen").alias("last_seen"), F.timestamp_micros("alarm").alias("alarm_at"), "rows")


# --- taste ------------------------------------------------------------------------------------

class Taste(StatefulProcessor):
    """Thumb (-1, 0, 1) and save of one reader for one event: an equal thumb clears, another replaces, a save toggles."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("taste", "thumb int, saved boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        signals = sorted(rows, key=lambda r: (r.ts is None, r.ts, r.ord is None, r.ord))
        thumb, saved = self.state.get() or (0, False)
        for signal in signals:
            if signal.thumb is not None:
                thumb = 0 if thumb == signal.thumb else signal.thumb
            saved ^= signal.saved
        self.state.update((thumb, saved))
        yield Row(user_id=key[0], k=key[1], thumb=thumb, saved=saved)

    def close(self) -> None:
        pass


def stream_keyed_taste(signals: DataFrame) -> DataFrame:
    """The new thumb and save of every (reader, event) that a batch has signals for.

    Signals without reader or event are left out; within a batch they count by ts, then ord.
    The many small groups go through as rows, since a frame for each would cost more than its work.
    """
    use_rocks_db(signals.sparkSession)
    rows = signals.where("user_id is not null and k is not null").select(
        F.col("user_id").cast("long").alias("user_id"), F.col("k").cast("long").alias("k"), "thumb", F.coalesce("saved", F.lit(False)).alias("saved"), "ts", "ord")
    return rows.groupBy("user_id", "k").transformWithState(
        statefulProcessor=Taste(), outputStructType="user_id long, k long, thumb int, saved boolean", outputMode="Update", timeMode="None")


def taste_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a taste stream as a table: user_id, k, thumb, saved; read from the state store, not from a log."""
    use_rocks_db(spark)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "taste").load()
    return state.select("key.user_id", "key.k", "value.thumb", "value.saved")
