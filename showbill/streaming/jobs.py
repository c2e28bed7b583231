"""Streams: new showings, taste, quiet sources, signal windows, send-once digests.

Every writer is restartable: a micro-batch writes its own folder, named after its number,
and a repeated batch overwrites that folder with the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.operators.grouping import keep_first
from showbill.operators.ranking import collapse_signals
from showbill.operators.scale import ensure_checkpoint_dir
from showbill.streaming.state import use_rocks_db


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def run_now(writer, folder: str) -> None:
    """Process all that is available and stop."""
    query = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def to_table(stream: DataFrame, folder: str) -> str:
    """Append a stream to a Parquet table until all that is available is processed."""
    run_now(stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out"), folder)
    return f"{folder}/out"


def _stored(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Rows that earlier batches have written; batch 0 always writes, so a missing table is an error."""
    return None if before == 0 else spark.read.parquet(path).where(F.col("batch") < before)


def each_batch(stream: DataFrame, folder: str, fn: Callable[[DataFrame, DataFrame | None], DataFrame]) -> str:
    """Write ``fn(batch, rows of earlier batches)`` of every batch; returns the table's path."""
    path = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        earlier = _stored(batch.sparkSession, path, number)
        fn(batch, earlier).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_now(stream.writeStream.foreachBatch(write), folder)
    return path


# --- new showings ---------------------------------------------------------------------------

def new_showings(stream: DataFrame, known: DataFrame, folder: str) -> str:
    """Showings whose key is not known and has not come before.

    Within a batch the first row by ``ord`` counts. The keys of earlier batches are read
    back for the days of this batch only.
    """
    def fresh(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        first = keep_first(batch.withColumn("_at", F.col("ord")), ["showing_key"], "_at").drop("_at")
        out = first.join(known.select("showing_key"), "showing_key", "left_anti")
        if earlier is not None:
            days = batch.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
            seen = earlier.where(F.col("date").between(F.lit(days["a"]), F.lit(days["b"])))
            out = out.join(seen.select("showing_key"), "showing_key", "left_anti")
        return out

    return each_batch(stream, folder, fresh)


def distinct_recent(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """A stream without repeats that arrive within ``delay`` of each other; bounded state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


# --- taste ----------------------------------------------------------------------------------

def taste_state(log: DataFrame) -> DataFrame:
    """Thumb and save of every (reader, event) after all logged batches.

    The log has one row per pair and batch, so the ordered fold is as long as the number
    of batches since the last compaction.
    """
    step = F.struct("batch", "value", "run", "turned", "toggles_save")
    steps = log.groupBy("user_id", "k").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def thumb(state: Column, s: Column) -> Column:
        odd = s["run"] % 2 == 1
        kept = F.when(~s["turned"] & (state == s["value"]), ~odd).otherwise(odd)
        return F.when(s["value"] == 0, state).when(kept, s["value"]).otherwise(0)

    def saved(state: Column, s: Column) -> Column:
        return F.when(s["toggles_save"], ~state).otherwise(state)

    return steps.select(
        "user_id", "k", F.aggregate("steps", F.lit(0), thumb).alias("thumb"),
        F.aggregate("steps", F.lit(False), saved).alias("saved"))


def stream_taste(signal_stream: DataFrame, folder: str) -> str:
    """Append the collapsed signals of every batch to the taste log."""
    return each_batch(signal_stream, folder, lambda batch, _: collapse_signals(batch))


def compact_taste(log: DataFrame) -> DataFrame:
    """The log as one batch with the same state, to keep the fold short."""
    state = taste_state(log)
    return state.select(
        "user_id", "k", F.col("thumb").alias("value"), F.lit(1).cast("bigint").alias("run"), F.lit(True).alias("turned"),
        F.col("saved").alias("toggles_save"), F.lit(0).alias("batch"))


def taste_bias(log: DataFrame, event: DataFrame, by: str, modulo: int = 100) -> DataFrame:
    """Sum of all readers' weights per category or venue."""
    weights = taste_state(log).groupBy("k").agg(F.sum(F.col("thumb") + F.col("saved").cast("int")).alias("weight"))
    return event.join(weights, F.col("event_key") % modulo == F.col("k")).groupBy(by).agg(F.sum("weight").alias("bias"))


# --- quiet sources ----------------------------------------------------------------------------

def quiet_sources(stream: DataFrame, source: str, at: str, limit: str = "48 hours", delay: str = "1 hour") -> DataFrame:
    """An alarm for every source that has had no row for ``limit``.

    A session window closes once nothing has come for its gap, which is the alarm itself.
    Spark merges the rows of a source inside each task first, so a source with very many
    rows sends few to the shuffle (``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``).
    """
    sessions = stream.withWatermark(at, delay).groupBy(F.col(source), F.session_window(at, limit).alias("w")).agg(
        F.count("*").alias("rows"))
    return sessions.select(
        source, (F.col("w.end") - F.expr(f"INTERVAL {limit}")).alias("last_seen"), F.col("w.end").alias("alarm_at"), "rows")


# --- signal windows ---------------------------------------------------------------------------

def signal_windows(stream: DataFrame, at: str, length: str, slide: str | None = None, delay: str = "1 hour",
                   by: str = "event_type") -> DataFrame:
    """Signals per window and type; rows later than the watermark are dropped."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("signals"), F.sum("weight").alias("weight")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "signals", "weight")


def signal_sessions(stream: DataFrame, at: str, gap: str, by: str, delay: str = "1 hour") -> DataFrame:
    """Signals per session of a reader."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("signals")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "signals")


# --- send once --------------------------------------------------------------------------------

def digest_once(stream: DataFrame, sent: DataFrame, folder: str, subject: str = "subject") -> str:
    """Digests that have not been sent, neither before the stream nor by an earlier batch.

    The subjects of the stream are keyed state in the state store, one small entry each, so
    no batch reads what earlier ones have written; ``sent`` is the table as it was before the stream.
    """
    use_rocks_db(stream.sparkSession)
    return to_table(stream.dropDuplicates([subject]).join(sent.select(subject).distinct(), subject, "left_anti"), folder)
