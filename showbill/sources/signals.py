"""Reader signals as rows of thumbs and saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.sources.tables import table

SIGNAL_TYPES = {"click": "thumb up", "error": "thumb down", "purchase": "save"}


def as_signals(events: DataFrame) -> DataFrame:
    """Event stream rows to signals: click is a thumb up, error a thumb down, purchase a save."""
    kind = F.col("event_type")
    return events.where(kind.isin(list(SIGNAL_TYPES))).select(
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        F.when(kind == "click", 1).when(kind == "error", -1).alias("thumb"),
        (kind == "purchase").alias("saved"),
        "user_id", "ts", F.col("event_id").alias("ord"),
    )


def taste_signals(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    if before is not None:
        rows = rows.where(F.col("ts") < F.lit(before).cast(rows.schema["ts"].dataType))
    return as_signals(rows)
