"""Season refresh: normalize, validate, compare with what is stored, write only if nothing is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.operators import joins, normalize, quality
from showbill.operators.scale import written
from showbill.sources import sinks

#: Types a season file may hold.
SEASON_TYPES = ("concert", "opera", "dance")


def check_refresh(stored: DataFrame, incoming: DataFrame, expected_type: str, expected_venue: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows to store, problems). Problems are rejects, invalid fields and losses."""
    # every check reads the same rows, which are judged once
    rows = written(normalize.season_row(incoming, expected_type, expected_venue), "season-rows")
    kept = rows.where(F.col("reject").isNull()).drop("reject")
    rejects = rows.where(F.col("reject").isNotNull()).select(
        F.col("venue_name").alias("venue"), "title", F.concat(F.lit("rejected: "), "reject").alias("problem"))
    named = kept.withColumn("venue", F.col("venue_name"))
    invalid = quality.validate(named, labels=SEASON_TYPES, free_times=True).join(named.select("ord", "venue", "title"), "ord").select(
        "venue", "title", F.concat(F.lit("invalid: "), "message").alias("problem"))
    lost = joins.refresh_regressions(stored, named)
    return named, rejects.unionByName(invalid).unionByName(lost)


def commit_refresh(rows: DataFrame, problems: DataFrame, root: str, snapshot: str, tolerate: tuple[str, ...] = ("rejected",)) -> bool:
    """Publish a snapshot unless a problem outside the tolerated kinds stands against it."""
    blocking = problems.where(~F.col("problem").rlike("^(?:" + "|".join(tolerate) + "):")) if tolerate else problems
    if not blocking.isEmpty():
        return False
    sinks.publish(rows, root, snapshot)
    return True
