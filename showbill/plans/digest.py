"""The weekly digest: what is best this week, with its showings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from showbill.functions.dates import week_bounds
from showbill.operators import ranking
from showbill.sources import tables


def week_fields(spark: SparkSession, sf_dir: str, week: str) -> DataFrame:
    """Fields of the events that are shown in a week.

    The semi join on the week's keys comes before everything else, so only rows of those
    events are sorted and shuffled.
    """
    keys = ranking.in_range(tables.showings(spark, sf_dir), *week_bounds(week)).select("event_key").distinct()
    return tables.event(spark, sf_dir, keys=keys)


def weekly_digest(spark: SparkSession, sf_dir: str, week: str, limit: int = ranking.DIGEST_LIMIT) -> DataFrame:
    return ranking.digest(tables.showings(spark, sf_dir), week_fields(spark, sf_dir, week), week, limit)
