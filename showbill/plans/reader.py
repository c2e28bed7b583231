"""The reader's page as one plan: filter, group by title, rate, split, rank."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.functions.dates import day
from showbill.operators import filters, ranking, rollups


def reader_groups(event: DataFrame, screening: DataFrame, today, query: str = "", saved: DataFrame | None = None,
                  category: str | None = None, view: str | None = None) -> DataFrame:
    """Filtered events merged by title, with first showing and derived rating.

    Only scored categories get a derived rating: the venue's average, else 5.
    """
    kept = filters.filter_events(event, screening, today, query, saved, category, view)
    groups, shows = rollups.reader_groups(kept, screening)
    first = shows.groupBy("group_title").agg(
        F.min(F.struct("date", "time")).alias("first"), F.count("*").alias("n_showings"))
    rows = groups.join(first, "group_title", "left").select(
        "*", F.coalesce("first.date", F.lit("")).alias("first_date"), F.coalesce("first.time", F.lit("")).alias("first_time")).drop("first")
    rated = rollups.derived_rating(rows)
    return rated.withColumn("derived_rating", F.when(F.col("type") == "movie", F.col("derived_rating"))).drop("venue_average")


def split_view(groups: DataFrame, today, first_showing_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(listings still to come, research list).

    By default a title counts as past once its first showing is, even when later ones
    remain; with ``first_showing_only=False`` groups need a ``last_date`` column.
    """
    listed, research = filters.split_confidence(groups)
    last = F.col("first_date") if first_showing_only else F.col("last_date")
    return listed.where(last >= str(day(today))), research


def reader_picks(listings: DataFrame, weighted: DataFrame, today, k: int = 10) -> DataFrame:
    """The coming seven days by rating and taste."""
    until = str(day(today) + timedelta(days=7))
    return ranking.rerank_by_taste(listings.where(F.col("first_date") < until), weighted, k)


def reader_sections(listings: DataFrame, today) -> DataFrame:
    """The listings by section, in reading order."""
    rows = ranking.category_sections(listings)
    scored = F.col("type") == "movie"
    return rows.withColumn("urgency", ranking.urgency_date(F.col("end_date"), F.col("first_date"), today)).orderBy(
        "section", F.when(scored, F.coalesce("rating", F.lit(0))).desc(), F.when(~scored, F.col("urgency")), "title")
