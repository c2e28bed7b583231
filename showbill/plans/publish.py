"""From validated listings to published events and showings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.functions.text import replace_banned
from showbill.operators import grouping, joins
from showbill.values import GROUP_BY_TITLE


def group_listings(listing: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(events, showings): films merge by title, every other listing is its own event.

    A film takes the fields of its first listing and the showings of all. Any other event
    is known by title, dates and times; the last such listing gives fields and showings.
    """
    by_title = F.col("type").isin(list(GROUP_BY_TITLE))
    keyed = listing.where(F.size("dates") > 0).withColumn("group_key", F.when(by_title, F.col("title")).otherwise(
        grouping.unique_key(F.col("title"), F.col("dates"), F.col("times"))))
    wanted = ["ord", *fields]
    # One pass gives first and last rows; the last listing of an event brings its showings along. A row goes
    # into one of the results only, and these lie by key alone, as the showings do that meet them.
    of_event = ("dates", "times", "type", "venue", "url")
    row = F.struct(*dict.fromkeys([*wanted, *of_event]))
    film, other = F.coalesce(by_title, F.lit(False)), F.coalesce(~by_title, F.lit(False))
    results = {"film": (film, F.min_by), "other": (other, F.max_by), "untyped": (by_title.isNull(), F.max_by)}
    found = keyed.groupBy("group_key").agg(*[c for name, (holds, take) in results.items() for c in (
        F.bool_or(holds).alias(f"_is_{name}"), take(row, F.when(holds, F.col("ord"))).alias(name))])
    kept = found.select("group_key", F.inline(F.array_compact(F.array(*[
        F.when(F.col(f"_is_{name}"), F.struct(F.lit(name).alias("_kind"), F.col(name).alias("_row"))) for name in results]))))
    events = kept.select("group_key", *[F.col(f"_row.{f}").alias(f) for f in wanted])
    others = kept.where("_kind = 'other'").select("group_key", *[F.col(f"_row.{f}").alias(f) for f in ("ord", *of_event)])
    listed = keyed.where(by_title).select("group_key", "ord", *of_event).unionByName(others)
    return events, grouping.zip_dates_times(listed).select("group_key", "ord", "type", "date", "time", "venue", "url")


def published(listing: DataFrame, code_map: DataFrame, venue: DataFrame, fields: Sequence[str],
              text_fields: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(published events, their showings) with venue data and plain wording."""
    events, shows = group_listings(listing, fields)
    done = grouping.finalize(events, shows, "group_key")
    done = joins.attach_venue(done, code_map, venue)
    return done.withColumns({f: replace_banned(F.col(f)) for f in text_fields}), shows
