"""Season files, published lists and production feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from showbill.functions.dates import match
from showbill.functions.facts import nonblank

SEASON_EVENT = (
    "struct<title:string,program:string,dates:array<string>,times:array<string>,venue_name:string,"
    "series:string,featured_artist:string,composers:array<string>,works:array<string>,type:string>"
)

PUBLISHED_EVENT = (
    "id string, title string, type string, dates array<string>, times array<string>, venue string, "
    "venue_display_name string, venue_address string, url string, rating int, one_liner_summary string, "
    "description string, review_confidence string, end_date string, director string, author string, "
    "composers array<string>, screenings array<struct<date:string,time:string,url:string,venue:string>>"
)


def read_season(spark: SparkSession, path: str) -> DataFrame:
    """Season files as rows of ``payload``: venue key to list of events.

    A season file is one small JSON object; many files are read in parallel.
    """
    text = spark.read.text(path, wholetext=True)
    return text.select(
        F.map_filter(
            F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin("lastUpdated", "season")
        ).alias("raw"),
        F.get_json_object("value", "$.lastUpdated").alias("last_updated"),
        F.get_json_object("value", "$.season").alias("season"),
    ).withColumn("payload", F.transform_values("raw", lambda k, v: F.from_json(v, f"array<{SEASON_EVENT}>"))).drop("raw")


def season_events(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Listings of a season payload.

    ``registry`` has one row per venue key: venue, base_url, default_type, assumed_type,
    default_time, default_location, expand. An expanding venue gives one row per date, with
    its own time, else the first, else the default. The others give one row with both arrays,
    missing times filled with the default.
    """
    events = raw.select(*[c for c in raw.columns if c != "payload"], F.explode("payload").alias("venue_key", "events"))
    rows = events.select("*", F.explode("events").alias("e")).drop("events").join(registry, "venue_key")
    empty = F.array().cast("array<string>")
    dates, times = F.coalesce("e.dates", empty), F.coalesce("e.times", empty)
    single = F.transform(dates, lambda d, i: F.struct(
        F.array(d).alias("dates"),
        F.array(F.coalesce(F.get(times, i), F.get(times, F.lit(0)), F.col("default_time"))).alias("times"),
    ))
    filled = F.when(F.size(times) > 0, times).otherwise(F.array_repeat("default_time", F.size(dates)))
    whole = F.array(F.struct(dates.alias("dates"), filled.alias("times")))
    return rows.select(
        "*", F.explode(F.when(F.col("expand"), single).otherwise(whole)).alias("slot")
    ).select(
        *[c for c in raw.columns if c != "payload"], "venue_key", F.col("e.title").alias("title"),
        F.col("e.program").alias("program"), F.col("e.series").alias("series"),
        F.col("e.featured_artist").alias("featured_artist"),
        F.coalesce("e.composers", empty).alias("composers"), F.coalesce("e.works", empty).alias("works"),
        "venue", F.coalesce("e.venue_name", "default_location").alias("location"),
        F.coalesce(F.when(nonblank(F.col("e.type")), F.col("e.type")), F.nullif("assumed_type", F.lit("")), "default_type").alias("type"),
        F.col("base_url").alias("url"), "slot.dates", "slot.times",
    )


def load_published(spark: SparkSession, path: str) -> DataFrame:
    """The published list: files that each hold one JSON array; anything else is an error."""
    text = spark.read.text(path, wholetext=True)
    is_array = F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("["))
    checked = F.when(is_array, F.col("value")).otherwise(
        F.raise_error(F.concat(F.input_file_name(), F.lit(" is not a JSON array"))))
    schema = T.ArrayType(T._parse_datatype_string(PUBLISHED_EVENT))
    return text.select(F.inline(F.from_json(checked, schema, {"mode": "FAILFAST"})))


def production_screenings(raw: DataFrame, base_url: str, venue: str) -> DataFrame:
    """Showings of a production feed.

    Blank titles, hidden performances, and performances without a readable stamp or a
    display time are skipped. The link is the performance's, else the production's, else
    built from its season id.
    """
    rows = raw.select("*", F.explode("performances").alias("p")).drop("performances")
    stamp = F.coalesce(F.nullif("p.iso8601DateString", F.lit("")), F.nullif("p.performanceDate", F.lit("")))
    local = F.rtrim(F.substring_index(stamp, "+", 1), F.lit("Z"))
    shown = F.replace(F.upper(F.coalesce("p.displayTime", F.lit(""))), F.lit(" "), F.lit(""))
    shape = r"^(\d{1,2}):(\d{2})(AM|PM)$"
    clock = F.concat(
        match(shown, shape, 1).cast("int").cast("string"), F.lit(":"), match(shown, shape, 2), F.lit(" "), match(shown, shape, 3))
    readable = F.when(local.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.replace(local, F.lit("T"), F.lit(" "))).try_cast("timestamp_ntz")
    return rows.where(
        nonblank(F.col("productionTitle")) & F.coalesce("p.isPerformanceVisible", F.lit(True))
        & readable.isNotNull() & (shown != "")
    ).select(
        *[c for c in raw.columns if c not in ("performances", "productionTitle", "description", "actionUrl", "productionSeasonId")],
        F.trim("productionTitle").alias("title"), F.lit("movie").alias("type"),
        F.date_format(readable, "yyyy-MM-dd").alias("date"), F.coalesce(clock, shown).alias("time"),
        F.lit(venue).alias("venue"),
        F.coalesce(F.nullif("p.actionUrl", F.lit("")), F.nullif("actionUrl", F.lit("")),
                   F.concat(F.lit(f"{base_url}/"), F.coalesce(F.col("productionSeasonId").cast("string"), F.lit("")))).alias("url"),
        F.trim(F.coalesce("description", F.lit(""))).alias("description"),
    )
