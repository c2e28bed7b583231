"""Writers: envelopes, keyed documents, calendars, text dumps, snapshots, manifests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.functions.text import split_escape
from showbill.operators.grouping import keep_first
from showbill.operators.publish import folded
from showbill.sources import versions
from showbill.values import ZONE


def envelope_header(df: DataFrame, generated_at: str, site_url: str) -> DataFrame:
    """The one-row head of a published dataset: build time, site and row count."""
    return df.agg(F.count("*").alias("count")).select(
        F.lit(generated_at).alias("generated_at"), F.lit(site_url).alias("site_url"), "count")


def json_lines(df: DataFrame) -> DataFrame:
    """Every row as one JSON text; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_envelope(df: DataFrame, path: str, generated_at: str, site_url: str) -> None:
    """A dataset as JSON lines next to its one-row header.

    One JSON document with all rows would have to pass through a single task; lines
    are written by all of them, and the header makes the set checkable.
    """
    json_lines(df).write.mode("overwrite").text(f"{path}/data")
    json_lines(envelope_header(df, generated_at, site_url)).coalesce(1).write.mode("overwrite").text(f"{path}/header")


def documents_by_slug(df: DataFrame, slug: str = "slug", ord: str = "event_key") -> DataFrame:
    """One document per slug, the first wins; rows without a slug are skipped."""
    rows = df.where(F.coalesce(slug, F.lit("")) != "")
    return keep_first(rows.withColumn("_first", F.col(ord)), [slug], "_first").drop("_first")


def write_documents(df: DataFrame, path: str, slug: str = "slug", shard_rows: int = 200_000) -> None:
    """Documents as a table keyed by slug, replacing the previous one.

    The shard of a slug is its hash, so a reader opens one folder to find one document. There
    are as many shards as hold about ``shard_rows`` documents each; their number is part of
    the folder names, so that readers know it.
    """
    documents = documents_by_slug(df, slug)
    shards = max(1, math.ceil(documents.count() / shard_rows))
    sharded = documents.withColumn("shards", F.lit(shards)).withColumn("shard", F.pmod(F.xxhash64(slug), F.lit(shards)).cast("int"))
    sharded.repartition(shards, "shard").sortWithinPartitions("shard", slug).write.mode("overwrite").partitionBy("shards", "shard").parquet(path)


def read_document(spark: SparkSession, path: str, slug: str) -> DataFrame:
    """The document of one slug; only its shard is read."""
    shard = F.pmod(F.xxhash64(F.lit(slug)), F.col("shards")).cast("int")
    return spark.read.parquet(path).where((F.col("shard") == shard) & (F.col("slug") == slug)).drop("shards", "shard")


def write_calendar(blocks: DataFrame, path: str, name: str, description: str = "", product: str = "-//showbill//calendar//EN", zone: str = ZONE) -> None:
    """Calendar blocks as text parts, and the opening and closing lines as parts of their own.

    Lines end in CR LF. Times are in UTC, so a calendar needs no rules of a time zone; the
    zone it is shown in is named in the head.
    """
    spark = blocks.sparkSession
    head = ["BEGIN:VCALENDAR", f"PRODID:{product}", "VERSION:2.0", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}"]
    head += [f"X-WR-CALDESC:{description}"] * bool(description) + [f"X-WR-TIMEZONE:{zone}"]
    ends = spark.createDataFrame([(i, line) for i, line in enumerate(head)], "pos int, line string")
    blocks.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/events")
    ends.coalesce(1).sortWithinPartitions("pos").select(folded(split_escape(F.col("line")))).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/head")
    spark.createDataFrame([("END:VCALENDAR",)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/tail")


def write_lines(df: DataFrame, path: str, *order: Column) -> None:
    """Ordered text lines; the parts are in order."""
    df.orderBy(*order).select("line").write.mode("overwrite").text(path)


def publish(df: DataFrame, root: str, snapshot: str) -> str:
    """A further version of a published set (see ``versions.commit``); returns the folder of its data."""
    return versions.folder(df.sparkSession, root, versions.commit(df, root, snapshot))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of a published set."""
    return versions.read(spark, root)


def manifest_diff(before: DataFrame, after: DataFrame, generated: Column) -> DataFrame:
    """Every path that is only in one of two manifests: lost, pruned or extra.

    A missing path that a generator owns was pruned on purpose; any other one is lost.
    """
    a = before.select("path").distinct().withColumn("_before", F.lit(True))
    b = after.select("path").distinct().withColumn("_after", F.lit(True))
    both = a.join(b, "path", "full")
    state = F.when(F.col("_after").isNull() & generated, "pruned").when(F.col("_after").isNull(), "lost").when(
        F.col("_before").isNull(), "extra")
    return both.select("path", state.alias("state")).where(F.col("state").isNotNull())


def feed_problems(counts: DataFrame, required: dict[str, int]) -> DataFrame:
    """Required feeds that are missing or hold too few entries."""
    wanted = counts.sparkSession.createDataFrame(list(required.items()), "feed string, at_least long")
    joined = wanted.join(counts, "feed", "left")
    problem = F.when(F.col("entries").isNull(), "missing").when(F.col("entries") < F.col("at_least"), "too few entries")
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull())


def write_published(event: DataFrame, path: str, key: str = "event_key", per_file: int = 500) -> None:
    """Events as JSON arrays of a fixed length, the form the published list is exchanged in.

    Keys are unique numbers, so a file holds ``per_file`` events at most.
    """
    json = F.to_json(F.struct(*[c for c in event.columns if c != key]))
    shard = F.floor(F.col(key) / per_file).alias("shard")
    arrays = event.groupBy(shard).agg(F.concat(F.lit("["), F.array_join(F.collect_list(json), ","), F.lit("]")).alias("value"))
    arrays.repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)
