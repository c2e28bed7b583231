"""Stored postings for substring search: which texts hold which runs of one to three characters.

One table with two kinds of rows, in folders by kind and shard. ``gram`` rows lead from a gram
to the texts that hold it, ``text`` rows from a text to its events. A search reads the shards
of its grams, and then the shards of the texts found, in which each text is verified.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.operators.filters import reader_label
from showbill.sources import versions

#: Characters of a gram at most; a shorter query is a gram itself.
GRAM = 3
#: Rows of the text table that a shard holds, about.
SHARD_ROWS = 500_000
#: Files that a shard's rows are dealt to while it is written, so that no task holds one alone.
SALT = 8


def _grams(text: Column) -> Column:
    """All runs of one to ``GRAM`` characters, each once."""
    size = F.length(text)

    def runs(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAM + 1)]))


def searchable(event: DataFrame) -> DataFrame:
    """(event_key, field, value) of what a reader's search looks at: title, venue, category and its label."""
    fields = (("title", F.col("title")), ("venue", F.col("venue")), ("type", F.col("type")), ("label", reader_label(F.col("type"))))
    rows = event.select("event_key", F.inline(F.array(*[F.struct(F.lit(name).alias("field"), c.alias("value")) for name, c in fields])))
    return rows.where("value <> ''")


def write_postings(event: DataFrame, root: str, shard_rows: int = SHARD_ROWS) -> int:
    """The postings of all events as a further version of the set at ``root``; returns its number."""
    rows = searchable(event).withColumn("text_id", F.xxhash64(F.lower("value")))
    shards = max(1, math.ceil(event.count() * 4 / shard_rows))

    def shard(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(shards)).cast("int").alias("shard")

    none = F.lit(None)
    texts = rows.select(
        F.lit("text").alias("kind"), shard(F.col("text_id")), none.cast("string").alias("gram"), "text_id", "field", "value", "event_key")
    # equal texts have equal grams, so each distinct text is cut once
    cut = rows.select("text_id", F.lower("value").alias("text")).distinct().select("text_id", F.explode(_grams(F.col("text"))).alias("gram"))
    grams = cut.select(
        F.lit("gram").alias("kind"), shard(F.col("gram")), "gram", "text_id", none.cast("string").alias("field"), none.cast("string").alias("value"),
        none.cast("long").alias("event_key"))
    table = texts.unionByName(grams).withColumn("shards", F.lit(shards))
    dealt = table.repartition("kind", "shard", F.pmod(F.xxhash64("text_id", "event_key"), F.lit(SALT)))
    return versions.commit(dealt.sortWithinPartitions("kind", "shard", "gram", "text_id"), root, "postings", partition_by=("shards", "kind", "shard"))


def _found(spark: SparkSession, root: str, query: str, fields: Sequence[str], version: int | None) -> DataFrame:
    """Text rows whose value holds the query, in any case."""
    q = query.strip().lower()
    index = versions.read(spark, root, version)
    texts = index.where((F.col("kind") == "text") & F.col("field").isin(list(fields)))
    if not q:
        return texts
    wanted = sorted({q[i:i + GRAM] for i in range(max(1, len(q) - GRAM + 1))})
    shards = index.select("shards").first()
    if shards is None:
        return texts
    n = F.lit(shards[0])
    own = F.lit(False)
    for gram in wanted:
        own = own | ((F.col("shard") == F.pmod(F.xxhash64(F.lit(gram)), n).cast("int")) & (F.col("gram") == gram))
    hits = index.where((F.col("kind") == "gram") & own).groupBy("text_id").agg(F.count_distinct("gram").alias("held")).where(
        F.col("held") == len(wanted)).select("text_id", F.pmod(F.xxhash64("text_id"), n).cast("int").alias("shard"))
    return texts.join(hits, ["shard", "text_id"], "left_semi").where(F.lower("value").contains(q))


def matching_events(spark: SparkSession, root: str, query: str, version: int | None = None) -> DataFrame:
    """Keys of the events that ``text_match`` finds, from the postings alone; a blank query finds all."""
    return _found(spark, root, query, ("title", "venue", "type", "label"), version).select("event_key").distinct()


def matching_values(spark: SparkSession, root: str, query: str, field: str, version: int | None = None) -> DataFrame:
    """The distinct values of one field that hold the query."""
    return _found(spark, root, query, (field,), version).select("value").distinct()
