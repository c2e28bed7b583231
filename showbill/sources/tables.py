"""The driver's tables read as listing tables.

``screening`` has one row per showing. Every row carries ``ord``, a text key that
is unique and stands for "position in the source": all first/last rules order by
it, because Spark rows have no order of their own. Joins are plain equi joins;
Spark decides from table statistics whether a side is small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.values import PART_TYPE_CATEGORY


#: Tables with a row per fact; the others are lookups.
FACTS = ("lineitem", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored.

    A small fact table is one file with one row group, which a single task would read
    and carry through all row-wise work. Where a scan has fewer splits than there are
    cores its rows are dealt out by key; a large table has far more and is left alone.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in FACTS and 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores:
        return df.repartition(cores, df.columns[0])
    return df


def dealt(spark: SparkSession, sf_dir: str, name: str, tasks: int = 4) -> DataFrame:
    """The same rows dealt out by key, ``tasks`` tasks a core, for work that costs far more than moving them.

    The splits of a scan are as even as its row groups: a file has fewer of these than a cluster
    has cores, or leaves most cores idle while the last ones are worked off.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(tasks * spark.sparkContext.defaultParallelism, df.columns[0])


def stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 100) -> DataFrame:
    """A table as a stream of its files.

    The path is written as a pattern, which a file stream accepts for a folder of parts
    and for a single file alike.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{sf_dir}/{name}.parque[t]")


def _padded(col: str, width: int):
    return F.lpad(F.col(col).cast("string"), width, "0")


def category_of(part_type):
    """Event category of a part type; unknown types are ``other``."""
    out = F.lit("other")
    for raw, category in PART_TYPE_CATEGORY.items():
        out = F.when(part_type == raw, category).otherwise(out)
    return out


def _cents():
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _ord():
    return F.concat(
        _padded("l_orderkey", 13), _padded("l_linenumber", 2), _padded("l_partkey", 12), _padded("l_suppkey", 10),
        F.lpad(_cents().cast("string"), 12, "0"),
    )


def _showing_columns() -> dict:
    return {
        "event_key": F.col("l_partkey"),
        "ord": _ord(),
        "date": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "time": F.concat(
            F.lpad((F.col("l_linenumber") + 10).cast("string"), 2, "0"),
            F.when(F.col("l_quantity") % 2 == 0, ":00").otherwise(":30"),
        ),
        "d": F.col("l_shipdate").cast("date"),
        "dow": F.weekday("l_shipdate"),
        "n": F.col("l_linenumber"),
        "order_key": F.col("l_orderkey"),
        "supp_key": F.col("l_suppkey"),
        "shown_at": F.col("l_shipdate"),
    }


def showings(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """When every event is shown: the fact table alone, without any lookup."""
    rows = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    return rows.select(*[c.alias(n) for n, c in _showing_columns().items()])


def _event_columns(venue_url_key) -> dict:
    return {
        "title": F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 500).cast("string")),
        "type": category_of(F.col("p_type")),
        "venue": F.col("s_name"),
        "rating": F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("p_size") % 11).cast("int"),
        "url": F.concat(
            F.lit("https://"), F.lower(F.replace("s_name", F.lit("#"), F.lit(""))), F.lit("/"), venue_url_key.cast("string")),
    }


def _with_lookups(rows: DataFrame, spark: SparkSession, sf_dir: str, person: bool) -> DataFrame:
    """Rows with l_partkey, l_suppkey (and l_orderkey) joined to what these name."""
    rows = rows.join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if person:
        rows = rows.join(
            table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"),
        ).join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return rows


def screening(spark: SparkSession, sf_dir: str, person: bool = False, lineitem: DataFrame | None = None) -> DataFrame:
    """One row per showing with the fields of its event.

    The stored ``shown_at`` serves for pruning. ``lineitem`` may be a stream of the same rows.
    """
    rows = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    columns = {**_showing_columns(), **_event_columns(F.col("l_partkey"))}
    if person:
        columns["person"] = F.col("c_name")
    return _with_lookups(rows, spark, sf_dir, person).select(*[c.alias(n) for n, c in columns.items()])


EVENT_FIELDS = ("title", "type", "venue", "rating", "url")


def event(spark: SparkSession, sf_dir: str, person: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """One row per event: the fields of its first showing row.

    The first row is found on the keys alone, so narrow numbers are shuffled; names are
    looked up afterwards, once per event. ``keys`` limits the result to some events.
    """
    from showbill.operators.grouping import first_row

    rows = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_returnflag",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _cents().alias("cents")).alias("at"))
    if keys is not None:
        rows = rows.join(keys.select(F.col("event_key").alias("l_partkey")), "l_partkey", "left_semi")
    kept = ["l_suppkey", "l_returnflag"] + (["l_orderkey"] if person else [])
    first = first_row(rows, ["l_partkey"], kept, ord="at")
    columns = {"event_key": F.col("l_partkey"), **_event_columns(F.col("l_partkey"))}
    if person:
        columns["person"] = F.col("c_name")
    return _with_lookups(first, spark, sf_dir, person).select(*[c.alias(n) for n, c in columns.items()])


def listing(spark: SparkSession, sf_dir: str, person: bool = False, lineitem: DataFrame | None = None) -> DataFrame:
    """Raw listings with parallel ``dates`` and ``times`` arrays, one per source row.

    ``damage`` (part key modulo 7) makes the faults the normalizers repair: 1 12-hour
    times, 2 slash dates, 3 no times, 4 fewer times than dates, 5 blank title, 6 an end
    date in the past. A line number divisible by 4 has no dates at all.
    """
    k, i = F.col("n") % 4, F.col("i")
    rows = screening(spark, sf_dir, person, lineitem).withColumn("damage", F.col("event_key") % 7)
    slots = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))

    def date_text(i):
        d = F.date_add("d", (i * 7).cast("int"))
        slash = F.concat_ws("/", F.month(d).cast("string"), F.day(d).cast("string"), F.year(d).cast("string"))
        return F.when(F.col("damage") == 2, slash).otherwise(d.cast("string"))

    def time_text(i):
        hour, minute = F.col("n") + 10 + i, F.substring("time", 4, 2)
        plain = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute)
        h12 = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
        clock = F.concat(h12.cast("string"), F.lit(":"), minute, F.when(hour >= 12, " PM").otherwise(" AM"))
        return F.when(F.col("damage") == 1, clock).otherwise(plain)

    n_times = F.when(F.col("damage") == 3, 0).when(F.col("damage") == 4, F.least(k, F.lit(1))).otherwise(k)
    end = (
        F.when(F.col("damage") == 6, F.date_sub("d", 30).cast("string"))
        .when(F.col("event_key") % 5 == 0, F.date_add("d", 45).cast("string"))
    )
    return (
        rows.withColumn("dates", F.transform(slots, date_text))
        .withColumn("times", F.slice(F.transform(slots, time_text), F.lit(1), n_times.cast("int")))
        .withColumn("end_date", end)
        .withColumn("title", F.when(F.col("damage") == 5, F.lit("  ")).otherwise(F.col("title")))
        .drop("date", "time", "dow", "shown_at")
    )
