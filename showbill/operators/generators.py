"""Rows made from rules, and unions of sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showbill.functions.clock import start_local
from showbill.functions.facts import nonblank
from showbill.values import WEEKDAYS_LONG

WEEKS_AHEAD = 8


def weekday_number(name: Column) -> Column:
    """Monday 0 .. Sunday 6; null for anything else."""
    table = F.create_map(*[F.lit(x) for i, d in enumerate(WEEKDAYS_LONG) for x in (d.lower(), i)])
    return F.try_element_at(table, F.lower(F.trim(name)))


def weekly(rule: DataFrame, now: str, weeks: int = WEEKS_AHEAD, cutoff: str | None = None, numbered: bool = False) -> DataFrame:
    """One row per week of every weekly rule, from the next such weekday on.

    On the day itself the first showing moves a week ahead once its time has come:
    the rule's own ``time``, or a fixed ``cutoff``. ``numbered`` adds the week to the title.
    Rules with an unknown weekday give no rows.
    """
    at = F.lit(now).cast("timestamp_ntz")
    today = at.cast("date")
    wait = F.pmod(weekday_number(F.col("day_of_week")) - F.weekday(today), F.lit(7))
    limit = F.lit(cutoff) if cutoff else F.col("time")
    passed = at >= start_local(today.cast("string"), limit)
    first = F.date_add(today, F.when((wait == 0) & F.coalesce(passed, F.lit(False)), 7).otherwise(wait).cast("int"))
    days = F.sequence(first, F.date_add(first, 7 * (weeks - 1)), F.expr("INTERVAL 7 DAYS"))
    rows = rule.select("*", F.posexplode(days).alias("week", "d")).withColumn("date", F.col("d").cast("string"))
    if not numbered:
        return rows
    label = F.when(F.col("week") == 0, F.lit("This Week's Story")).otherwise(
        F.concat(F.lit("Week "), (F.col("week") + 1).cast("string")))
    return rows.withColumn("title", F.concat("title", F.lit(" - "), label))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources by field name; absent fields are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def ingest(sources: dict[str, DataFrame], checks: Sequence[tuple[str, Column]], preserve: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejects, source log) of a set of sources.

    Every row is stamped with its source's code as venue; sources in ``preserve`` keep
    their own venue and put the code in ``source_venue``. A row that fails a check goes to
    the rejects with the first reason. The log lists every source, also those without rows.
    """
    stamped = []
    for code, df in sources.items():
        own = F.when(nonblank(F.col("venue")), F.col("venue")) if "venue" in df.columns else F.lit(None)
        keep = code in preserve
        stamped.append(df.withColumns({
            "source": F.lit(code),
            "source_venue": F.lit(code if keep else None).cast("string"),
            "venue": F.coalesce(own, F.lit(code)) if keep else F.lit(code),
        }))
    rows = union_sources(*stamped)
    reason = F.coalesce(*[F.when(F.coalesce(failed, F.lit(True)), F.lit(name)) for name, failed in checks])
    judged = rows.withColumn("reason", reason)
    registry = rows.sparkSession.createDataFrame([(c,) for c in sources], "source string")
    counts = judged.groupBy("source").agg(
        F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    log = registry.join(counts, "source", "left").fillna(0, ["kept", "rejected"]).withColumn("empty", F.col("kept") == 0)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull()), log


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct()
