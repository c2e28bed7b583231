"""Checks: validation errors, source health, quality ratios, lint, freshness, review sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showbill.functions.dates import day
from showbill.functions.facts import nonblank
from showbill.functions.review import (
    EMOJI_CLASS,
    is_non_judgement, is_refusal, paragraphs, section, split_strong,
)
from showbill.functions.text import html_text
from showbill.operators.grouping import keep_first
from showbill.operators.ranking import sample_per_source
from showbill.values import (
    BANNED_PHRASES, CATEGORIES, DASH, DASH_LIMIT, FAILURE_PATTERNS, PLAIN_LABEL, SECTION_EMOJI, SHOUTED_LABEL, STALE_HOURS,
)


# --- review sections ----------------------------------------------------------------------

def review_sections(df: DataFrame, key: str, html: str, dialect: str = "digest") -> DataFrame:
    """One row per paragraph of a review: its rating, or emoji, label and body."""
    parts = paragraphs(F.col(html))
    if dialect == "reader":
        parts = split_strong(parts)
    rows = df.select(key, F.posexplode(parts).alias("pos", "raw"))
    rows = rows.where(html_text(F.col("raw"), "bare") != "")
    return rows.select(key, "pos", section(F.col("raw"), dialect).alias("s")).select(key, "pos", "s.*")


def reader_sections(df: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """(sections shown to readers, number of declined sections per review).

    Known emoji name the section whatever its header says; headers without a body and
    repeated labels are dropped, and so are sections that decline to judge.
    """
    rows = review_sections(df, key, html, "reader").where(F.col("rating").isNull())
    known = F.create_map(*[F.lit(x) for pair in SECTION_EMOJI.items() for x in pair])
    canonical = F.try_element_at(known, F.col("emoji"))
    lead = rf"^[{EMOJI_CLASS}\s]+"
    plain_label = F.when(F.col("emoji") != "", F.trim(F.regexp_replace("label", lead, ""))).otherwise(F.col("label"))
    bare_body = F.regexp_replace(
        F.regexp_replace(
            F.regexp_replace("body", lead, ""),
            SHOUTED_LABEL, ""),
        PLAIN_LABEL, "")
    bare_body = F.regexp_replace(bare_body, r"^[\s–—\-:,.]+|\s+$", "")
    rows = rows.withColumns({
        "body": F.when(canonical.isNotNull() & (plain_label == ""), bare_body).otherwise(F.col("body")),
        "label": F.coalesce(canonical, plain_label),
    })
    rows = rows.where((F.col("body") != "") | (F.col("label") == ""))
    # A blank label is never a repeat: its position keeps each row apart.
    slot = F.when(F.col("label") == "", F.col("pos")).otherwise(-1)
    once = keep_first(rows.withColumn("slot", slot).withColumn("first_pos", F.col("pos")), [key, "label", "slot"], "first_pos")
    judged = once.withColumn("declined", is_non_judgement(F.col("body")))
    declined = judged.where("declined").groupBy(key).agg(F.count("*").alias("declined"))
    return judged.where(~F.col("declined")).select(key, "pos", "label", "emoji", "body"), declined


def decline_rate(sections: DataFrame, category: str) -> DataFrame:
    """Per category: reviews, share with a declined section, spread of scores."""
    return sections.groupBy(category).agg(
        F.count("*").alias("reviews"),
        F.avg(F.col("has_declined").cast("int")).alias("decline_rate"),
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("score_spread"),
        F.min("score").alias("low_score"), F.max("score").alias("high_score"),
    )


# --- validation ----------------------------------------------------------------------------

def explode_messages(df: DataFrame, key: str, checks: Sequence[tuple[Column, Column]], level: str = "error") -> DataFrame:
    """One row per failed check; a check is (failed, message)."""
    messages = F.array(*[F.when(F.coalesce(failed, F.lit(False)), message) for failed, message in checks])
    return df.select(key, F.explode(F.filter(messages, lambda m: m.isNotNull())).alias("message")).withColumn(
        "level", F.lit(level))


def validate(df: DataFrame, key: str = "ord", required: Sequence[str] = ("title", "venue"),
             labels: Sequence[str] = CATEGORIES, free_times: bool = False) -> DataFrame:
    """Problems of every listing: absent fields, field names, date and time formats, lengths, category.

    Season files write times as they like: with ``free_times`` a time only has to be there.
    """
    n_dates, n_times = (F.coalesce(F.size(c), F.lit(0)) for c in ("dates", "times"))
    bad_date = F.get(F.filter("dates", lambda x: ~x.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(0))
    bad_time = F.get(F.filter("times", lambda x: ~x.rlike(r"\S" if free_times else r"^\d{2}:\d{2}$")), F.lit(0))
    checks = [(~nonblank(F.col(c)), F.lit(f"missing {c}")) for c in required]
    checks += [(F.col(f"`{c}`").isNotNull(), F.lit(f"field name not in snake case: {c}")) for c in df.columns if c != c.lower() or " " in c]
    checks += [
        (n_dates <= 0, F.lit("no dates")),
        (n_times <= 0, F.lit("no times")),
        ((n_dates > 0) & (n_times > 0) & (n_dates != n_times), F.concat(
            F.lit("mismatched lengths: "), n_dates.cast("string"), F.lit(" dates, "), n_times.cast("string"), F.lit(" times"))),
        (bad_date.isNotNull(), F.concat(F.lit("invalid date: "), bad_date)),
        (bad_time.isNotNull(), F.concat(F.lit("invalid time: "), bad_time)),
        (~F.col("type").isin(list(labels)), F.concat(F.lit("unknown category: "), F.col("type"))),
    ]
    return explode_messages(df, key, checks)


def schema_warnings(df: DataFrame, expected: dict[str, str], key: str = "ord") -> list[str]:
    """Fields of a table whose type is not the expected one; read from the schema alone."""
    types = dict(df.dtypes)
    return [f"{f} should be {t}, is {types[f]}" for f, t in expected.items() if f in types and types[f] != t]


# --- health --------------------------------------------------------------------------------

def source_health(rows: DataFrame, source: str, valid: Column, k: int = 3) -> DataFrame:
    """Row count and share of valid rows among the first ``k`` of every source."""
    counts = rows.groupBy(source).agg(F.count("*").alias("found"))
    sampled = sample_per_source(rows.withColumn("_valid", valid), source, k).groupBy(source).agg(
        F.count("*").alias("sampled"), F.count_if("_valid").alias("valid"))
    return counts.join(sampled, source).withColumn("rate", F.col("valid") / F.col("sampled")).withColumn(
        "healthy", F.col("rate") >= 0.5)


def gate(health: DataFrame) -> DataFrame:
    """One row: go on, or the reason to stop."""
    total = health.agg(
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"),
        F.count_if("healthy").alias("healthy"), F.count_if(~F.col("healthy")).alias("failed"))
    reason = (
        F.when(F.col("found") == 0, "no source produced any rows")
        .when((F.col("healthy") == 0) & (F.col("failed") > 0), "every source failed")
        .when(F.col("failed") > F.col("healthy"), "more sources failed than passed")
        .otherwise("")
    )
    return total.withColumn("reason", reason).withColumn("go", F.col("reason") == "")


def telemetry(verdicts: DataFrame, classified: DataFrame) -> DataFrame:
    """Counters of an enrichment run as (counter, value) rows."""
    labels = classified.groupBy(F.concat(F.lit("classified:"), F.coalesce("category", F.lit("abstained"))).alias("counter")).agg(
        F.count("*").alias("value"))
    fields = verdicts.groupBy(F.when(F.col("accepted"), "fields accepted").otherwise("fields rejected").alias("counter")).agg(
        F.count("*").alias("value"))
    return labels.unionByName(fields)


def stale_sources(log: DataFrame, now_text: str, hours: int = STALE_HOURS) -> DataFrame:
    """Sources whose last update is older than the limit, with their age in hours."""
    age = F.timestamp_diff("HOUR", "last_updated", F.lit(now_text).cast("timestamp_ntz"))
    seconds = F.timestamp_diff("SECOND", "last_updated", F.lit(now_text).cast("timestamp_ntz"))
    return log.withColumn("age_hours", age).where(seconds > hours * 3600)


def quiet_venues(known: DataFrame, screening: DataFrame, today) -> DataFrame:
    """Known venues without a showing from today on."""
    coming = screening.where(F.col("d") >= F.lit(day(today))).select("venue").distinct()
    return known.join(coming, "venue", "left_anti")


def quality_report(event: DataFrame) -> DataFrame:
    """Per venue: share rated, with a hook and with showings, against 0.8, 0.8 and 0.9."""
    def share(test: Column) -> Column:
        return F.avg(F.coalesce(test, F.lit(False)).cast("int"))

    shares = event.groupBy("venue").agg(
        F.count("*").alias("events"),
        share(F.col("rating") >= 0).alias("rated"),
        share(nonblank(F.col("hook"))).alias("hooked"),
        share(F.col("n_showings") > 0).alias("shown"),
    )
    return shares.withColumn(
        "ok", (F.col("rated") >= 0.8) & (F.col("hooked") >= 0.8) & (F.col("shown") >= 0.9))


def refusing_events(event: DataFrame, fields: Sequence[str] = ("description", "hook")) -> DataFrame:
    """Events whose text, without tags, declines; the first such field is named."""
    hits = [F.when(is_refusal(html_text(F.col(f), "spaced")), F.lit(f)) for f in fields]
    return event.withColumn("field", F.coalesce(*hits)).where(F.col("field").isNotNull())


def style_lint(df: DataFrame, key: str, fields: Sequence[str], limit: int = DASH_LIMIT) -> DataFrame:
    """Overused phrases and too many dashes, one row per finding."""
    pattern = r"(?iU)\b(" + "|".join(BANNED_PHRASES) + r")\b"
    parts = []
    for f in fields:
        found = F.regexp_extract_all(F.coalesce(F.col(f), F.lit("")), F.lit(pattern), F.lit(1))
        parts.append(df.select(key, F.lit(f).alias("field"), F.explode(found).alias("finding")))
    dashes = None
    for f in fields:
        text = F.coalesce(F.col(f), F.lit(""))
        n = F.length(text) - F.length(F.replace(text, F.lit(DASH), F.lit("")))
        dashes = n if dashes is None else dashes + n
    over = df.withColumn("_n", dashes).where(F.col("_n") > limit)
    parts.append(over.select(key, F.lit("all").alias("field"), F.concat(F.lit("dashes: "), F.col("_n").cast("string")).alias("finding")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failing_source(lines: DataFrame, run: str = "run", line_no: str = "line_no") -> DataFrame:
    """The failed source of every run: the first pattern that occurs, in its first line."""
    hits = [F.nullif(F.trim(F.regexp_extract("line", p, 1)), F.lit("")) for p in FAILURE_PATTERNS]
    found = F.coalesce(*[
        F.when(h.isNotNull(), F.struct(F.lit(i).alias("pattern_no"), F.col(line_no).alias("at"), h.alias("source")))
        for i, h in enumerate(hits)
    ])
    return lines.withColumn("hit", found).where(F.col("hit").isNotNull()).groupBy(run).agg(
        F.min("hit").alias("hit")).select(run, "hit.pattern_no", "hit.source")


def coverage_vs_truth(scraped: DataFrame, truth: DataFrame, keys: Sequence[str] = ("title_key", "date", "time")) -> tuple[DataFrame, DataFrame]:
    """(coverage row, missing triples) of the expected showings."""
    expected = truth.select(*keys).distinct()
    have = scraped.select(*keys).distinct().withColumn("hit", F.lit(1))
    joined = expected.join(have, list(keys), "left")
    ratio = joined.agg(
        F.count("*").alias("expected"), F.count("hit").alias("found"),
        (F.count("hit") / F.count("*")).alias("coverage"))
    return ratio, joined.where(F.col("hit").isNull()).select(*keys)



def view_counts(screening: DataFrame, today) -> DataFrame:
    """Events per view: today, the next seven days, the weekend; one pass over the widest range."""
    from showbill.operators.filters import view_bounds
    from showbill.operators.ranking import in_range

    views = {v: view_bounds(v, today) for v in ("today", "week", "weekend")}
    rows = in_range(screening, min(a for a, _ in views.values()), max(b for _, b in views.values()))
    per_event = rows.groupBy("event_key").agg(*[
        F.bool_or(F.col("d").between(F.lit(a), F.lit(b))).alias(v) for v, (a, b) in views.items()])
    counts = per_event.agg(*[F.count_if(v).alias(v) for v in views])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("events")) for v in views])))
