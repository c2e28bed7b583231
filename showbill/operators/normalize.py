"""Raw rows to the event schema: names, defaults, templates, standard form."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from showbill.functions.clock import loose_time
from showbill.functions.dates import as_date, date_range, day, partial_date
from showbill.functions.facts import nonblank
from showbill.functions.text import md_to_html
from showbill.operators.scale import written
from showbill.values import DEFAULT_ALIASES, FIELD_DEFAULTS, TEMPLATE_FIELDS


def snake_name(name: str) -> str:
    """snake_case of a field name; camelCase humps and acronyms are split."""
    if name != name.lower():
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[^_])(?=[A-Z][a-z])", "_", name)
    return re.sub(r"[ -]", "_", name.lower())


def snake_case(df: DataFrame) -> DataFrame:
    """All fields in snake_case; a single ``date`` or ``time`` becomes a one-entry array.

    Original names that changed are kept with their values in ``raw_metadata``.
    """
    out, kept = [], []
    names = [snake_name(c) for c in df.columns]
    for old, new in zip(df.columns, names):
        col = F.col(f"`{old}`")
        if new in ("date", "time") and f"{new}s" not in names:
            is_array = df.schema[old].dataType.typeName() == "array"
            out.append((col if is_array else F.when(nonblank(col), F.array(col)).otherwise(
                F.array().cast("array<string>"))).alias(f"{new}s"))
        elif new not in ("date", "time"):
            out.append(col.alias(new))
        if old != new:
            kept += [F.lit(old), col.cast("string")]
    meta = F.create_map(*kept) if kept else F.create_map().cast("map<string,string>")
    return df.select(*out, meta.alias("raw_metadata"))


def default_of(field: str) -> str:
    """Published default of a field, by its own name or the name it is filed under."""
    return FIELD_DEFAULTS.get(DEFAULT_ALIASES.get(field, field), "")


def fill_defaults(df: DataFrame, overrides: DataFrame, fields: Sequence[str], key: str = "venue") -> DataFrame:
    """Blank fields take the venue's default; fields still absent take the general one.

    ``overrides`` has one row per (venue, field, default_value). It is pivoted to one
    row per venue over the given field names, so the join adds no rows.
    """
    wide = overrides.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == f, F.col("default_value"))).alias(f"_d_{f}") for f in fields]
    )
    out = df.join(wide, key, "left")
    for f in fields:
        own = F.when(nonblank(F.col(f)), F.col(f)) if f in df.columns else F.lit(None)
        out = out.withColumn(f, F.coalesce(own, F.col(f"_d_{f}"), F.lit(default_of(f))))
    return out.drop(*[f"_d_{f}" for f in fields])


def apply_template(df: DataFrame, category: str, present: Sequence[str] | None = None) -> DataFrame:
    """Rows of one category with exactly its published fields.

    The description prefers the review; rating and confidence come from the rating
    step; the hook from the summary step; absent fields take their defaults.
    """
    have = set(present if present is not None else df.columns)
    out = [F.col("event_key"), F.lit(category).alias("type")]
    for field in TEMPLATE_FIELDS.get(category, TEMPLATE_FIELDS["other"]):
        if field == "description":
            own = md_to_html(F.col("description")) if "description" in have else F.lit(None)
            review = F.when(nonblank(F.col("review")), md_to_html(F.col("review")))
            col = F.coalesce(review, own, F.lit(default_of(field)))
        elif field == "rating":
            col = F.when(F.col("rated"), F.col("score")).otherwise(int(FIELD_DEFAULTS["rating"]))
        elif field == "one_liner_summary":
            col = F.coalesce(F.col("hook"), F.lit(""))
        elif field == "review_confidence":
            col = F.coalesce(F.col("review_confidence"), F.lit(default_of(field)))
        elif field in have:
            col = F.col(field)
        else:
            col = F.lit(default_of(field))
        out.append(col.alias(field))
    return df.select(*out)


def apply_templates(df: DataFrame, categories: Sequence[str] = tuple(TEMPLATE_FIELDS)) -> DataFrame:
    """Every category through its own template, as one table with nulls where a field does not apply."""
    known = [c for c in categories if c != "other"]
    parts = [apply_template(df.where(F.col("type") == c), c) for c in known]
    if "other" in categories:
        parts.append(apply_template(df.where(~F.col("type").isin(known)), "other"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return table


def fit_times(times: Column, n: Column, default: str | Column) -> Column:
    """Times padded with the default, or trimmed, to one per date."""
    pad = F.array_repeat(F.lit(default), F.greatest(n - F.size(times), F.lit(0)))
    return F.slice(F.concat(times, pad), F.lit(1), F.greatest(n, F.lit(0)))


def standardize(df: DataFrame, today, default_time: str | Column, page_url: Column) -> DataFrame:
    """Extracted rows in standard form; ``reject`` says why a row cannot be listed.

    Dates are read as ranges (a range's start is the date, its end the end date),
    times to HH:mm, and both arrays fitted pairwise. ``dates`` may also have come
    under ``date`` or ``start_date``, or else under any name that mentions a date
    but the end date's. Without any date or time column there are none.
    """
    named = [c for c in ("dates", "date", "start_date") if c in df.columns]
    others = [c for c in df.columns if "date" in c.lower() and c.lower() != "end_date" and c not in named]
    aliases = named + [c for c in others if df.schema[c].dataType.simpleString() in ("string", "array<string>")]
    none = F.lit(None).cast("array<string>")

    def as_array(name: str) -> Column:
        col = F.col(name)
        if df.schema[name].dataType.typeName() != "array":
            col = F.when(nonblank(col), F.array(col))
        return F.when(F.size(col) > 0, F.filter(col, lambda x: nonblank(x)))

    ranges = F.filter(
        F.transform(F.coalesce(none, *[as_array(c) for c in aliases]), lambda v: date_range(v, today)),
        lambda r: r["start"].isNotNull(),
    )
    times = F.coalesce(none, *[as_array(c) for c in ("times", "time") if c in df.columns])
    clean = F.filter(F.transform(times, loose_time), lambda t: t.isNotNull())
    empty = F.array().cast("array<string>")
    out = df.withColumns({"_ranges": ranges, "_times": F.coalesce(clean, empty)})
    n = F.coalesce(F.size("_ranges"), F.lit(0))
    out = out.withColumns({
        "title": F.trim("title"),
        "dates": F.coalesce(F.transform("_ranges", lambda r: r["start"]), empty),
        "times": fit_times(F.col("_times"), n, default_time),
        "end_date": F.coalesce(
            partial_date(F.col("end_date")) if "end_date" in df.columns else F.lit(None).cast("string"),
            F.array_max(F.transform("_ranges", lambda r: r["end"])),
        ),
        "url": F.coalesce(F.when(nonblank(F.col("url")), F.col("url")), page_url) if "url" in df.columns else page_url,
    })
    reject = (
        F.when(~nonblank(F.col("title")), "no title")
        .when(F.coalesce(F.size("dates"), F.lit(0)) <= 0, "no date")
        .when(finished(F.col("end_date"), F.col("dates"), today), "finished")
    )
    return out.withColumn("reject", reject).drop("_ranges", "_times", "date", "time", "start_date")


def venue_rows(df: DataFrame, venues: DataFrame, today, defaults: DataFrame | None = None, fields: Sequence[str] = (),
               default_time: str = "19:00", default_type: str = "other", order: str = "ord") -> DataFrame:
    """Extracted rows of many venues in standard form, with what is known of their venue.

    ``venues`` has one row per ``venue_key``: venue_name, category, preserve_venue_name,
    default_time and page_url. ``defaults`` (venue_key, field, default_value) fill blank
    ``fields`` before anything is read, so a default date or time counts like a written one.
    The category is the venue's, else ``default_type``, whatever the row says. The venue is
    the venue's name; where ``preserve_venue_name`` is set, the row's own comes first. A
    venue's rows with equal title (in any case) and first date are one listing, the first by
    ``order``. Rejected rows stay, each with its reason. Rows of an unknown venue keep their
    own venue name and take the general defaults.
    """
    rows = df
    if defaults is not None and fields:
        wide = defaults.groupBy("venue_key").agg(
            *[F.max(F.when(F.col("field") == f, F.col("default_value"))).alias(f"_given_{f}") for f in fields])
        rows = rows.join(wide, "venue_key", "left")
        for f in fields:
            given = F.col(f"_given_{f}")
            if f not in df.columns:
                filled = given
            elif df.schema[f].dataType.typeName() == "array":
                own = F.filter(f, nonblank)
                filled = F.when(F.size(own) > 0, F.col(f)).when(given.isNotNull(), F.array(given)).otherwise(F.col(f))
            else:
                filled = F.when(nonblank(F.col(f).cast("string")) | given.isNull(), F.col(f)).otherwise(given.cast(df.schema[f].dataType))
            rows = rows.withColumn(f, filled)
        rows = rows.drop(*[f"_given_{f}" for f in fields])
    known = venues.groupBy("venue_key").agg(F.min(F.struct(
        "venue_name", "category", "preserve_venue_name", "default_time", "page_url")).alias("_venue"))
    rows = rows.join(known, "venue_key", "left")
    time = F.coalesce(F.when(nonblank(F.col("_venue.default_time")), F.col("_venue.default_time")), F.lit(default_time))
    out = standardize(rows, today, time, F.col("_venue.page_url"))
    own = F.when(nonblank(F.col("venue")), F.trim("venue")) if "venue" in df.columns else F.lit(None).cast("string")
    named = F.when(F.coalesce("_venue.preserve_venue_name", F.lit(False)), F.coalesce(own, "_venue.venue_name")).otherwise(
        F.coalesce("_venue.venue_name", own))
    category = F.when(nonblank(F.col("_venue.category")), F.col("_venue.category"))
    out = out.withColumns({"venue": named, "type": F.coalesce(category, F.lit(default_type))}).drop("_venue")
    out = written(out, "venue-rows")  # both parts read the same rows, which are judged once
    # The first of equal listings; rejected rows are no listings and take no part.
    listed = out.where(F.col("reject").isNull())
    copies = Window.partitionBy("venue_key", F.lower("title"), F.get("dates", F.lit(0))).orderBy(order)
    once = listed.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy")
    return once.unionByName(out.where(F.col("reject").isNotNull()))


def finished(end_date: Column, dates: Column, today) -> Column:
    """Has it ended? The end date decides when readable, else the latest date; else no."""
    def read(col: Column) -> Column:
        return as_date(F.substring(col, 1, 10))

    last = F.coalesce(read(end_date), read(F.array_max(dates)))
    return F.coalesce(last < F.lit(day(today)), F.lit(False))


def season_row(df: DataFrame, expected_type: str, expected_venue: str | None) -> DataFrame:
    """Rows of a season reply in the stored form; ``reject`` marks what must be dropped."""
    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    def items(name: str) -> Column:
        kept = F.filter(F.transform(name, lambda x: F.trim(x)), lambda x: x != "")
        return F.coalesce(kept, F.array().cast("array<string>"))

    venue = F.coalesce(F.nullif(text("venue_name"), F.lit("")), F.nullif(text("venue"), F.lit("")), F.lit(expected_venue))
    out = df.withColumns({
        "title": text("title"), "venue_name": venue,
        "dates": items("dates"), "times": items("times"),
        "composers": items("composers"), "works": items("works"),
        "program": text("program"), "series": text("series"), "featured_artist": text("featured_artist"),
        "type": F.coalesce(F.nullif(text("type"), F.lit("")), F.lit(expected_type)),
    })
    reject = (
        F.when(F.col("title") == "", "no title")
        .when(F.coalesce("venue_name", F.lit("")) == "", "no venue")
        .when(F.size("dates") == 0, "no date")
        .when(F.size("dates") != F.size("times"), "dates and times differ in length")
    )
    return out.withColumn("reject", reject)


def effective_schema(template: DataFrame, override: DataFrame, policy: DataFrame) -> DataFrame:
    """Extraction schema per venue: the fields of its category with the venue's overrides.

    ``template``: (type, field, description, required_on_publish, pipeline_made).
    ``override``: (venue_key, field, required, description, description_append, default_value).
    Fields the pipeline makes are never asked for.
    """
    fields = policy.join(template.where(~F.col("pipeline_made")), "type")
    joined = fields.join(
        override.withColumnsRenamed({"description": "o_description", "required": "o_required"}),
        ["venue_key", "field"], "left")
    return joined.select(
        "venue_key", "type", "field",
        F.coalesce("o_required", "required_on_publish").alias("required"),
        F.coalesce("o_description", F.concat("description", F.coalesce("description_append", F.lit("")))).alias("description"),
        "default_value",
    )

