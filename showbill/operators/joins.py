"""Joins: lookups, caches, overrides, companions, anti joins and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showbill.functions.facts import nonblank
from showbill.functions.review import is_refusal
from showbill.functions.text import slug, squeeze, title_key
from showbill.operators.grouping import first_row
from showbill.operators.ranking import first_usable_attempt
from showbill.operators.scale import connected, containing, ensure_checkpoint_dir, written
from showbill.values import CATEGORIES, DEFAULT_SCORE


def attach_venue(event: DataFrame, code_map: DataFrame, venue: DataFrame) -> DataFrame:
    """Display name and address over two hops, code to key to venue.

    Without a match the code stands for the name and the address is empty.
    """
    known = code_map.join(venue, "venue_key").select(
        F.col("code").alias("venue"), F.col("display_name").alias("_name"), F.col("address").alias("_address"))
    return event.join(known, "venue", "left").withColumns({
        "venue_display_name": F.coalesce("_name", "venue", F.lit("")),
        "venue_address": F.coalesce("_address", F.lit("")),
    }).drop("_name", "_address")


# --- ratings -----------------------------------------------------------------------------

def override_rules(rules: DataFrame) -> DataFrame:
    """A table of rules with the columns that matching needs; absent ones are open, and a null in a rule leaves it open.

    Needs rating, and ``rule_no`` where the order of the rules matters: the least that fits counts.
    """
    def field(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in rules.columns else F.lit(None)).cast(kind)

    blank = F.lit("")
    return rules.select(
        (field("rule_no", "int") if "rule_no" in rules.columns else F.lit(1)).alias("rule_no"),
        F.coalesce(F.lower(field("title")), blank).alias("needle"),
        field("venue").isNull().alias("any_v"), F.coalesce(field("venue"), blank).alias("v"),
        field("type").isNull().alias("any_t"), F.coalesce(field("type"), blank).alias("t"),
        field("rating", "int").alias("rating"), field("summary").alias("summary"))


def apply_overrides(event: DataFrame, rules: Sequence[dict] | DataFrame) -> DataFrame:
    """Rating, summary and hook of the first rule that fits; rules come as a list or as a table (``override_rules``).

    A rule names any of title (contained, any case), venue and type (equal). Every rule is
    one key, title piece, venue and type with a mark for each that it leaves open, and every
    event looks up the four combinations of its venue and type with the pieces of its title:
    an equi join for any number of rules. Of the rules with one key only the first can count,
    so an event meets at most one rule a key. A null title, venue or type fits only rules
    that leave it open.
    """
    if not isinstance(rules, DataFrame):
        rules = event.sparkSession.createDataFrame(
            [(no, r.get("title"), r.get("venue"), r.get("type"), r["rating"], r.get("summary")) for no, r in enumerate(rules, 1)],
            "rule_no int, title string, venue string, type string, rating int, summary string")
    key = ["needle", "any_v", "v", "any_t", "t"]
    table = override_rules(rules).groupBy(*key).agg(F.min(F.struct("rule_no", "rating", "summary")).alias("rule"))

    def either(field: str) -> list[tuple[Column, Column]]:
        return [(F.lit(False), F.col(field)), (F.lit(True), F.lit(""))]

    combos = F.array(*[F.struct(av.alias("any_v"), v.alias("v"), at.alias("any_t"), t.alias("t"))
                       for av, v in either("venue") for at, t in either("type")])
    keyed = event.select("event_key", F.lower("title").alias("text"), F.explode(combos).alias("c")).select("event_key", "text", "c.*")
    pieces = containing(event.select(F.lower("title").alias("text")).distinct(), table)
    looked = keyed.join(pieces, "text").unionByName(keyed.withColumn("needle", F.lit(""))).drop("text")
    best = looked.join(table, key).groupBy("event_key").agg(F.min("rule").alias("override"))
    return event.join(best, "event_key", "left")


def rating_cache(published: DataFrame) -> DataFrame:
    """Cache of ratings by upper-cased title; the last published row wins."""
    usable = published.withColumn("cache_key", title_key(F.col("title"), "upper")).where(
        (F.col("cache_key") != "") & F.col("rating").isNotNull())
    return first_row(usable, ["cache_key"], ["rating", "description"], last=True)


def attach_rating_cache(event: DataFrame, cache: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached rating, misses to rate).

    A cached refusal is a miss. With ``force`` the first row of every title is a miss.
    """
    keyed = event.withColumn("cache_key", title_key(F.col("title"), "upper"))
    side = cache.select("cache_key", F.col("rating").alias("cached_rating"), F.col("description").alias("cached_summary"),
                        F.lit(True).alias("_cached"))
    joined = keyed.join(side, "cache_key", "left")
    hit = F.coalesce("_cached", F.lit(False)) & ~is_refusal(F.col("cached_summary"))
    if force:
        # Only cached titles are forced; the first event of each is rated again.
        firsts = keyed.groupBy("cache_key").agg(F.min("event_key").alias("event_key")).withColumn("_first", F.lit(True))
        joined = joined.join(firsts, ["cache_key", "event_key"], "left")
        hit = hit & F.col("_first").isNull()
    joined = joined.withColumn("_hit", hit)
    drop = ["_cached", "_hit", "_first"]
    return joined.where("_hit").drop(*drop), joined.where(~F.col("_hit")).drop("cached_rating", "cached_summary", *drop)


def attach_summary_cache(event: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached hook by (upper-cased title, type); null marks a miss."""
    keyed = event.withColumn("_key", title_key(F.col("title"), "upper"))
    side = cache.select(F.col("title_key").alias("_key"), "type", F.col("summary").alias("cached_hook"))
    return keyed.join(side, ["_key", "type"], "left").drop("_key")


def resolve_rating(event: DataFrame, attempt: DataFrame, secondary: DataFrame) -> DataFrame:
    """Review of the first usable attempt, else the secondary source, else a stub with score 5."""
    first = first_usable_attempt(attempt).withColumnRenamed("content", "first_content")
    other = secondary.select("event_key", F.col("content").alias("second_content"))
    stub = F.concat(F.lit("Unable to evaluate "), F.col("title"), F.lit(" (no sources found)."))
    out = event.join(first, "event_key", "left").join(other, "event_key", "left")
    return out.withColumns({
        "review": F.coalesce("first_content", "second_content", stub),
        "origin": F.when(F.col("first_content").isNotNull(), "attempt").when(F.col("second_content").isNotNull(), "secondary").otherwise("stub"),
        "score": F.when(F.coalesce("first_content", "second_content").isNull(), F.lit(DEFAULT_SCORE)),
    })


# --- companions ----------------------------------------------------------------------------

def merge_companions(event: DataFrame, screening: DataFrame, hint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companion rows with the film they belong to, events that stay on their own).

    ``hint`` has event_key, hint_title, hint_date. The film has a showing on the date and
    its title contains the hinted title; the first such film takes the companion (of
    films with equal titles, the last one). A companion row carries the companion's own title,
    venue, url, first time and description, absent ones as empty texts.
    """
    films = event.where(F.col("type").isin("movie", "screening")).select(
        F.col("event_key").alias("film_key"), F.lower("title").alias("film_title"))
    films = written(films, "films")
    shown = screening.select(F.col("event_key").alias("film_key"), F.col("date").alias("hint_date")).distinct()
    by_title = films.join(shown, "film_key").groupBy("film_title", "hint_date").agg(
        F.min("film_key").alias("first_key"), F.max("film_key").alias("film_key"))
    wanted = written(hint.withColumn("needle", F.lower(F.trim("hint_title"))).where(F.col("needle") != ""), "hints")
    pairs = containing(films.select(F.col("film_title").alias("text")), wanted).withColumnRenamed("text", "film_title")
    # From the films' side each title leads to few hints; from the hints' side a common word
    # would lead to every film.
    best = by_title.join(pairs, "film_title").join(
        wanted.select("needle", "hint_date"), ["needle", "hint_date"], "left_semi").groupBy("needle", "hint_date").agg(
        F.min_by("film_key", "first_key").alias("film_key"))
    matched = written(wanted.join(best, ["needle", "hint_date"]).select("event_key", "film_key", "hint_title", "hint_date"), "companions")
    own = ("title", "venue", "url", "description")
    fields = event.select("event_key", *[
        F.coalesce(F.col(c), F.lit("")).alias(c) if c in event.columns else F.lit("").alias(c) for c in own])
    # only companions' showings are looked for their first time
    times = first_row(screening.join(matched.select("event_key"), "event_key", "left_semi"), ["event_key"], ["time"])
    attached = matched.join(fields, "event_key").join(times, "event_key", "left").withColumn("time", F.coalesce("time", F.lit("")))
    return attached, event.join(matched.select("event_key"), "event_key", "left_anti")


# --- anti joins ----------------------------------------------------------------------------

def showing_key(title: Column, date: Column, time: Column, venue: Column) -> Column:
    """Identity of a showing: lower-cased and trimmed title, date, time and venue."""
    def low(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    return F.concat_ws("_", low(title), date, low(time), low(venue))


def _first_come(frame):
    """Keys of the listings that the sequential rule keeps; the frame has whole groups, which share no showing."""
    import pandas as pd

    key = frame.columns[0]
    frame = frame.sort_values(key, kind="stable")
    taken, kept = set(), []
    for name, rows in groupby(zip(frame[key], frame["showing_key"], strict=True), key=itemgetter(0)):
        shows = [show for _, show in rows]
        if taken.isdisjoint(shows):
            taken.update(shows)
            kept.append(name)
    return pd.DataFrame({key: kept})


def _round(open_: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(listings that are first on all their showings, pairs that are open without these and what they block).

    A showing is taken if its first listing wins, since a winner is the first on all of its own.
    """
    first = open_.groupBy("showing_key").agg(F.min(key).alias("_first"))
    judged = written(open_.join(first, "showing_key"), "listing-judged")
    winners = written(judged.groupBy(key).agg(F.bool_and(F.col(key) == F.col("_first")).alias("_wins")).where("_wins").select(key), "listing-winners")
    settled = judged.join(winners.withColumnRenamed(key, "_first"), "_first", "left_semi").select(key).distinct()
    return winners, written(open_.join(settled, key, "left_anti"), "listing-open")


def _kept_in_rounds(open_: DataFrame, key: str) -> DataFrame:
    """What the sequential rule keeps, settled in as many rounds as the longest chain of overlaps is long."""
    kept = open_.select(key).limit(0)
    while not open_.isEmpty():
        winners, open_ = _round(open_, key)
        kept = kept.unionByName(winners)
    return kept


def _numbered(shows: DataFrame, key: str, n: int) -> DataFrame:
    """One row per listing: its key, a number that rises with the key, and its distinct showings."""
    rows = shows.select(key, "showing_key").repartitionByRange(n, key).groupBy(key).agg(F.collect_set("showing_key").alias("_shows"))
    # the ids of sorted ranges rise with the key
    return written(rows.sortWithinPartitions(key).select(key, F.monotonically_increasing_id().alias("_no"), "_shows"), "listing-numbers")


def _first_round(listings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_round``, for numbered listings with their showings as texts; a known showing is taken by nobody's number, -1.

    A listing wins if it is the first on as many showings as it has. Texts are only met with the
    showings that another listing has too or that are known, and leave as numbers.
    """
    pairs = listings.select("_no", F.size("_shows").alias("_n"), F.explode("_shows").alias("showing_key"))
    stored = known.select(F.lit(-1).cast("long").alias("_no"), F.lit(0).alias("_n"), "showing_key").where("showing_key is not null")
    first = pairs.unionByName(stored).groupBy("showing_key").agg(F.min(F.struct("_no", "_n")).alias("_at"), F.count("*").alias("_rows"))
    # a showing that one listing has alone counts for it, but takes no other part
    first = written(first.select(F.when(F.col("_rows") > 1, F.col("showing_key")).alias("showing_key"), "_at._no", "_at._n",
                                 F.monotonically_increasing_id().alias("_show")), "listing-first")
    winners = written(first.where("_no >= 0").groupBy("_no", "_n").agg(F.count("*").alias("_firsts")).where("_firsts = _n").select("_no"), "listing-winners")
    shared = first.where("showing_key is not null").select("showing_key", "_show", F.col("_no").alias("_first"))
    taken = shared.join(winners.select(F.col("_no").alias("_first"), F.lit(True).alias("_won")), "_first", "left").select(
        "showing_key", "_show", (F.col("_won").isNotNull() | (F.col("_first") < 0)).alias("_taken"))
    left = pairs.select("_no", "showing_key").join(taken, "showing_key").groupBy("_no").agg(
        F.bool_or("_taken").alias("_settled"), F.collect_list("_show").alias("_shows")).where("not _settled")
    return winners, written(left.select("_no", F.explode("_shows").alias("showing_key")), "listing-open")


def new_listings(shows: DataFrame, known: DataFrame, key: str = "ord", group_rows: int = 100_000) -> DataFrame:
    """Listings none of whose showings is known or belongs to an earlier kept listing.

    ``shows`` has one row per (listing, showing_key); ``known`` the stored showing keys.
    The rule is sequential: an earlier listing that is itself dropped blocks nobody. Listings
    get numbers in the order of their keys when they are gathered, and only numbers are moved
    after the first round, in which a listing without a shared showing stays and one with a
    known one goes. They are settled in
    rounds across tasks while a round leaves less than half of the rows open. What is left,
    such as long chains, falls into groups that overlap, found by contraction in a number of
    rounds that grows with the logarithm of the longest chain, and each group is settled in
    order by one task. Only a group of more than ``group_rows`` rows is settled in rounds
    to its end, one for each link of its longest chain.
    """
    n = int(shows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = _numbered(shows, key, n)
    listings = numbers.where(F.col(key).isNotNull())
    # without a showing nothing can be taken, and what has no key is no listing before or after another
    free = numbers.where(F.col(key).isNull() | (F.size("_shows") == 0)).select(key)
    before = listings.agg(F.sum(F.size("_shows"))).first()[0] or 0
    kept, left = _first_round(listings, known)
    rows = left.count()
    while rows and 2 * rows < before:
        winners, left = _round(left, "_no")
        kept, before, rows = kept.unionByName(winners), rows, left.count()
    if rows:
        kept = kept.unionByName(_kept_in_groups(left, "_no", n, group_rows))
    return free.unionByName(numbers.select(key, "_no").join(kept, "_no", "left_semi").select(key))


def _kept_in_groups(open_: DataFrame, key: str, n: int, group_rows: int) -> DataFrame:
    """What the sequential rule keeps, group by group of overlapping listings."""
    first = open_.groupBy("showing_key").agg(F.min(key).alias("b"))
    groups = connected(open_.join(first, "showing_key").select(F.col(key).alias("a"), "b"))
    rows = open_.join(groups.withColumnRenamed("node", key), key)
    sizes = rows.groupBy("group").agg((F.count("*") <= group_rows).alias("_small"))
    rows = written(rows.join(sizes, "group").select("group", key, "showing_key", "_small"), "listing-groups")
    # many small groups go through one task together, about ``group_rows`` rows at most besides the last group
    parts = max(n, 1 + rows.count() // group_rows)
    part = F.pmod(F.xxhash64("group"), F.lit(parts)).alias("_part")
    small = rows.where("_small").select(key, "showing_key", part).repartition(parts, "_part")
    kept = small.groupBy("_part").applyInPandas(lambda frame: _first_come(frame[[key, "showing_key"]]), f"`{key}` {dict(rows.dtypes)[key]}")
    large = rows.where("not _small").select(key, "showing_key")
    if not large.isEmpty():
        kept = kept.unionByName(_kept_in_rounds(large, key))
    return kept


def new_names(candidate: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Candidates whose name, squeezed and lower-cased, is not known; the first of each is kept."""
    def norm(c: Column) -> Column:
        return F.lower(squeeze(F.coalesce(c, F.lit(""))))

    rows = candidate.withColumn("name_key", norm(F.col(name))).where(F.col("name_key") != "")
    stored = known.select(norm(F.col(name)).alias("name_key"))
    fields = [c for c in candidate.columns if c != "ord"]
    return first_row(rows.join(stored, "name_key", "left_anti"), ["name_key"], ["ord", *fields])


# --- comparisons ---------------------------------------------------------------------------

PROTECTED = ("program", "series", "featured_artist")


def refresh_regressions(old: DataFrame, new: DataFrame, protected: Sequence[str] = PROTECTED) -> DataFrame:
    """Ways in which a refresh would lose data, one row per problem.

    Both tables have venue, title, ord, dates and the protected text fields. Titles are
    compared trimmed and lower-cased, the last row of a title counts.
    """
    def length(name: str) -> Column:
        return F.length(F.trim(F.coalesce(name, F.lit(""))))

    def keyed(df: DataFrame, is_new: bool) -> DataFrame:
        row = F.struct("title", "dates", F.array(*[length(f) for f in protected]).alias("lengths"))
        return df.select("venue", F.lower(F.trim("title")).alias("title_key"), "ord", F.lit(is_new).alias("new"), row.alias("row")).where(
            F.col("venue").isNotNull() & (F.col("title_key") != ""))

    counts = old.groupBy("venue").agg(F.count("*").alias("n"))
    kept = new.select("venue").distinct()
    emptied = counts.join(kept, "venue", "left_anti")
    whole = emptied.select("venue", F.lit(None).cast("string").alias("title"), F.concat(
        F.lit("would drop all "), F.col("n").cast("string"), F.lit(" events")).alias("problem"))

    # Old and new rows of a title meet in one aggregate. Texts are only compared by their length, so that no more is moved.
    def last(of_new: Column) -> Column:
        return F.max_by("row", F.when(of_new, F.col("ord")))

    both = keyed(old, False).unionByName(keyed(new, True)).groupBy("venue", "title_key").agg(
        F.bool_or(~F.col("new")).alias("was"), last(~F.col("new")).alias("a"), last(F.col("new")).alias("b")).where("was")
    both = both.select("venue", F.col("a.title").alias("title"), "a", "b")
    gone = F.col("b").isNull()
    lost = F.array_sort(F.array_except("a.dates", "b.dates"))
    checks = [F.when(F.size(lost) > 0, F.concat(F.lit("lost dates "), F.array_join(lost, ", ")))]
    for i, f in enumerate(protected):
        x, y = (F.coalesce(F.col(side)["lengths"][i], F.lit(0)) for side in ("a", "b"))
        checks.append(F.when((x > 0) & (y == 0), F.lit(f"blanked {f}")).when((x > 0) & (y < F.floor(x / 2)), F.concat(
            F.lit(f"{f} shrank from "), x.cast("string"), F.lit(" to "), y.cast("string"))))
    # a title can only be gone from a venue that is still there; where it is not gone the venue is
    vanished = both.where(gone).select("venue", "title", F.lit("disappeared").alias("problem")).join(kept, "venue", "left_semi")
    both = both.where(~gone)
    rows = both.select("venue", "title", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))
    return whole.unionByName(vanished).unionByName(rows)


def pair_score(a: Column, b: Column) -> Column:
    """Likeness of two listings, given as structs with title, date and time.

    1.0 for an equal title, date and time; where one title contains the other 0.9 on the same
    date and time, 0.7 on the same date and else 0.4; 0.0 otherwise. Titles are compared
    trimmed and lower-cased, blank ones are like nothing, and a null counts as empty.
    """
    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    x, y = F.lower(F.trim(text(a["title"]))), F.lower(F.trim(text(b["title"])))
    day, hour = text(a["date"]) == text(b["date"]), text(a["time"]) == text(b["time"])
    return (
        F.when((x == "") | (y == "") | ~(F.contains(x, y) | F.contains(y, x)), 0.0)
        .when((x == y) & day & hour, 1.0).when(day & hour, 0.9).when(day, 0.7).otherwise(0.4)
    )


def similar_pairs(listing: DataFrame, key: str = "ord", least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of listings with a score of ``least`` (0.9, 0.7 or 0.4) or more.

    Listings of one title, date and time are a class under its smallest key; ``members`` has
    every listing's key and class. Two listings of a class score 1.0 and are not listed pair
    by pair. ``pairs`` has (a, b, score) of every two classes, once with a < b, so that a
    one-word title on many listings costs one pair per class and none per listing. Titles
    are compared trimmed and lower-cased, blank ones are like nothing, nulls count as empty.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = listing.select(key, F.lower(F.trim(text("title"))).alias("title"), text("date").alias("date"), text("time").alias("time")).where(F.col("title") != "")
    slot = ["date", "time"] if least > 0.7 else ["date"] if least > 0.4 else []
    classes = written(rows.groupBy("title", "date", "time").agg(F.min(key).alias("class")), "listing-classes")
    members = rows.join(classes, ["title", "date", "time"]).select(key, "class")
    titles = classes.select(F.col("title").alias("text")).distinct()
    inside = containing(titles, titles.withColumnRenamed("text", "needle")).toDF("title", "short")
    if "time" in slot:
        inside = inside.where("title <> short")  # equal titles on one date and time are one class
    long, short = classes.join(inside, "title").alias("x"), classes.withColumnRenamed("title", "short").alias("y")
    day, hour = F.col("x.date") == F.col("y.date"), F.col("x.time") == F.col("y.time")
    same = F.col("x.short") == F.col("y.short")
    for c in slot:
        same &= F.col(f"x.{c}") == F.col(f"y.{c}")
    # classes of one title meet once, from the side of the smaller key
    once = (F.col("x.title") != F.col("x.short")) | (F.col("x.class") < F.col("y.class"))
    pairs = long.join(short, same & once).select(
        F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"),
        F.when(day & hour, 0.9).when(day, 0.7).otherwise(0.4).alias("score"))
    return pairs, members


def similarity(listing: DataFrame) -> DataFrame:
    """How closely listings resemble each other, per (title, date, time).

    Tiers: ``same`` 1.0 equal title, date and time; ``near`` 0.9 one title contains the
    other, same date and time; ``day`` 0.7 the same date; ``title`` 0.4 any date. Each
    column counts the other listings in that tier; ``best`` is the highest tier reached.
    Partners are counted through per-title totals, never listed pair by pair: each title
    looks up, or adds to, only the titles it contains.
    """
    rows = listing.select(F.lower(F.trim("title")).alias("title"), "date", "time").where(F.col("title") != "")
    # all three tiers are read from these counts and from the title pairs, which are made once
    ensure_checkpoint_dir(listing.sparkSession)
    groups = rows.groupBy("title", "date", "time").agg(F.count("*").alias("n")).checkpoint()
    titles = groups.select(F.col("title").alias("text")).distinct()
    pairs = containing(titles, titles.withColumnRenamed("text", "needle")).select(
        F.col("text").alias("long"), F.col("needle").alias("short")).where("long <> short").checkpoint()

    def partners(level: Sequence[str], name: str) -> DataFrame:
        totals = groups.groupBy("title", *level).agg(F.sum("n").alias("c"))
        # A longer title looks up the titles inside it ...
        down = totals.withColumnRenamed("title", "long").drop("c").join(pairs, "long").join(
            totals.withColumnRenamed("title", "short"), ["short", *level]).select(F.col("long").alias("title"), *level, "c")
        # ... and is counted by each of them.
        up = totals.withColumnRenamed("title", "long").join(pairs, "long").select(F.col("short").alias("title"), *level, "c")
        return totals.unionByName(down).unionByName(up).groupBy("title", *level).agg(F.sum("c").alias(name))

    out = groups.join(partners(["date", "time"], "_dt"), ["title", "date", "time"])
    out = out.join(partners(["date"], "_d"), ["title", "date"]).join(partners([], "_t"), "title")
    out = out.select(
        "title", "date", "time", "n",
        (F.col("n") - 1).alias("same"), (F.col("_dt") - F.col("n")).alias("near"),
        (F.col("_d") - F.col("_dt")).alias("day"), (F.col("_t") - F.col("_d")).alias("other_day"),
    )
    best = F.when(F.col("same") > 0, 1.0).when(F.col("near") > 0, 0.9).when(F.col("day") > 0, 0.7).when(
        F.col("other_day") > 0, 0.4).otherwise(0.0)
    return out.withColumn("best", best)


# --- enrichment ------------------------------------------------------------------------------

def attach_dossier(event: DataFrame, person_fact: DataFrame, film_fact: DataFrame) -> DataFrame:
    """Fact lines of every event: the director and film facts, or up to two composers and the artist.

    Needs type, title, release_year, director, composers, featured_artist.
    """
    film = F.col("type").isin("movie", "screening")
    music = F.col("type").isin("concert", "opera")
    names = F.when(film, F.array("director")).when(
        music, F.concat(F.slice(F.coalesce("composers", F.array().cast("array<string>")), 1, 2), F.array("featured_artist")))
    roles = F.when(film, F.array(F.lit("Director"))).when(music, F.array(F.lit("Composer"), F.lit("Composer"), F.lit("Featured Artist")))
    asked = event.select("event_key", F.size(names).alias("n_names"), F.posexplode(names).alias("slot", "name"))
    facts = asked.where(nonblank(F.col("name"))).join(person_fact.withColumnRenamed("extract", "fact"), "name")
    # At most three lines per event reach this aggregate.
    lines = facts.groupBy("event_key").agg(F.array_sort(F.collect_list(F.struct(
        "slot", (F.col("n_names") - 1).alias("last"), "name", F.substring("fact", 1, 300).alias("fact")))).alias("_facts"))
    film_side = film_fact.select("title", "release_year", F.col("rating").alias("_film_rating"), F.col("excerpt").alias("_excerpt"))
    out = event.withColumn("_roles", roles).join(lines, "event_key", "left").join(film_side, ["title", "release_year"], "left")

    def label(x: Column) -> Column:
        return F.when(F.col("type").isin("movie", "screening"), "Director").when(x["slot"] == x["last"], "Featured Artist").otherwise(
            F.concat(F.lit("Composer "), x["name"]))

    people = F.transform(F.coalesce("_facts", F.array().cast(
        "array<struct<slot:int,last:int,name:string,fact:string>>")), lambda x: F.concat(label(x), F.lit(": "), x["fact"], F.lit("…")))
    film_lines = F.array(
        F.when(film & F.col("_film_rating").isNotNull(), F.concat(F.lit("Viewer rating: "), F.col("_film_rating").cast("string"), F.lit("/5"))),
        F.when(film & nonblank(F.col("_excerpt")), F.concat(F.lit("Popular review: "), F.substring("_excerpt", 1, 200), F.lit("…"))),
    )
    all_lines = F.filter(F.concat(people, film_lines), lambda x: x.isNotNull())
    return out.withColumn("dossier", F.array_join(all_lines, "\n")).drop("_roles", "_facts", "_film_rating", "_excerpt")


def attach_policy(listing: DataFrame, policy: DataFrame, labels: Sequence[str] = CATEGORIES) -> DataFrame:
    """Category of a listing by its venue's policy.

    Classification on: left open. Off: the assumed category, if it is an allowed label.
    """
    side = policy.select("venue", "classify", "assumed")
    joined = listing.join(side, "venue", "left")
    assumed = F.when(F.col("assumed").isin(list(labels)), F.col("assumed"))
    return joined.withColumn("event_category", F.when(~F.coalesce("classify", F.lit(True)), assumed)).withColumn(
        "to_classify", F.coalesce("classify", F.lit(True))).drop("classify", "assumed")


def cross_links(event: DataFrame, venue_page: DataFrame, person_page: DataFrame, person: str = "person") -> DataFrame:
    """Links from an event to the venue and person pages that exist."""
    from showbill.functions.text import plain_name
    from showbill.values import ROLE_OF_TYPE

    venues = event.select("event_key", F.lit("venue").alias("kind"), slug(F.col("venue"), "cross").alias("slug"))
    people = event.where(F.col("type").isin(list(ROLE_OF_TYPE))).select(
        "event_key", F.lit("person").alias("kind"), slug(plain_name(F.col(person)), "cross").alias("slug"))
    venues = venues.where(F.col("slug") != "").join(venue_page.select("slug"), "slug", "left_semi")
    people = people.where(F.col("slug") != "").join(person_page.select("slug"), "slug", "left_semi")
    return venues.unionByName(people)


def lost_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the old table that the new one does not have."""
    return old.select(*keys).distinct().join(new.select(*keys), list(keys), "left_anti")


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
