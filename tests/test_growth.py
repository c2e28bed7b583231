"""Work that must not grow with copies, repeated readings or uneven files."""

import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as contract
from showbill.functions import dates as D
from showbill.operators import joins as J
from showbill.operators import normalize as N
from showbill.operators import scale
from showbill.plans import publish, refresh
from showbill.sources import pages, responses, schedules
from showbill.streaming.state import Silence


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_dense_listings_are_settled_without_groups(spark, monkeypatch):
    def no_groups(links):
        raise AssertionError("groups were sought")

    monkeypatch.setattr(J, "connected", no_groups)
    shows = spark.range(400).select(F.format_string("%04d", "id").alias("ord"), (F.col("id") % 5).cast("string").alias("showing_key"))
    got = J.new_listings(shows, spark.createDataFrame([], "showing_key string"))
    assert sorted(r["ord"] for r in got.collect()) == [f"{i:04d}" for i in range(5)]


def test_a_listing_is_held_for_one_result(spark):
    rows = spark.createDataFrame([("1", "A", "movie", ["d"], ["t"], "v", "u"), ("2", "A", "movie", ["e"], ["t"], "w", "u"), ("3", "B", "dance", ["d"], ["t"], "v", "u")],
                                 "ord string, title string, type string, dates array<string>, times array<string>, venue string, url string")
    events, shows = publish.group_listings(rows, ["title", "venue"])
    assert sorted((r["group_key"], r["venue"]) for r in events.collect()) == [("A", "v"), ("B - d t", "v")]
    assert shows.count() == 3 and re.search(r"hashpartitioning\(group_key#\d+, \d+\)", plan(events))


def test_rows_are_judged_once(spark):
    rows = spark.createDataFrame([("1", "k", "A", ["2026-05-01"], ["19:00"])], "ord string, venue_key string, title string, dates array<string>, times array<string>")
    venues = spark.createDataFrame([("k", "Hall", None, False, None, "u")], "venue_key string, venue_name string, category string, preserve_venue_name boolean, default_time string, page_url string")
    assert all("venue-rows" in f for f in N.venue_rows(rows, venues, "2026-04-01").inputFiles())
    none = F.lit(None).cast("array<string>")
    season = rows.select("ord", "title", "dates", "times", F.lit("Hall").alias("venue_name"), F.lit("").alias("venue"), none.alias("composers"), none.alias("works"),
                         *[F.lit("x").alias(c) for c in ("program", "series", "featured_artist")], F.lit("dance").alias("type"))
    stored = season.drop("venue").withColumnRenamed("venue_name", "venue")
    named, problems = refresh.check_refresh(stored, season, "dance", None)
    assert all("season-rows" in f for f in named.inputFiles()) and problems.count() == 0


def test_regressions_move_no_texts(spark):
    rows = spark.createDataFrame([("1", "v", "A", ["d"], "p" * 9, "", "")], "ord string, venue string, title string, dates array<string>, program string, series string, featured_artist string")
    assert "program, program" not in plan(J.refresh_regressions(rows, rows))
    gone = J.refresh_regressions(rows, rows.withColumn("program", F.lit(""))).collect()
    assert [r["problem"] for r in gone] == ["blanked program"]


def test_documents_stay_in_their_rows(spark):
    docs = spark.createDataFrame([("d", "## May 2026\n### Friday, May 1\n- **A\u0085- **B** - 7:00 PM, 99:15 pm\n- **C D** - 1:00 am")], "doc string, text string")
    out = schedules.schedule_doc(docs)
    assert "Exchange" not in plan(out) and sorted((r["title"], r["time_24"]) for r in out.collect()) == [("B", "11:15"), ("B", "19:00"), ("C D", "01:00")]
    replies = spark.createDataFrame([("a", '{"events": [{"title": "x"}]}'), ("b", 'so: {"events": [{"title": "y"}, {"ti'), ("c", None)], "ord string, text string")
    out = responses.response_events(replies, "title:string")
    assert "Union" not in plan(out) and sorted((r["ord"], r["pos"], r["title"]) for r in out.collect()) == [("a", 0, "x"), ("b", 0, "y")]


def test_a_source_knows_its_timer():
    class Handle:
        held, timers = None, set()

        def getValueState(self, *_):
            return self

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    silence, handle = Silence(1000), Handle()
    silence.init(handle)
    silence.handleInitialState(("s",), Row(source="s", since=5_000_000), None)
    assert list(silence.handleInputRows(("s",), iter([Row(source="s", seen=7_000_000, rows=2)]), None)) == []
    assert handle.timers == {8000}
    assert list(silence.handleExpiredTimer(("s",), None, None)) == [Row(source="s", seen=7_000_000, alarm=8_000_000, rows=2)]


@pytest.mark.parametrize("name", ["s10_schedule_doc", "s11_schedule_table", "s13_response_events", "p42_standardize"])
def test_costly_rows_are_dealt_evenly(name, spark, sf_dir):
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert f"], {tasks}" in plan(contract.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["s04_articles", "s05_film_pages", "s06_club_meetings", "s07_series_entries"])
def test_parsed_values_are_bound_without_arrays(name, spark, sf_dir):
    text = plan(contract.queries()[name](spark, sf_dir))
    # an entry taken from a computed array asks for the type of its whole tree in every row
    assert "get(transform(array(" not in text and "get(filter(array(" not in text


def test_cuts_and_heads_equal_splits(spark):
    texts = ["", "x", "<h2>a<H2 b>c</h2><h2x", "a<h2><h2>\x1e<h2>z", "<<h2>$1\\<h2>", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for at in (r"<h2\b", "(?:<h2|z|c)"):
        got = rows.select(F.filter(D.cut_before(F.col("t"), at), lambda x: x != ""), F.filter(F.split("t", f"(?i)(?={at})"), lambda x: x != "")).collect()
        assert [r[0] for r in got] == [r[1] for r in got]
    got = rows.select(D.before(F.col("t"), "<h2"), F.get(F.split("t", "<h2"), F.lit(0))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_an_element_ends_at_its_own_closing_tag(spark):
    texts = {"a</div>b": "a", "a<div>b</DIV>c</div>d": "a<div>b</DIV>c", "</div>x": "", "a<div>b</div>c": "a<div>b</div>c", "a</divx></div >b": "a</divx>", "a<divx>b": "a<divx>b"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pages.inner(F.col("t"), "div").alias("x"))
    assert {r["t"]: r["x"] for r in rows.collect()} == texts


def test_listings_move_as_numbers_after_the_first_round(spark, monkeypatch):
    kinds, written = {}, J.written

    def noted(df, name):
        kinds.setdefault(name, set()).update(kind for _, kind in df.dtypes)
        return written(df, name)

    monkeypatch.setattr(J, "written", noted)
    pairs = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("c", None), ("d", "k"), ("d", "w"), (None, "x"), (None, "k"), ("e", "y"), ("e", "z"), ("f", "z"), ("g", "w")]
    known = spark.createDataFrame([("k",), ("k",), (None,)], "showing_key string")
    got = [r["ord"] for r in J.new_listings(spark.createDataFrame(pairs, "ord string, showing_key string"), known).collect()]
    assert sorted(got, key=str) == [None, "a", "c", "f", "g"]
    assert kinds["listing-open"] == {"bigint"} and [n for n, k in kinds.items() if "string" in k] == ["listing-numbers", "listing-first"]


def test_a_written_table_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    held, before = spark.conf.get(setting, None), shuffled()
    rows = scale.written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "sevens")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(setting, None) == held and rows.count() == 7
