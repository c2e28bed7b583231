"""Files in and out, replies, and the model seam."""

import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from showbill.operators import publish as PB
from showbill.plans import refresh
from showbill.sources import pages as P
from showbill.sources import responses as RS
from showbill.sources import schedules as SC
from showbill.sources import season as SE
from showbill.sources import sinks as SK
from showbill.values import MONTHS_LONG


def test_season_file(spark, tmp_path):
    payload = {"lastUpdated": "x", "season": "2025-26", "hall": [
        {"title": "A", "dates": ["2026-01-01", "2026-01-02"], "times": ["7:00 PM"]}, {"title": "B", "dates": ["2026-01-03"], "times": []}],
        "opera": [{"title": "C", "dates": ["2026-02-01", "2026-02-02"], "times": [], "type": "opera", "composers": ["V"]}]}
    (tmp_path / "season.json").write_text(json.dumps(payload, indent=1))
    registry = spark.createDataFrame(
        [("hall", "Hall", "https://h", "concert", "", "8:00 PM", "Here", True), ("opera", "House", "https://o", "concert", "dance", "7:30 PM", "There", False)],
        "venue_key string, venue string, base_url string, default_type string, assumed_type string, default_time string, default_location string, expand boolean")
    got = SE.season_events(SE.read_season(spark, str(tmp_path)), registry)
    rows = {(r["title"], tuple(r["dates"]), tuple(r["times"]), r["type"], r["season"]) for r in got.collect()}
    assert rows == {
        ("A", ("2026-01-01",), ("7:00 PM",), "concert", "2025-26"), ("A", ("2026-01-02",), ("7:00 PM",), "concert", "2025-26"),
        ("B", ("2026-01-03",), ("8:00 PM",), "concert", "2025-26"),
        ("C", ("2026-02-01", "2026-02-02"), ("7:30 PM", "7:30 PM"), "opera", "2025-26")}


def test_published_list_must_be_an_array(spark, tmp_path):
    (tmp_path / "good.json").write_text('\n [{"id": "a", "title": "A", "rating": 7, "screenings": [{"date": "2026-01-01"}]}, {"id": "b"}]')
    (tmp_path / "bad.json").write_text('{"id": "a"}')
    assert sorted(r["id"] for r in SE.load_published(spark, str(tmp_path / "good.json")).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="not a JSON array"):
        SE.load_published(spark, str(tmp_path / "bad.json")).collect()


def test_schedule_files(spark, tmp_path):
    (tmp_path / "april-2026.md").write_text("Apr 1\tJaws\nApr 2\tPolar Night! (live event)\nnope\n")
    got = SC.schedule_table(SC.split_lines(SC.read_texts(spark, str(tmp_path))))
    assert sorted((r["title"], r["date"], r["live"]) for r in got.collect()) == [("Jaws", "2026-04-01", False), ("Polar Night!", "2026-04-02", True)]


def sequential_schedule(text):
    """The rule spelled out line by line: headings hold until the next one."""
    months = {m.lower(): i for i, m in enumerate(MONTHS_LONG, 1)}
    year = month = day = None
    out = []
    for line in text.split("\n"):
        if hit := re.match(r"^##\s+([A-Za-z]+)\s+(\d{4})\s*$", line):
            month, year = months.get(hit[1].lower()), int(hit[2])
        elif hit := re.match(r"^###\s+(?:Thursday|Friday|Saturday),?\s+([A-Za-z]+)\s+(\d{1,2})\s*$", line):
            month, day = months.get(hit[1].lower(), month), int(hit[2])
        elif (hit := re.match(r"^- \*\*(\w+)\*\* — (.*)$", line)) and year and month and day:
            out += [(hit[1], f"{year}-{month:02d}-{day:02d}", t.strip()) for t in hit[2].split(",")]
    return out


def test_headings_hold_until_the_next_one(spark):
    lines = ["## April 2026", "### Thursday, April 30", "- **ONE** — 6:00 PM", "### Friday May 1", "- **TWO** — 7:15 PM, 9:00 PM", "## Notes",
             "- **THREE** — 1:00 PM", "## June 2026", "- **FOUR** — 2:00 PM", "### Saturday, Juni 6", "- **FIVE** — 3:00 PM", "## Brumaire 2027",
             "- **SIX** — 4:00 PM", "### Thursday, July 1", "- **SEVEN** — 5:00 PM", "### Friday, Julius 2", "- **EIGHT** — 5:00 PM"]
    rnd = random.Random(3)
    texts = ["\n".join(lines)] + ["\n".join(rnd.sample(lines, len(lines))) for _ in range(20)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string")
    got = sorted((r["doc"], r["title"], r["date"], r["time_12"]) for r in SC.schedule_doc(docs).collect())
    assert got == sorted((str(i), *row) for i, t in enumerate(texts) for row in sequential_schedule(t))


def test_headings_hold_over_ranges_of_lines(spark):
    rnd = random.Random(5)
    months, days = ["April 2026", "June 2026", "Brumaire 2027"], ["Thursday, April 30", "Saturday, Juni 6", "Friday, May 1"]

    def line(i):
        kind = rnd.random()
        return f"## {rnd.choice(months)}" if kind < 0.002 else f"### {rnd.choice(days)}" if kind < 0.004 else f"- **T{i}** — 6:00 PM, 7:15 PM"

    texts = ["\n".join(line(i) for i in range(n)) for n in (6000, 1, 0, 40, 3000, 2)]
    rows = [(str(i), pos, x) for i, t in enumerate(texts) for pos, x in enumerate(t.split("\n"))] + [(None, 1, "## June 2026"), ("0", None, "- **X** — 6:00 PM"), ("1", 9, None)]
    lines = spark.createDataFrame(rows, "doc string, pos int, line string").repartition(5)
    want = sorted((str(i), *row) for i, t in enumerate(texts) for row in sequential_schedule(t))
    assert len(want) > 10000
    assert sorted((r["doc"], r["title"], r["date"], r["time_12"]) for r in SC.schedule_lines(lines).collect()) == want
    same_name = spark.createDataFrame([("d", texts[0]), ("d", texts[4]), ("d", None)], "doc string, text string")
    assert SC.schedule_doc(same_name).count() == sum(len(sequential_schedule(texts[i])) for i in (0, 4))
    assert SC.schedule_lines(lines.limit(0)).count() == 0


def test_digest_archive_and_manifest(spark, tmp_path):
    weekly = tmp_path / "site" / "weekly"
    weekly.mkdir(parents=True)
    (weekly / "2026-W18.html").write_text('<meta name="description" content="12 top picks">')
    (weekly / "2026-W19.html").write_text('<li class="weekly-pick">a</li>')
    (weekly / "2026-W60.html").write_text("x")
    (tmp_path / "site" / "index.html").write_text("x")
    (tmp_path / "site" / "secret.html").write_text("x")
    archive = SC.digest_archive(spark, str(weekly)).collect()
    assert [(r["label"], r["picks"]) for r in archive] == [("2026-W19", 1), ("2026-W18", 12)]
    pages = SC.page_manifest(spark, str(tmp_path / "site"), "https://x.org/").collect()
    assert [r["url"] for r in pages] == ["https://x.org/"] + [f"https://x.org/weekly/2026-W{w}.html" for w in (18, 19, 60)]


def test_documents_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "", "n")], "event_key int, slug string, v string")
    path = str(tmp_path / "docs")
    SK.write_documents(rows, path, shard_rows=1)
    assert [r["v"] for r in SK.read_document(spark, path, "a").collect()] == ["x"]
    SK.write_documents(rows.where("slug = 'b'"), path, shard_rows=1)
    assert SK.read_document(spark, path, "a").count() == 0
    SK.publish(rows, str(tmp_path / "set"), "one")
    SK.publish(rows.limit(1), str(tmp_path / "set"), "two")
    assert SK.read_current(spark, str(tmp_path / "set")).count() == 1


def test_two_writers_get_one_version_each(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    import pytest

    from showbill.sources import versions as V

    root = str(tmp_path / "set")
    sets = [spark.range(i + 1) for i in range(6)]
    with pytest.raises(ValueError):
        V.read(spark, root)
    assert V.commit(sets[0], root, base=0) == 1
    held = V.read(spark, root, 1)
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda df: V.commit(df, root), sets[1:5]))
    assert sorted(got) == [2, 3, 4, 5] == V.log(spark, root)[1:]
    assert all(V.read(spark, root, v).count() == i + 2 for i, v in enumerate(got))

    def against(df):
        try:
            return V.commit(df, root, base=5)
        except V.VersionTaken:
            return None

    with ThreadPoolExecutor(3) as pool:  # all three were made from version 5
        assert sorted(pool.map(against, sets[:3]), key=str) == [6, None, None]
    assert len(list((tmp_path / "set/data").iterdir())) == 6  # the losers' data are gone
    assert held.count() == 1
    assert V.retain(spark, root, 2) == [1, 2, 3, 4] and V.log(spark, root) == [5, 6]
    assert V.commit(sets[5], root) == 7 and V.read(spark, root).count() == 6
    for version in (1, 9):
        with pytest.raises(ValueError):
            V.read(spark, root, version)


def test_an_empty_set_is_a_version(spark, tmp_path):
    root = str(tmp_path / "set")
    SK.publish(spark.range(3).limit(0), root, "a")
    assert SK.read_current(spark, root).columns == ["id"] and SK.read_current(spark, root).count() == 0


def test_calendar_files(spark, tmp_path):
    title = "A long title, of many words; " * 5 + "é" * 60
    rows = spark.createDataFrame([("e", "u1", title, "v", "", "Movie", "x\ny")], "event_id string, uid string, summary string, venue string, url string, tags string, details string")
    at = F.lit("2024-01-15 20:00:00").cast("timestamp_ntz")
    blocks = PB.calendar_text(rows.withColumns({"start_utc": at, "end_utc": at}), "20240101T000000Z")
    SK.write_calendar(blocks, str(tmp_path / "cal"), "All; " + "c" * 90)
    raw = b"".join(p.read_bytes() for d in ("head", "events", "tail") for p in sorted((tmp_path / "cal" / d).glob("part-*")))
    lines = raw.split(b"\r\n")
    assert lines.pop() == b"" and all(len(line) <= 75 and b"\n" not in line for line in lines)
    whole = raw.decode().replace("\r\n ", "").split("\r\n")
    assert whole[0] == "BEGIN:VCALENDAR" and whole[1].startswith("PRODID:") and whole[-2] == "END:VCALENDAR" and "X-WR-CALNAME:All\\; " + "c" * 90 in whole
    assert "DTSTAMP:20240101T000000Z" in whole and "DTSTART:20240115T200000Z" in whole and "DESCRIPTION:x\\ny" in whole
    assert "SUMMARY:" + title.replace(",", "\\,").replace(";", "\\;") in whole


def test_one_calendar_per_slug(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("", 3, "n"), (None, 4, "n")], "event_id string, event_key long, uid string")
    assert sorted(r["uid"] for r in PB.first_events(rows).collect()) == ["y", "z"]


def test_text_lines_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"line {i:03d}") for i in range(50)], "i int, line string").repartition(4)
    SK.write_lines(rows, str(tmp_path / "dump"), F.col("i"))
    parts = sorted((tmp_path / "dump").glob("part-*"))
    assert [x for p in parts for x in p.read_text().splitlines()] == [f"line {i:03d}" for i in range(50)]


def test_replies():
    cut = '{"events": [{"title": "A"}, {"title": "B", "dates": ["x"], "n'
    assert RS.first_object("Sure:\n```json\n{\"a\": {\"b\": 1}}\n``` bye {") == {"a": {"b": 1}}
    assert RS.first_object(cut) == {"events": [{"title": "A"}, {"title": "B", "dates": ["x"]}]}
    assert RS.first_object('{"events": [{"t": "}] {"}, {"t": "un') == {"events": [{"t": "}] {"}]}
    assert RS.first_object("none") is None and RS.first_object(None) is None and RS.first_object('{"a": "b') is None
    assert RS.entries({"note": [1], "shows": [{"t": 1}, 2]}) == ['{"t": 1}']
    assert RS.entries({"events": [], "results": [{"t": 1}]}) == ['{"t": 1}']
    assert RS.entries([1]) == []


def test_model_seam_marks_only_its_own_failures(spark):
    def fn(prompts: pd.Series) -> pd.Series:
        if (prompts == "bad").any():
            raise RuntimeError("no")
        return prompts.str.upper()

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(6)], "event_key int, prompt string")
    got = {r["event_key"]: (r["content"], r["error"]) for r in RS.run_model(rows, fn, partitions=2, batch=1).collect()}
    assert got[3] == (None, "RuntimeError: no") and got[1] == ("P1", None)


def test_logged_calls_are_never_repeated(spark, tmp_path):
    from showbill.sources import calls as CL

    log, seen = str(tmp_path / "log"), tmp_path / "seen"
    seen.mkdir()

    def fn(prompts, broken=("bad",)):
        import uuid as u

        for p in prompts:
            (seen / f"{p}-{u.uuid4().hex}").write_text("")
        if any(p in broken for p in prompts):
            raise RuntimeError("no")
        return prompts.str.upper()

    def asked():
        return sorted(f.name.rsplit("-", 1)[0] for f in seen.iterdir())

    rows = spark.createDataFrame([(i, f"p{i % 4}") for i in range(8)] + [(8, "bad"), (9, None)], "event_key int, prompt string")
    first = {r.event_key: tuple(r)[1:] for r in CL.run_logged(rows, fn, log, "m", buckets=3, tries=2, pause=0.01).collect()}
    assert first == {i: (f"P{i % 4}", None, True) for i in range(8)} | {8: (None, "RuntimeError: no", False), 9: (None, None, False)}
    assert asked() == ["bad", "bad", "p0", "p1", "p2", "p3"]  # equal prompts once, the failing one twice
    more = rows.union(spark.createDataFrame([(10, "p9")], rows.schema))
    again = {r.event_key: tuple(r)[1:] for r in CL.run_logged(more, lambda x: fn(x, ()), log, "m", buckets=3, pause=0.01).collect()}
    assert again[0] == ("P0", None, False) and again[8] == ("BAD", None, True) and again[10] == ("P9", None, True)
    assert asked() == ["bad"] * 3 + ["p0", "p1", "p2", "p3", "p9"]
    assert CL.run_logged(rows.limit(1), fn, log, "other model", buckets=3).first().asked  # another model is another call
    CL.compact_calls(spark, log, str(tmp_path / "small"))
    assert CL.read_calls(spark, str(tmp_path / "small")).count() == CL.read_calls(spark, log).count() == 7


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    import os

    import pytest

    from showbill.sources import calls as CL

    log, calls = str(tmp_path / "log"), tmp_path / "calls"
    calls.mkdir()

    def dying(prompts):
        import uuid as u

        if len(list(calls.iterdir())) >= 5:
            os._exit(1)  # the worker is lost, with no chance to clean up
        (calls / u.uuid4().hex).write_text("")
        return prompts.str.upper()

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "event_key int, prompt string")
    with pytest.raises(Exception):  # noqa: B017
        CL.run_logged(rows, dying, log, "m", buckets=1)
    assert CL.read_calls(spark, log).count() == 5
    out = CL.run_logged(rows, lambda p: p.str.lower(), log, "m", buckets=1).collect()
    assert sum(r.asked for r in out) == 7 and sorted(r.content for r in out)[:5] == sorted(r.content for r in out if not r.asked)


def test_an_outage_ends_soon(spark, tmp_path):
    from showbill.sources import calls as CL

    def down(prompts):
        raise OSError("down")

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "event_key int, prompt string")
    out = CL.run_logged(rows, down, str(tmp_path / "log"), "m", buckets=1, tries=1, budget=4).collect()
    assert sorted(r.error for r in out) == ["OSError: down"] * 4 + ["not asked: too many failures"] * 26
    assert CL.run_logged(rows.limit(0), down, str(tmp_path / "log"), "m").count() == 0


def test_parser_follows_nesting(spark):
    html = '<div class="item">a<div>b<div>c</div></div>d</div><div class="item x"><b>e</b></div><p class="item">f</p>'
    got = P.parse_blocks(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "div", "item").collect()
    assert [(r["id"], r["pos"], r["text"]) for r in got] == [(1, 0, "a b c d"), (1, 1, "e")]


def test_refresh_is_written_only_without_losses(spark, tmp_path):
    schema = "ord int, title string, venue_name string, venue string, dates array<string>, times array<string>, composers array<string>, works array<string>, program string, series string, featured_artist string, type string"
    row = (1, "A", "hall", "hall", ["2026-01-01"], ["19:00"], [], [], "prose", "s", "", "concert")
    stored = spark.createDataFrame([row], schema)
    better = spark.createDataFrame([row[:4] + (["2026-01-01", "2026-01-02"], ["19:00", "19:00"]) + row[6:]], schema)
    worse = spark.createDataFrame([row[:8] + ("", "s", "", "concert")], schema)
    root = str(tmp_path / "season")
    assert refresh.commit_refresh(*refresh.check_refresh(stored, better, "concert", None), root, "1")
    assert not refresh.commit_refresh(*refresh.check_refresh(stored, worse, "concert", None), root, "2")
    assert SK.read_current(spark, root).select(F.size("dates")).first()[0] == 2


def test_pages_with_other_quotes_and_nesting(spark):
    article = ("<article class='x eventlist-event'><h1><a class=eventlist-title-link href='/e/1'>Night</a></h1>"
               "<time class='event-date' datetime=1998-06-16>x</time><time class=event-time-localized-start>7:00 PM</time>"
               "<div class='eventlist-excerpt'><div>one</div><div>two <div>three</div></div> four</div></article>")
    row = P.articles_from_pages(spark.createDataFrame([(1, article)], "k int, html string"), "https://x.org").first()
    assert (row.title, row.url, row.date, row.description) == ("Night", "https://x.org/e/1", "1998-06-16", "one two three four")

    film = ("<h1>Film</h1><div class='c-screening-content'><div>a</div> b</div><div id='showtime-19980616' class=c>"
            "<div><a class='c-button'>1:00 PM</a></div><div><div><a class=c-button>2:00 PM</a></div></div></div>"
            "<div><a class='c-button'>9:00 PM</a></div>")
    rows = P.film_page_screenings(spark.createDataFrame([(1, film)], "k int, html string")).orderBy("slot").collect()
    assert [(r.date, r.time, r.description) for r in rows] == [("1998-06-16", "1:00 PM", "a b"), ("1998-06-16", "2:00 PM", "a b")]

    series = "<h2 class='bm-txt-1'>Voyage</h2><h2 class=t>Upcoming</h2><p>Tuesday, June 16 - Emma by Jane</p>"
    details = spark.createDataFrame([], "series string, time string, host string, note string")
    row = P.series_entries(spark.createDataFrame([(1, series)], "page_id int, html string"), details, "1998-06-15").first()
    assert (row.series, row.book, row.author, row.date) == ("Voyage", "Emma", "Jane", "1998-06-16")

    links = spark.createDataFrame([("http://h.org/a", "<a href='/e1'>x</a><A class=b href=/e2>y</A><a data-href='/e3'>z</a><a href=\"/e4\">")], "url string, html string")
    assert {r.link for r in P.discover_links(links, "/e").collect()} == {f"http://h.org/e{i}" for i in (1, 2, 4)}


def test_empty_and_unclosed_elements(spark):
    rows = spark.createDataFrame([("<div class='a'></div>x",), ("<div class=a>open <div>in</div> on",), ("<p>none</p>",), (None,)], "html string")
    texts = [r[0] for r in rows.select(P.element(F.col("html"), "div", "a")).collect()]
    assert texts == [None, "open <div>in</div> on", None, None]


def test_answers_to_a_frame_are_handed_on_as_one_frame():
    calls = []

    def fn(prompts):
        calls.append(len(prompts))
        if "bad" in prompts.tolist():
            raise RuntimeError("no")
        return prompts.str.upper()

    frame = pd.DataFrame({"k": [1, 2, 3, 4, 5], "prompt": ["a", "b", "bad", "c", "d"]})
    out = list(RS._answered(iter([frame, frame]), fn, "k", 2))
    assert calls == [2, 2, 1] * 2 and len(out) == 2
    assert out[0]["content"].tolist() == ["A", "B", None, None, "D"]
    assert out[0]["error"].tolist() == [None, None, "RuntimeError: no", "RuntimeError: no", None]
    with pytest.raises(ValueError):
        list(RS._answered(iter([frame]), lambda prompts: prompts[:0], "k", 2))


def test_prospects_of_whole_documents_equal_those_of_their_lines(spark):
    texts = ["- [ ] a (x)\nBEGIN\n- [x] b (y) — see https://a.org/b\r\nno\nEND\n- [ ] c (z)", "BEGIN\nEND\n- [ ] d (x)", "END\nBEGIN\n- [ ] e (x)",
             "- [ ] f (x)\nEND", "BEGIN\n- [ ] g (x)", "BEGIN END\n- [ ] h (x)\nEND", "BEGIN\n- [ ] BEGIN i (x)\nEND\nEND", "", None]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc int, text string")
    for markers in (("BEGIN", "END"), None):
        whole = SC.prospect_docs(docs, "doc", markers)
        assert sorted(whole.collect(), key=str) == sorted(SC.prospect_bullets(SC.split_lines(docs), "doc", markers).collect(), key=str)
        assert whole.count() > 0 and "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_dealt_rows_are_the_same_in_even_tasks(spark, sf_dir):
    from showbill.sources import tables as T

    rows = T.dealt(spark, sf_dir, "lineitem")
    plain = T.table(spark, sf_dir, "lineitem")
    assert rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert max(sizes) < 3 * sum(sizes) / rows.rdd.getNumPartitions()
