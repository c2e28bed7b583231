"""Parse and text rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from showbill.functions import clock as C
from showbill.functions import dates as D
from showbill.functions import facts as A
from showbill.functions import review as R
from showbill.functions import text as X
from showbill.sources import pages as P

x = None  # the input column; columns can only be made once a session runs


@pytest.fixture(autouse=True, scope="module")
def input_column(spark):
    global x
    x = F.col("x")


def values(spark, cases, col):
    """Results of a column over the inputs of (input, expected) cases, in their order."""
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, x string")
    got = rows.select("i", col.alias("y")).orderBy("i").collect()

    def plain(v):
        return tuple(v) if isinstance(v, tuple) else v

    return [plain(r["y"]) for r in got]


def check(spark, cases, col):
    assert values(spark, cases, col) == [want for _, want in cases]


def test_normalize_date(spark):
    check(spark, [
        ("2026-02-03", "2026-02-03"), ("2026-13-45", "2026-13-45"), ("2/3/2026", "2026-02-03"), ("13/2/2026", "2026-02-13"),
        ("2026/2/3", "2026-02-03"), ("2026-2-3", "2026-02-03"), ("02/30/2026", None), ("soon", None), (None, None),
    ], D.normalize_date(x))


def test_normalize_dates_drops_unreadable(spark):
    row = spark.createDataFrame([(["1/2/2026", "soon", None, "2026-05-01"],), (None,)], "x array<string>")
    assert [r[0] for r in row.select(D.normalize_dates(x)).collect()] == [["2026-01-02", "2026-05-01"], []]


def test_normalize_time(spark):
    check(spark, [
        ("19:30", "19:30"), ("99:99", "99:99"), ("7:30 PM", "19:30"), ("7:30pm", "19:30"), ("12:05 am", "00:05"), ("9:5", "09:05"),
        ("18:00:05", "18:00"), (" 7:30  pm ", "19:30"), ("noon", "noon"), ("13:00 PM", "13:00 PM"),
    ], C.normalize_time(x))


def test_loose_time(spark):
    check(spark, [
        ("7:00 PM - 10:00 PM", "19:00"), ("6-8 pm", "18:00"), ("2 PM", "14:00"), ("18:00", "18:00"), ("12 am", "00:00"),
        ("2026-08-14", None), ("doors", None), ("", None), ("25", None), ("7:75 pm", None), (None, None), ("11am-1pm", "11:00"),
    ], C.loose_time(x))


def test_strict_and_page_times(spark):
    check(spark, [("5:15 PM", "17:15"), ("12:00 AM", "00:00"), ("17:15", None), ("5 PM", None)], C.to_24h(x))
    check(spark, [("7:30 p.m.", "19:30"), ("7 PM", "19:00"), ("19:30", "19:30"), ("7:30PM", None)], C.listing_time(x))
    check(spark, [("9:30 PM", True), ("13:00 PM", False), ("9:75 AM", False), ("9 PM", False)], C.is_clock_12h(x))
    check(spark, [("7PM", (19, 0)), ("7:30 pm", (19, 30)), ("19:30", (19, 30)), ("24:00", None), ("TBD", None)], C.clock_struct(x))


def test_partial_date_and_range(spark):
    check(spark, [("2022-09", "2022-09-01"), ("2021-04 to 2021-05", "2021-04-01"), ("2022-13", None), ("Sept", None)], D.partial_date(x))
    check(spark, [
        ("2026-07-18 to 2026-08-29", ("2026-07-18", "2026-08-29")), ("2026-07-18", ("2026-07-18", None)),
        ("July 18 - August 29, 2026", ("2026-07-18", "2026-08-29")), ("December 12 - January 15, 2026", ("2026-12-12", "2027-01-15")),
        ("Fri, Aug 14", ("2026-08-14", None)), ("Jan 15", ("2027-01-15", None)), ("on view", (None, None)),
    ], D.date_range(x, "2026-06-01"))


def test_prose_datetime(spark):
    check(spark, [
        ("Saturday, July 18, 2-4 pm", ("2026-07-18", "14:00")), ("Sunday, July 26, 2026, 1-4 pm", ("2026-07-26", "13:00")),
        ("July 16, 2026 – September 13, 2026", ("2026-07-16", "10:00")), ("January 5, 12 am", ("2027-01-05", "00:00")),
        ("Foo 5, 2 pm", (None, None)), ("July 18, noon", (None, None)),
    ], D.prose_datetime(x, "2026-06-01"))


def test_duration(spark):
    check(spark, [
        ("1h 38min", 98), ("2 hrs, 5 mins", 125), ("90 min", 90), ("105m", 105), ("1:50", 110), ("2h", 120), ("45m", 45),
        ("90", 90), ("1 h 38 m", 98), ("long", None), ("", None),
    ], C.duration_minutes(x))


def test_iso_weeks(spark):
    check(spark, [("2026-W53", "2026-12-28"), ("2025-W53", None), ("2025-W01", "2024-12-30"), ("2025-W00", None), ("x", None)],
          D.week_start(x).cast("string"))
    assert D.week_bounds("2026-W53")[0].isoformat() == "2026-12-28"
    with pytest.raises(ValueError):
        D.week_bounds("2025-W60")


def test_date_queries(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1997-01-01', DATE'1999-12-31')) AS d")

    def hits(q):
        return days.where(D.date_query(q, "1998-06-15")(F.col("d"))).count()

    assert [hits(q) for q in ("today", "1998-6-5", "6/14", "6/14/1998", "jun 14", "14 june", "June 14, 1998", "june", "feb 30", "2/30/1998")] == [
        1, 1, 3, 1, 3, 3, 1, 90, 0, 0]
    assert D.date_query("matinee", "1998-06-15") is None
    assert D.date_query("13/40", "1998-06-15") is None


def test_local_time_to_utc(spark):
    rows = spark.createDataFrame([
        ("1998-07-01", "19:30"), ("1998-01-15", "7:30 PM"), ("1997-10-26", "00:30"), ("1997-10-26", "01:30"), ("1997-10-26", "02:30")],
        "d string, t string")
    got = [str(r[0]) for r in rows.select(C.utc_of_local(C.start_local(F.col("d"), F.col("t")))).collect()]
    # 01:30 occurs twice on that day; the standard-time reading is meant.
    assert got == ["1998-07-02 00:30:00", "1998-01-16 01:30:00", "1997-10-26 05:30:00", "1997-10-26 07:30:00", "1997-10-26 08:30:00"]


def test_slugs(spark):
    cases = "Straße Café — Noël’s"
    want = {"safe": "strae-cafe-noels", "plain": "strae-cafe-noels", "event_id": "straße-café-—-noël’s",
            "file": "stra-e-caf-no-l-s", "cross": "stra-e-caf-no-l-s", "share": "stra-e-cafe-noel-s"}
    for dialect, slug in want.items():
        check(spark, [(cases, slug)], X.slug(x, dialect))
    check(spark, [("", "event"), ("***", "event"), ("日本 Night", "night"), ("ﬁn ½", "fin-12")], X.slug(x, "safe"))
    check(spark, [("", ""), ("***", "")], X.slug(x, "plain"))


def test_entities_are_decoded_once(spark):
    check(spark, [("a &amp;lt; b &eacute;&#233;&#xE9; &nope; &", "a &lt; b ééé &nope; &"), ("plain", "plain"), ("&#128512;", "😀")], X.unescape(x))


def test_html_text(spark):
    html = "<p>Hi &amp; <b>bye</b><br>now</p><!-- no --><div>x</div>"
    check(spark, [(html, "Hi & bye now x")], X.html_text(x, "visible"))
    check(spark, [("<p>a</p><p>b</p>", "a b")], X.html_text(x, "spaced"))
    check(spark, [(" <p>a</p><p>b</p>\n", "ab")], X.html_text(x, "bare"))


def test_banned_words_follow_the_listed_order(spark):
    check(spark, [
        ("a profound meditation on loss", "a deep reflection on loss"), ("HAUNTING and Lush", "memorable and rich"),
        ("it resonates deeply", "it connects deeply"), ("éclush, lushly", "éclush, lushly"), (None, None),
    ], X.replace_banned(x))


def test_titles_and_addresses(spark):
    check(spark, [("A by B by C", ("A by B", "C")), ("Just", ("Just", None)), ("Standby me", ("Standby me", None))], X.split_by_author(x))
    check(spark, [
        ("6226 Main Rd, Austin, TX 78752", ("6226 Main Rd", "Austin", "TX", "78752")), ("Austin, TX", ("", "Austin", "TX", "")),
        ("Somewhere", ("Somewhere", "", "", "")), ("1 A St, Ste 2, Waco, TX 76701-1234", ("1 A St, Ste 2", "Waco", "TX", "76701-1234")),
    ], X.address_parts(x))


def test_trims(spark):
    long = "word " * 40
    check(spark, [(long, ("word " * 27).rstrip() + "…"), ("short", "short"), ("x" * 150, "x" * 139 + "…")], X.trim_words(x))
    check(spark, [("One. " * 60, ("One. " * 48).rstrip()), ("a" * 300, "a" * 240 + "…")], X.excerpt(x))
    rows = spark.createDataFrame([("the quick brown fox jumps over it",), ("",), ("incomprehensibilities",)], "x string")
    assert [r[0] for r in rows.select(X.wrap(x, 10, 2)).collect()] == [["the quick", "brown fox…"], [""], ["incompreh…"]]


def test_scores(spark):
    check(spark, [
        ("★ Rating: [7.5/10]", 8), ("2.5/10", 2), ("3.5/10", 4), ("[9/10] then 3/10", 9), ("RATING: 4/10, 6/10", 4),
        ("99/10", 10), ("none", 5), ("", 5),
    ], R.score(x))


def test_refusals_and_confidence(spark):
    refusal = "I cannot provide a review as the search results do not contain it."
    check(spark, [(refusal, True), ("I cannot provide", False), ("A masterpiece of quiet grief, shot in one take.", False), (None, False)], R.is_refusal(x))
    check(spark, [(refusal, "low"), ("", "low"), ("A masterpiece", "high"), ("There is limited information here", "low"), (None, "low")], R.confidence(x))
    check(spark, [("See [1]. SOURCES: a\nb\n\nMore [22]", "See . \n\nMore"), ("Good. Note on sources: none", "Good.")], R.strip_sources(x))


def test_hooks(spark):
    check(spark, [
        ('"Summary: A thrilling descent into madness"', "A thrilling descent into madness"), ("Here's a summary: It moves fast", "It moves fast"),
        ("This is a long sentence about nothing", "long sentence about nothing"), ("Short", None), ("A film festival is an event", None),
        ("An analysis of grief and joy", None), ('Grief and joy in one room" This 10-word', "Grief and joy in one room"), (None, None),
    ], R.clean_hook(x))


def test_languages(spark):
    check(spark, [
        ("USA, 1994, 98min, In German, English, and Romany with English subtitles.", "German, English, Romany"),
        ("USA, 1990", "English"), ("X, 2000, In french/FRENCH", "French"),
    ], A.languages(x, F.lit("USA")))
    check(spark, [("France, 1990", None)], A.languages(x, F.lit("France")))


def test_title_rules(spark):
    check(spark, [("JAWS 2", True), ("8 1/2", True), ("Jaws", False), ("ÉTÉ", True), ("ÉtÉ", False)], A.is_caps_title(x))
    check(spark, [("Book Club Pop-Up", "other"), ("Theory Night Book Club", "other"), ("A Book Club", "book_club"), ("Talk", "other")], A.classify_title(x))
    check(spark, [("Jaws (live event)", True), ("Alive", False), ("Go Live now", True), ("Big Night!", True)], A.is_live_title(x))


def test_names(spark):
    check(spark, [(" bach ", "Johann Sebastian Bach"), ("Various", None), ("consort of viols", None), ("Clara Schumann", "Clara Schumann"), (None, None)],
          X.clean_name(x))


def test_specific_events(spark):
    cases = [
        ("Bergman Festival", "d", True), ("Bergman Festival", "", False), ("Film Series", "d", False), ("A Season Of Woolf", "", False), ("Season Opener", "", True), ("Gala", "", False),
        ("Lecture", "d", False), ("Jaws", "", True)]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(cases)], "i int, t string, d string")
    none, names = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    got = rows.select("i", A.is_specific(F.col("t"), none, F.lit("screening"), none, none, F.col("d"), none, names).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [want for _, _, want in cases]


def test_main_text_prefers_main_and_drops_boilerplate(spark):
    html = "<body><nav>menu</nav><article>a<script>var x='</p>'</script></article><main>one<br>two &amp; three</main></body>"
    check(spark, [(html, "one | two & three"), ("<body><header>h</header>only</body>", "only"), ("<article>a</article>", "a")], P.main_text(x))
    check(spark, [("<main>abcdef</main>", "abc...")], P.main_text(x, max_chars=3))


def test_fold_of_every_code_point(spark):
    import unicodedata

    from showbill.functions.text import fold_ascii

    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or unicodedata.decomposition(chr(c)))]
    texts = ["x" + "".join(chars[i:i + 50]) + "y" for i in range(0, len(chars), 50)] + ["", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8).select("i", fold_ascii(F.col("t")).alias("f")).collect()
    want = [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert [r["f"] for r in sorted(got)] == want


def test_fold_looks_up_only_what_is_beyond_ascii(spark):
    from showbill.functions.text import fold_ascii, fold_marks

    rows = spark.createDataFrame([("plain",), ("5 ㎏ of 𝐀bc €é",), ("ﬃ",), ("Ｆｕｌｌ ǅ",), ("",), (None,)], "t string")
    out = rows.select("t", fold_ascii(F.col("t")).alias("f"), fold_marks(F.col("t")).alias("m"))
    assert [r["f"] for r in out.collect()] == ["plain", "5 kg of Abc e", "ffi", "Full Dz", "", None]
    assert [r["m"] for r in out.where("t = 'plain' or t = '' or t is null").collect()] == ["plain", "", None]
    assert "(?s)." not in out._jdf.queryExecution().optimizedPlan().toString()


def test_wrap_equals_the_greedy_rule_and_lays_lines_once(spark):
    from showbill.functions.text import wrap

    def greedy(text, width, most):
        lines = []
        for word in (text or "").split():
            word = word[:width - 1] + "…" if len(word) > width else word
            if lines and len(lines[-1]) + 1 + len(word) <= width:
                lines[-1] += " " + word
            else:
                lines.append(word)
        return lines[:most - 1] + [lines[most - 1][:width - 1] + "…"] if len(lines) > most else lines or [""]

    texts = ["a bb ccc dddd eeeee ffffff", "extraordinarily long", "one", "a b c d e f g h i j k l m n", "", "  ", None, "abcdefg hi", "xx " * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for width, most in ((7, 3), (4, 2), (14, 1)):
        out = rows.select("t", wrap(F.col("t"), width, most).alias("w"))
        assert [r["w"] for r in out.collect()] == [greedy(t, width, most) for t in texts]
        assert out._jdf.queryExecution().logical().toString().lower().count("aggregate(") + out._jdf.queryExecution().logical().toString().lower().count("reduce(") == 1
