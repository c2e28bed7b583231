"""Operators against brute force on small fixtures, and under skew."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from showbill.operators import generators as GE
from showbill.operators import grouping as G
from showbill.operators import joins as J
from showbill.operators import quality as Q
from showbill.operators import ranking as R
from showbill.operators import rollups as RU
from showbill.operators import scale as S
from showbill.operators.normalize import snake_name


def sequential_new_listings(listings, known):
    """The rule spelled out: a listing is dropped if any of its showings is known or kept earlier."""
    seen, kept = set(known), []
    for name, keys in listings:
        if not any(k in seen for k in keys):
            kept.append(name)
            seen.update(keys)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_new_listings_equals_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    listings = [(f"{i:03d}", sorted({f"k{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 4))})) for i in range(60)]
    known = ["k1", "k2"]
    shows = spark.createDataFrame([(n, k) for n, keys in listings for k in keys], "ord string, showing_key string")
    got = J.new_listings(shows, spark.createDataFrame([(k,) for k in known], "showing_key string"))
    assert sorted(r["ord"] for r in got.collect()) == sequential_new_listings(listings, known)


def test_new_listings_chain(spark):
    # 0 blocks 1, so 1 does not block 2, which blocks 3, and so on.
    listings = [(f"{i:02d}", [f"k{i}", f"k{i + 1}"]) for i in range(8)]
    shows = spark.createDataFrame([(n, k) for n, keys in listings for k in keys], "ord string, showing_key string")
    got = J.new_listings(shows, spark.createDataFrame([], "showing_key string"))
    assert sorted(r["ord"] for r in got.collect()) == sequential_new_listings(listings, [])


def test_similarity_equals_all_pairs(spark):
    rnd = random.Random(5)
    titles = ["a", "ab", "abc", "bc", "x", "xab", "zzz", ""]
    rows = [(rnd.choice(titles), rnd.choice(["d1", "d2"]), rnd.choice(["t1", "t2"])) for _ in range(80)]
    got = J.similarity(spark.createDataFrame(rows, "title string, date string, time string")).collect()

    def tier(a, b):
        if a == b:
            return "same"
        if not a[0] or not b[0] or not (a[0] in b[0] or b[0] in a[0]):
            return None
        return "near" if a[1:] == b[1:] else "day" if a[1] == b[1] else "other_day"

    want = {}
    for i, a in enumerate(rows):
        if a[0]:
            counts = dict.fromkeys(("same", "near", "day", "other_day"), 0)
            for j, b in enumerate(rows):
                t = tier(a, b) if i != j else None
                if t:
                    counts[t] += 1
            want[a] = counts
    assert {(r["title"], r["date"], r["time"]): {c: r[c] for c in ("same", "near", "day", "other_day")} for r in got} == want


def test_containing_equals_all_pairs(spark):
    texts, needles = ["old plate", "gold ring", "ring", "", "o"], ["ring", "old", "o", "", "plate x"]
    got = S.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = {(t, n) for t, n in itertools.product(texts, needles) if n and n in t}
    assert {tuple(r) for r in got.collect()} == want


def test_position_in_group(spark):
    rows = [("hot" if i % 3 else "cold", f"Person {i * 37 % 100:02d}") for i in range(100)]
    got = S.position_in_group(spark.createDataFrame(rows, "g string, t string"), ["g"], "t").collect()
    want = {}
    for g in ("hot", "cold"):
        for n, t in enumerate(sorted(t for h, t in rows if h == g), 1):
            want[g, t] = n
    assert {(r["g"], r["t"]): r["position"] for r in got} == want


def test_first_row_under_skew(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 != 0, 0).otherwise(F.col("id")).alias("k"), (30000 - F.col("id")).alias("ord"), F.col("id").alias("v"))
    hot = G.first_row(rows, ["k"], ["v"]).where("k = 0").collect()
    assert [r["v"] for r in hot] == [29999]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    from showbill.plans.digest import weekly_digest

    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([tuple(r) for r in weekly_digest(spark, sf_dir, "1998-W25").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) > 0


def test_ratings_minus_one_null_and_zero_rank_apart(spark):
    rows = spark.createDataFrame([(1, "a", -1), (2, "b", None), (3, "c", 0), (4, "d", 7)], "event_key long, title string, rating int")
    first = spark.createDataFrame([(k, "2024-01-01", "10:00") for k in (1, 2, 3, 4)], "event_key long, first_date string, first_time string")
    assert [r["event_key"] for r in R.text_rank(rows, first).orderBy("position").collect()] == [4, 3, 1, 2]
    assert [r["event_key"] for r in R.feed_rank(rows, first, "2024-01-01").orderBy("position").collect()] == [4, 3, 1, 2]
    event = rows.withColumn("venue", F.lit("v"))
    assert {r["event_key"]: r["derived_rating"] for r in RU.derived_rating(event).collect()} == {1: 7, 2: 7, 3: 7, 4: 7}


def test_companion_goes_to_the_film(spark):
    event = spark.createDataFrame([(1, "LANCELOT DU LAC", "movie", "v", "u"), (2, "Paper Cuts - L", "other", "w", "u"), (3, "Other", "other", "w", "u")],
                                  "event_key long, title string, type string, venue string, url string")
    shows = spark.createDataFrame([(1, "2026-05-01", "1", "18:00"), (2, "2026-05-02", "3", "20:00"), (2, "2026-05-01", "2", "19:00"), (3, "2026-05-01", "4", "18:00")],
                                  "event_key long, date string, ord string, time string")
    hint = spark.createDataFrame([(2, "Lancelot du Lac ", "2026-05-01"), (3, "Lancelot", "2026-05-02")], "event_key long, hint_title string, hint_date string")
    attached, rest = J.merge_companions(event, shows, hint)
    assert [(r["event_key"], r["film_key"], r["time"], r["description"], r["url"]) for r in attached.collect()] == [(2, 1, "19:00", "", "u")]
    assert sorted(r["event_key"] for r in rest.collect()) == [1, 3]


def test_score_of_a_pair(spark):
    cases = [("A", "d", "t", " a ", "d", "t", 1.0), ("A b", "d", "t", "b", "d", "t", 0.9), ("b", "d", "t", "a b", "d", "u", 0.7), ("A", "d", "t", "a", "e", "t", 0.4),
             ("A", "d", "t", "c", "d", "t", 0.0), ("", "d", "t", "", "d", "t", 0.0), (None, "d", "t", "a", "d", "t", 0.0), ("a", None, "t", "a", None, "t", 1.0)]
    rows = spark.createDataFrame(cases, "title string, date string, time string, t2 string, d2 string, h2 string, want double")
    score = J.pair_score(F.struct("title", "date", "time"), F.struct(F.col("t2").alias("title"), F.col("d2").alias("date"), F.col("h2").alias("time")))
    assert rows.where(score != F.col("want")).count() == 0 and rows.where(score.isNull()).count() == 0


def test_overrides_first_rule_wins_on_both_paths(spark):
    event = spark.createDataFrame([(1, "Weekly Story Club", "V", "book_club"), (2, "Story", "W", "movie"), (3, "None", "V", "movie")],
                                  "event_key long, title string, venue string, type string")
    rules = [{"title": "story club", "venue": "V", "type": "book_club", "rating": 8}, {"title": "STORY", "rating": 3}, {"venue": "V", "rating": 1}]
    for padding in (0, 500):
        out = J.apply_overrides(event, rules + [{"title": f"zz{i}", "rating": 0} for i in range(padding)])
        assert {r["event_key"]: r["override"]["rating"] for r in out.collect()} == {1: 8, 2: 3, 3: 1}


def test_refresh_shrink_uses_whole_halves(spark):
    schema = "venue string, title string, ord int, dates array<string>, program string, series string, featured_artist string"
    old = spark.createDataFrame([("v", "A", 1, ["d"], "abcdefg", "s", ""), ("v", "B", 2, ["d"], "abcdefg", "s", "")], schema)
    new = spark.createDataFrame([("v", " a ", 1, ["d"], "abc", "s", ""), ("v", "B", 2, ["d"], "ab", "s", "")], schema)
    assert [(r["title"], r["problem"]) for r in J.refresh_regressions(old, new).collect()] == [("B", "program shrank from 7 to 2")]


def test_weekly_rules(spark):
    rule = spark.createDataFrame([("Club", "Monday", "7:00 PM"), ("Late", "Tuesday", "9:00 PM"), ("Never", "Someday", "9:00 PM")],
                                 "title string, day_of_week string, time string")
    got = GE.weekly(rule, "1998-06-15 19:00:00", weeks=2).collect()
    assert sorted((r["title"], r["date"]) for r in got) == [
        ("Club", "1998-06-22"), ("Club", "1998-06-29"), ("Late", "1998-06-16"), ("Late", "1998-06-23")]


def test_gate_reasons(spark):
    def reason(*rows):
        return Q.gate(spark.createDataFrame(list(rows), "venue string, found long, healthy boolean")).first()["reason"]

    assert reason(("a", 3, True), ("b", 3, False)) == ""
    assert reason(("a", 3, False)) == "every source failed"
    assert reason(("a", 3, True), ("b", 3, False), ("c", 1, False)) == "more sources failed than passed"
    assert Q.gate(spark.createDataFrame([], "venue string, found long, healthy boolean")).first()["reason"] == "no source produced any rows"


def test_snake_names():
    names = ["eventTitle", "HTTPUrl", "already_ok", "Venue-Name", "with space", "runtimeMinutes"]
    assert [snake_name(n) for n in names] == ["event_title", "http_url", "already_ok", "venue__name", "with_space", "runtime_minutes"]


def test_reader_sections_rename_by_emoji(spark):
    html = ("<p>★ Rating: [8/10]</p><p><strong>🎭 SHARDS OF MEMORY</strong>: Dense and brave.</p><p>🎭 Artistic Merit</p>"
            "<p><strong>✨ Originality</strong> The supplied material is thin.</p><p>Closing words.</p>")
    kept, declined = Q.reader_sections(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html")
    assert sorted((r["label"], r["body"]) for r in kept.collect()) == [("", "Closing words."), ("Artistic Merit", "Dense and brave.")]
    assert [r["declined"] for r in declined.collect()] == [1]


def test_structured_metadata_is_json(spark, sf_dir):
    from showbill.catalog import load

    rows = load()["k06_jsonld"][0](spark, sf_dir).limit(20).collect()
    assert all(json.loads(r["json"])["@type"] == "Event" for r in rows)


def test_overrides_of_events_without_title(spark):
    event = spark.createDataFrame([(1, None, "V", "movie"), (2, "Zed", None, "movie"), (3, "Zed *", "*", None)],
                                  "event_key long, title string, venue string, type string")
    rules = [{"title": "zed", "venue": "V", "rating": 1}, {"venue": "V", "rating": 2}, {"type": "movie", "rating": 3}, {"title": "zed", "rating": 4}]
    for padding in (0, 1, 500):
        out = J.apply_overrides(event, rules + [{"title": f"no such {i}", "rating": 0} for i in range(padding)]).collect()
        assert {r.event_key: r.override.rule_no for r in out} == {1: 2, 2: 3, 3: 4}


def test_schedule_entry_without_times(spark):
    from showbill.sources.schedules import schedule_doc

    text = "## June 2024\n### Monday, June 3\n- **ALPHA** —\n- **BETA** — 6:00 PM\n"
    got = schedule_doc(spark.createDataFrame([("d", text)], "doc string, text string")).collect()
    assert [r.title for r in got] == ["BETA"]


def test_long_texts_and_many_needles(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_LETTERS", 40)  # several shards
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abc ") for _ in range(n)) for n in (0, 1, 5, 40, 1000)] + ["ÄÖ ß", None]
    needles = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 5))) for _ in range(60)] + ["ö", "Ö ", None]
    got = S.containing(spark.createDataFrame([(t,) for t in texts * 2], "t string"), spark.createDataFrame([(n,) for n in needles], "n string"), "t", "n")
    assert sorted(map(tuple, got.collect())) == sorted({(t, n) for t in texts for n in needles if t and n and n in t})
    none = S.containing(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "needle string"))
    assert none.collect() == []


@pytest.mark.parametrize("least", [0.9, 0.7, 0.4])
def test_similar_pairs_equal_all_pairs(spark, least):
    rnd = random.Random(6)
    titles = ["a", " AB", "abc", "bc", "x", "xab", "zzz", "", None, "a b c"]
    rows = [(i, rnd.choice(titles), rnd.choice(["d1", "d2", None]), rnd.choice(["t1", ""])) for i in range(70)]
    pairs, members = J.similar_pairs(spark.createDataFrame(rows, "ord int, title string, date string, time string"), least=least)
    of = {r["ord"]: r["class"] for r in members.collect()}
    between = {(r["a"], r["b"]): r["score"] for r in pairs.collect()}
    assert len(between) == pairs.count()

    def score(x, y):
        a, b = ((t or "").lower().strip() for t in (x[1], y[1]))
        if not a or not b or not (a in b or b in a):
            return 0.0
        day, hour = (x[2] or "") == (y[2] or ""), (x[3] or "") == (y[3] or "")
        return 1.0 if a == b and day and hour else 0.9 if day and hour else 0.7 if day else 0.4

    for x, y in itertools.combinations(rows, 2):
        if x[0] in of and y[0] in of:
            a, b = sorted((of[x[0]], of[y[0]]))
            got = 1.0 if a == b else between.get((a, b), 0.0)
        else:
            got = 0.0
        want = score(x, y)
        assert got == (want if want >= least else 0.0), (x, y)


def test_connected_groups(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(0, 3000) if i % 500] + [(rnd.randrange(4000, 4400), rnd.randrange(4000, 4400)) for _ in range(300)] + [(9000, 9000)]
    rnd.shuffle(links)
    group = {}
    for a, b in links:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        if group[a] is not group[b]:
            small, large = sorted((group[a], group[b]), key=len)
            large |= small
            for x in small:
                group[x] = large
    got = {r["node"]: r["group"] for r in S.connected(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: min(g) for x, g in group.items()}


def test_new_listings_of_a_long_chain(spark):
    listings = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(10_000)]
    shows = spark.createDataFrame([(i, k) for i, keys in listings for k in keys], "ord int, showing_key string")
    none = spark.createDataFrame([], "showing_key string")
    want = sequential_new_listings(listings, [])
    assert sorted(r["ord"] for r in J.new_listings(shows, none).collect()) == want
    short = shows.where("ord < 20")  # a group beyond the bound is settled in rounds
    assert sorted(r["ord"] for r in J.new_listings(short, none, group_rows=3).collect()) == [i for i in want if i < 20]


def test_overrides_from_a_table(spark):
    event = spark.createDataFrame([(1, "Weekly Story Club", "V", "book_club"), (2, "Story", "W", "movie"), (3, None, "V", None), (4, "Other", "W", "dance")],
                                  "event_key long, title string, venue string, type string")
    rules = spark.createDataFrame([(2, "STORY", None, 3), (1, "story club", "V", 8), (3, None, "V", 1)], "rule_no int, title string, venue string, rating int")
    out = {r.event_key: r.override and r.override.rating for r in J.apply_overrides(event, rules).collect()}
    assert out == {1: 8, 2: 3, 3: 1, 4: None}


def test_venue_rows(spark):
    from showbill.operators import normalize as N

    schema = "ord int, venue_key string, title string, dates array<string>, times array<string>, venue string, price string"
    rows = [
        (1, "a", "Show", ["2026-05-01"], ["7 pm"], "Annex", None), (2, "a", "SHOW", ["2026-05-01"], [], None, "5"), (3, "a", "Show", ["2026-05-02"], [], " ", ""),
        (4, "b", "Talk", [], None, "Annex", ""), (5, "b", " ", ["2026-05-01"], [], None, None), (6, "c", "Talk", None, [], "Annex", None),
        (7, None, "Talk", ["2026-05-01", "2026-05-03"], [], "Annex", "9"), (8, "a", "Old", ["2020-01-01"], [], None, None), (9, "a", "old", ["2020-01-01"], [], None, None)]
    venues = spark.createDataFrame([("a", "Hall A", "opera", True, None, "https://a"), ("b", "Hall B", "", False, "20:00", "https://b"), ("b", "Hall B", "", False, "20:00", "https://b")],
                                   "venue_key string, venue_name string, category string, preserve_venue_name boolean, default_time string, page_url string")
    defaults = spark.createDataFrame([("a", "price", "free"), ("b", "dates", "2026-06-01"), ("b", "note", "n")], "venue_key string, field string, default_value string")
    out = N.venue_rows(spark.createDataFrame(rows, schema), venues, "2026-04-01", defaults, ["price", "dates", "note"])
    got = {r.ord: (r.venue, r.type, r.dates, r.times, r.price, r.note, r.url, r.reject) for r in out.collect()}
    assert got == {
        1: ("Annex", "opera", ["2026-05-01"], ["19:00"], "free", None, "https://a", None),
        3: ("Hall A", "opera", ["2026-05-02"], ["19:00"], "free", None, "https://a", None),
        4: ("Hall B", "other", ["2026-06-01"], ["20:00"], "", "n", "https://b", None),
        5: ("Hall B", "other", ["2026-05-01"], ["20:00"], None, "n", "https://b", "no title"),
        6: ("Annex", "other", [], [], None, None, None, "no date"),
        7: ("Annex", "other", ["2026-05-01", "2026-05-03"], ["19:00", "19:00"], "9", None, None, None),
        8: ("Hall A", "opera", ["2020-01-01"], ["19:00"], "free", None, "https://a", "finished"),
        9: ("Hall A", "opera", ["2020-01-01"], ["19:00"], "free", None, "https://a", "finished")}
    assert N.venue_rows(spark.createDataFrame([], schema), venues, "2026-04-01").count() == 0


def test_person_pages_by_tasks_and_by_ranges(spark):
    from showbill.operators import rollups as RU

    rnd = random.Random(4)
    names = ["Ann Lee", "Ann  Lee", "ann-lee", "Ánn Lee", "Bo", "BO!", "Cy Young", "!!!", "???"]
    from showbill.values import ROLE_OF_TYPE

    rows = [(i, rnd.choice(sorted(ROLE_OF_TYPE)), rnd.choice(names), rnd.choice(names)) for i in range(300)]
    event = spark.createDataFrame(rows, "event_key int, type string, director string, composer string")
    got = [sorted(map(tuple, RU.person_pages(event, ["director", "composer"], sharing_rows=n).collect()), key=str) for n in (0, 1_000_000)]
    assert got[0] == got[1] and len({r[3] for r in got[0]}) == len(got[0]) > 8


def test_search_by_postings(spark, tmp_path):
    from showbill.operators import filters as FL
    from showbill.operators import postings as PO

    rnd = random.Random(12)
    rows = [(i, "".join(rnd.choice("aBé %_.") for _ in range(rnd.randint(0, 12))), rnd.choice(["Hall A", "", None]), rnd.choice(["movie", "book_club", None])) for i in range(300)]
    rows += [(300, "ab" * 2000, "Hall A", "movie"), (301, None, None, None)]
    event = spark.createDataFrame(rows, "event_key long, title string, venue string, type string")
    for n, root in ((50, str(tmp_path / "many")), (10_000, str(tmp_path / "one"))):
        assert PO.write_postings(event, root, shard_rows=n) == 1
        for query in ("a", "AB", "é", "%_", "a é", "baé", "book club", "hall", "ab" * 15, "zzz", " "):
            got = sorted(r[0] for r in PO.matching_events(spark, root, query).collect())
            want = event.where(FL.text_match(query)) if query.strip() else PO.searchable(event).select("event_key").distinct()
            assert got == sorted(r.event_key for r in want.collect()), query
    assert [r[0] for r in PO.matching_values(spark, root, "HALL", "venue").collect()] == ["Hall A"]
    assert PO.write_postings(event.limit(0), root) == 2 and PO.matching_events(spark, root, "a").count() == 0
    assert PO.matching_events(spark, root, "book club", version=1).count() > 0  # a held version stays


def test_of_rules_with_one_key_only_the_first_is_joined(spark):
    rules = spark.createDataFrame([(no, "Ring", None if no % 2 else "Hall", no % 7) for no in range(40, 0, -1)],
                                  "rule_no int, title string, venue string, rating int")
    event = spark.createDataFrame([(i, f"the ring {i}", "Hall" if i % 3 else "Cellar", "movie") for i in range(30)],
                                  "event_key int, title string, venue string, type string")
    out = J.apply_overrides(event, rules)
    assert {(r.override.rule_no, r.override.rating) for r in out.collect()} == {(1, 1)}
    assert {r.override.rule_no for r in J.apply_overrides(event, rules.where("rule_no <> 1")).where("venue = 'Hall'").collect()} == {2}
    # an event meets one rule a key, so the rules are grouped by their key below the join
    assert "Aggregate [needle" in out._jdf.queryExecution().optimizedPlan().toString()
