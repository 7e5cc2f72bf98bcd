"""Order-dependent, stateful and warehouse operators against plain Python."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import checks, dates, text
from newsloom.operators import clustering, components, dedupe, ranking, ratelimit, search, shared, similarity, warehouse
from newsloom.sources import feeds, sports
from newsloom.streaming.limiter import rate_limit_stream

T0 = dt.datetime(2024, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_first_fit_inside_components_equals_global():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 14)
        linked = {i: set() for i in range(n)}
        for _ in range(rng.randint(0, 16)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                linked[a].add(b), linked[b].add(a)
        order = rng.sample(range(n), n)
        left, parts = set(range(n)), {}
        while left:
            comp, todo = set(), [min(left)]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp.add(x)
                    todo += linked[x]
            left -= comp
            parts |= clustering.first_fit([x for x in order if x in comp], linked)
        assert parts == clustering.first_fit(order, linked)


def test_story_clusters_against_greedy(spark):
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(14)]
    arts = [(i, T0 + dt.timedelta(hours=rng.randrange(200)), rng.sample(words, rng.randint(0, 6))) for i in range(80)]
    df = spark.createDataFrame(arts, "seq long, published timestamp_ntz, tok array<string>")

    def same(x, y):
        if abs((x[1] - y[1]).total_seconds()) > 72 * 3600:
            return False
        shared = len(set(x[2]) & set(y[2]))
        return shared >= 3 and shared / max(1, min(len(x[2]), len(y[2]))) >= 0.52

    clusters = []
    for a in sorted(arts, key=lambda a: (-a[1].timestamp(), a[0])):
        home = next((c for c in clusters if any(same(a, b) for b in c)), None)
        home.append(a) if home else clusters.append([a])
    want = sorted((a[0], c[0][0], n) for c in clusters for n, a in enumerate(c, 1))
    assert any(len(c) > 2 for c in clusters)
    assert sorted(tuple(r) for r in clustering.story_clusters(df).collect()) == want
    pairs = {(r.a, r.b) for r in similarity.same_story(df).collect()}
    assert pairs == {(x[0], y[0]) for x in arts for y in arts if x[0] < y[0] and same(x, y)}


def test_no_group_of_stories_meets_in_one_task(spark):
    """A chain of titles, each like the one before: first fit against plain links, and no Python group in the plan."""
    arts = [(i, T0 + dt.timedelta(hours=i // 2), [f"w{j}" for j in range(i, i + 6)]) for i in range(40)]
    df = spark.createDataFrame(arts, "seq long, published timestamp_ntz, tok array<string>")
    linked = {i: {j for j in range(40) if j != i and abs(i - j) <= 2} for i in range(40)}
    order = sorted(range(40), key=lambda i: (-arts[i][1].timestamp(), i))
    got = clustering.story_clusters(df)
    assert {r.seq: r.cluster for r in got.collect()} == clustering.first_fit(order, linked)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 60), (7, 7)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 60: 40}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_last_wins_at_first_place(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3), (3, None, 4)], "seq long, k string, v int")
    assert rows(dedupe.last_wins(df, "k").select("k", "v", "first_seq"), "first_seq") == [("a", 3, 0), ("b", 2, 1), (None, 4, 3)]


def test_rank_is_total(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"), "id").repartition(7)
    got = rows(ranking.with_rank(df, [F.desc("x"), F.col("id")]).select("rank", "x", "id"), "rank")
    assert [r[0] for r in got] == list(range(1000)) and [(-x, i) for _, x, i in got] == sorted((-x, i) for _, x, i in got)


def limiter(events, limit, window):
    state, out = {}, {}
    for key, us, tie in sorted(events, key=lambda e: (e[1], e[2])):
        reset, n = state.get(key, (-1, 0))
        reset, n = (us + window, 1) if us >= reset else (reset, n + 1)
        state[key] = reset, n
        out[tie] = (n, n <= limit, max(0, limit - n))
    return out


def test_rate_limit(spark):
    rng = random.Random(1)
    events = [(rng.choice(["hot"] * 5 + ["a", "b"]), rng.randrange(400) * 1_000_000, i) for i in range(600)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), i) for k, us, i in events] + [(None, T0, 999)], "k string, ts timestamp_ntz, i long")
    got = {r.i: (r.n, r.allowed, r.remaining) for r in ratelimit.rate_limit(df, "k", "ts", "i", 4, 60).collect()}
    assert got == limiter(events, 4, 60_000_000)


def test_fold_carries_state():
    t = np.sort(np.random.default_rng(0).integers(0, 500, 80))
    whole, end = ratelimit.fold(t, 37, None)
    first, state = ratelimit.fold(t[:31], 37, None)
    second, last = ratelimit.fold(t[31:], 37, state)
    assert np.array_equal(whole, np.concatenate([first, second])) and last == end
    assert len(ratelimit.fold(t[:0], 37, state)[0]) == 0


def test_rate_limit_stream(spark, tmp_path):
    events = [("a", 0, 1), ("a", 10, 2), ("b", 5, 3), ("a", 70, 4), ("a", 75, 5), ("a", 80, 6)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), i) for k, s, i in events], "k string, ts timestamp_ntz, i long")
    df.where("i <= 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts", "i", 2, 60)
    got = {}

    def run_once():  # timeouts keep such a stream busy: it never waits for new data, so each run is of one batch
        sink = out.writeStream.foreachBatch(lambda d, _: got.update({r.i: (r.n, r.allowed, r.remaining) for r in d.collect()}))
        q = sink.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        assert q.awaitTermination(120)

    run_once()
    assert sorted(got) == [1, 2, 3]
    df.where("i > 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run_once()  # the state comes from the checkpoint
    assert got == limiter([(k, s * 1_000_000, i) for k, s, i in events], 2, 60_000_000)


def items(spark):
    data = [
        (0, "arsenal", "Arsenal ký hợp đồng", "Arsenal", 80, 90, "en"), (1, "vietnam", "Đội tuyển Việt Nam", "Việt Nam", 60, 95, "vi"), (2, "madrid", "Madrid hòa", "Real", 99, 80, None),
    ]
    df = spark.createDataFrame(data, "seq long, id string, title string, team string, hotness int, reliability int, language string")
    return df.withColumns({"summary": F.lit(""), "category": F.lit("c"), "competition": F.lit("L"), "sources": F.array(F.lit("VFF"), F.col("team")), "key_points": F.array().cast("array<string>")})


def test_search_filters(spark):
    i = items(spark)
    ids = lambda df: [r.id for r in df.orderBy("seq").collect()]
    assert ids(search.filter_items(i, "Viet Nam")) == ["vietnam"]
    assert ids(search.filter_items(i, team="Arsenal", min_hotness=70)) == ["arsenal"] and ids(search.filter_items(i, team="Arsenal", min_hotness=81)) == []
    assert len(ids(search.filter_items(i))) == 3
    assert ids(i.where(search.source_class("vi"))) == ["vietnam", "madrid"] and len(ids(i.where(search.source_class("official")))) == 3
    assert ids(i.where(search.is_transfer())) == ["arsenal"]
    assert [r.id for r in search.related(i, ["Arsenal", "x"]).collect()] == ["arsenal"] and search.related(i, ["Real Madrid"]).count() == 0
    first = search.personalized(i, ["Việt Nam"]).orderBy(F.desc("rank_score"), "seq").first()
    assert first.id == "vietnam"


def test_pages(spark):
    df = spark.range(3)
    got = lambda p, n=2: [tuple(r) for r in search.paginate(df, [F.col("id")], p, n).collect()]
    assert got(2) == [(2, 2, 2)] and got(9) == [(2, 2, 2)] and got(-1) == [(0, 1, 2), (1, 1, 2)]
    assert search.paginate(df.where("id > 5"), [F.col("id")], 1, 2).count() == 0
    assert rows(search.page_strip(spark, 5, 9), "page") == [(1, False, False), (4, True, False), (5, False, True), (6, False, False), (9, True, False)]


def test_warehouse(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, w int")
    s = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k long, v string, w int")
    assert rows(warehouse.insert_new(t, s, "k"), "k") == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert rows(warehouse.upsert(t, s, "k", ["v"]), "k") == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
    assert rows(warehouse.upsert(warehouse.upsert(t, s, "k", ["v"]), s, "k", ["v"]), "k") == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
    broken = warehouse.violations(s, {"v_long": F.length("v") > 1, "w_small": F.col("w") < 5})
    assert rows(broken.select("k", "rule"), "k", "rule") == [(2, "w_small"), (3, "v_long")]
    assert rows(warehouse.visible(t, F.col("k") == 1, F.lit(None).cast("boolean")), "k") == [(1, "a", 1)]
    assert warehouse.orphans(s, "v", t, "v").count() == 1
    twice = s.unionAll(s).unionAll(spark.createDataFrame([(3, "d", 3), (None, "n", 0)], s.schema))
    assert rows(warehouse.insert_new(t, twice, "k"), "k") == [(None, "n", 0), (1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert rows(warehouse.upsert(t, twice, "k", ["v"]), "k")[1:] == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
    assert warehouse.insert_returning(t.where("false"), t.select("v"), ["v"], F.lit("now"), "k").first().k == 1
    jobs = spark.createDataFrame([(1, "pending"), (2, "processing"), (3, "completed"), (4, None)], "id int, status string")
    steps = spark.createDataFrame([(1, "completed"), (1, "processing"), (2, "failed"), (3, "pending"), (9, "failed")], "id int, to string")
    assert rows(warehouse.advanced(jobs, steps), "id") == [(1, "processing", True), (2, "failed", True), (3, "completed", False), (4, None, False)]


def test_checked_arguments():
    assert checks.search("  ab ") == {"q": "ab", "type": "all"} and checks.bookmark("x", "save") and checks.follow("team", "t", "follow") and checks.profile("An", "vi", "UTC")
    for bad in (lambda: checks.search("a"), lambda: checks.search("x" * 81), lambda: checks.search(None), lambda: checks.search("ab", "other"), lambda: checks.bookmark("", "save"), lambda: checks.follow("x", "t", "follow"), lambda: checks.profile("A", "vi", "UTC")):
        with pytest.raises(ValueError):
            bad()
    assert not search.long_enough(" đ! ") and search.long_enough("đá")


def test_distances(spark):
    ago = [0, 1, 59, 60, 89, 90, 3599, 3600, 86399, 86400, 30 * 86400 - 1, 30 * 86400, 360 * 86400, 365 * 86400, 800 * 86400, -7200]
    df = spark.createDataFrame([(i, T0 - dt.timedelta(seconds=s)) for i, s in enumerate(ago)], "i int, t timestamp_ntz")
    got = [r.x for r in df.orderBy("i").select(dates.distance(F.col("t"), F.lit("2024-01-01").cast("timestamp")).alias("x")).collect()]
    want = ["0 giây", "1 giây", "59 giây", "1 phút", "1 phút", "2 phút", "60 phút", "1 giờ", "24 giờ", "1 ngày", "30 ngày", "1 tháng", "1 năm", "1 năm", "2 năm"]
    assert got == [f"{w} trước" for w in want] + ["2 giờ nữa"]


def test_folding_on_the_driver_equals_the_column(spark):
    given = ["Đội tuyển Việt Nam!", "ÀÉÎ õ ü", "", "  x--Y ", "ﬁn", "漢字 a", "ǅ"]
    df = spark.createDataFrame([(g,) for g in given], "g string").coalesce(1)
    assert [r.x for r in df.select(text.normalize_search(F.col("g")).alias("x")).collect()] == [text.fold(g) for g in given]


def test_likely_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i:02d}" for i in range(9)]
    arts = [(i, T0 + dt.timedelta(hours=rng.randrange(150)), rng.sample(words, rng.randint(0, 7))) for i in range(90)]
    df = spark.createDataFrame(arts, "seq long, published timestamp_ntz, tok array<string>")
    want = set()
    for x in arts:
        for y in arts:
            a, b = set(x[2]), set(y[2])
            if x[0] < y[0] and abs((x[1] - y[1]).total_seconds()) <= 48 * 3600 and a & b and len(a & b) / len(a | b) >= 0.55:
                want.add((x[0], y[0], len(a & b)))
    assert {tuple(r) for r in similarity.likely_duplicates(df).collect()} == want and len(want) > 30


def test_intermediate_tables_are_released(spark):
    kept = shared.materialize(spark.range(5))
    assert kept.count() == 5 and shared.release(spark) >= 1 and shared.release(spark) == 0


def test_rss_and_atom(spark, tmp_path):
    now = F.lit("2026-07-13 16:00:00").cast("timestamp")
    item = "<item><title>{t}</title><link>{l}</link><description>&lt;p&gt;Body &amp;amp; more&lt;/p&gt;</description><pubDate>{d}</pubDate><category>Cup</category><category>x</category></item>"
    day = "Mon, 13 Jul 2026 11:00:00 GMT"
    many = "".join(item.format(t=f"Title {n}", l=f"https://a.example/{n}", d=day) for n in range(20))
    bad = item.format(t="No time", l="https://a.example/x", d="soon") + item.format(t="No link", l="mailto:x", d=day)
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss" / "a.xml").write_text(f"<rss><channel>{bad}{many}</channel></rss>")
    atom = '<entry><title>Atom one</title><link href="https://b.example/1"/><summary></summary><updated>2026-07-13T10:00:00Z</updated></entry>'
    (tmp_path / "rss" / "b.xml").write_text(f"<feed>{atom}</feed>")
    got = feeds.rss_items(spark, str(tmp_path / "rss"), now).collect()
    a = [r for r in got if "a.example" in r.url]
    assert len(a) == 14 and a[0].excerpt == "Body & more" and a[0].category == "Cup" and a[0].published == dt.datetime(2026, 7, 13, 11)
    b = [r for r in got if "b.example" in r.url]
    assert [(r.title, r.url, r.excerpt, r.category, r.source) for r in b] == [("Atom one", "https://b.example/1", feeds.NO_EXCERPT, feeds.NO_CATEGORY, None)]


def test_articles_know_their_feed(spark, tmp_path):
    (tmp_path / "f").mkdir()
    day = "<pubDate>7/13/2026 9:11:00 PM</pubDate>"
    items = [
        f'<item><title>Both</title><link href="https://a/href">text</link><guid>g1</guid>{day}<summary>no description</summary></item>', f"<item><title>No link</title><guid>https://a/guid</guid>{day}</item>",
        f"<item><title>Text</title><link>https://a/text</link>{day}<description>said</description></item>",
    ]
    (tmp_path / "f" / "one.xml").write_text(f"<rss><channel>{''.join(items)}</channel></rss>")
    registry = spark.createDataFrame([("one.xml", "Báo", "https://feed", 91, "vi", None)], "file string, name string, url string, reliability int, language string, official boolean")
    now = F.lit("2026-07-14 00:00:00").cast("timestamp")
    got = {r.title: r for r in feeds.rss_items(spark, str(tmp_path / "f"), now, registry).collect()}
    assert {t: r.url for t, r in got.items()} == {"Both": "https://a/href", "No link": "https://feed", "Text": "https://a/text"}
    assert got["Text"].excerpt == "said" and got["Both"].excerpt == feeds.NO_EXCERPT and got["Both"].published == dt.datetime(2026, 7, 13, 14, 11)
    r = got["Both"]
    assert (r.source, r.reliability, r.language, r.official, r.translated) == ("Báo", 91, "vi", False, False)
    hashes = spark.createDataFrame([("Both", "g1"), ("Text", "https://a/text")], "t string, u string").select("t", text.content_hash(F.col("t"), F.col("u")).alias("h")).collect()
    assert {h.t: h.h for h in hashes} == {"Both": got["Both"].id, "Text": got["Text"].id}


def test_feed_registry(spark):
    assert feeds.feed_registry(spark).count() == 12
    given = json.dumps([{"name": "A", "url": "https://a", "reliability": 70, "language": "en"}, {"name": "B", "url": "http://b", "reliability": 70, "language": "en"}])
    assert [r.name for r in feeds.feed_registry(spark, given).collect()] == ["A"]
    assert [(r.name, r.reliability, r.language) for r in feeds.feed_registry(spark, "https://x.example/rss, nope").collect()] == [("Nguồn tùy chỉnh 1", 85, "vi")]
    assert [r.name for r in feeds.feed_registry(spark, "[broken, https://b.example/rss").collect()] == ["Nguồn tùy chỉnh 2"]


def test_json_patterns_and_normalized(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"externalId": "1", "url": "http://x", "title": " Demo  title ", "excerpt": " đoạn trích ", "publishedAt": "z"}]))
    r = feeds.normalized(feeds.json_articles(spark, str(tmp_path / "n.json")), "s").first()
    assert (r.title, r.excerpt, r.source_id, r.language) == ("Demo title", "đoạn trích", "s", "vi") and len(r.hash) == 8
    xml = "".join(f"<item><title><![CDATA[ T{n}\n]]></title><link>http://l/{n}</link></item>" for n in range(40)) + "<item><title><![CDATA[x]]></title><link>http://open</link>"
    landed = spark.createDataFrame([("u", xml)], "url string, xml string")
    p = feeds.pattern_articles(landed).collect()
    assert len(p) == 30 and tuple(p[3]) == ("3-http://l/3", "T3", "http://l/3", feeds.PATTERN_EXCERPT)
    assert feeds.pattern_articles(landed, 99).count() == 40  # the last item is not closed
    blank = feeds.normalized(spark.createDataFrame([("\u00a0 A  B\n", "\n x \u00a0", "u")], "title string, excerpt string, url string"), "s").first()
    assert (blank.title, blank.excerpt) == ("A B", "x")
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "o.json").write_text('{"data": []}')
    with pytest.raises(Exception, match="must hold an array"):
        feeds.json_articles(spark, str(tmp_path / "o")).collect()


def test_partial_failure(spark):
    def broken():
        raise OSError("down")

    assert feeds.union_of_available([broken, lambda: spark.range(2)]).count() == 2
    with pytest.raises(RuntimeError):
        feeds.union_of_available([broken])
    calls = []

    def second():
        calls.append(1)
        if len(calls) < 2:
            raise OSError
        return "ok"

    assert feeds.retried(second) == "ok"
    with pytest.raises(OSError):
        feeds.retried(broken)


def test_providers(spark, tmp_path):
    fixture = lambda i, s, lg: {"fixture": {"id": i, "date": "d", "status": {"short": s, "elapsed": 3}, "venue": {"name": None}}, "league": {"id": lg, "name": "L"}, "teams": {"home": {"name": "H"}, "away": {"name": "A"}}, "goals": {"home": 1, "away": None}}
    (tmp_path / "f.json").write_text(json.dumps({"response": [fixture(1, "2H", 39), fixture(2, "FT", 40)]}))
    m = sports.api_matches(spark, str(tmp_path / "f.json"), [39]).collect()
    assert [(r.id, r.status, r.home_score, r.away_score, r.venue) for r in m] == [("1", "live", 1, None, sports.NO_VENUE)]
    assert sports.api_matches(spark, str(tmp_path / "f.json"), []).count() == 2
    t = {"name": " ", "shortName": "Short", "tla": None}
    match = {"id": 5, "utcDate": "u", "status": "FINISHED", "competition": {"name": "C"}, "homeTeam": t, "awayTeam": {"name": None}, "score": {"fullTime": {"homeTeam": 2, "awayTeam": 0}}}
    (tmp_path / "m.json").write_text(json.dumps({"matches": [match]}))
    r = sports.data_matches(spark, str(tmp_path / "m.json")).first()
    assert (r.home, r.away, r.home_score, r.away_score, r.status) == ("Short", "Chưa xác định", 2, 0, "finished")
    row = {"position": 1, "team": {"name": "X"}, "playedGames": 9, "won": 1, "draw": 2, "lost": 3, "goalDifference": -1, "points": 5, "form": "L,W,?,D,W,L"}
    (tmp_path / "s.json").write_text(json.dumps({"standings": [{"type": "HOME", "table": []}, {"type": "TOTAL", "table": [row]}]}))
    s = sports.data_standings(spark, str(tmp_path / "s.json")).first()
    assert (s.team, s.form) == ("X", ["W", "D", "W", "L"])
    f = spark.range(1).select(sports.form_of_letters(F.lit("WD")), sports.form_of_letters(F.lit(None).cast("string"))).first()
    assert list(f) == [["W", "D"], []]
    merged = sports.merge_matches(sports.api_matches(spark, str(tmp_path / "f.json")), sports.api_matches(spark, str(tmp_path / "f.json"), [40]).withColumn("venue", F.lit("new")))
    assert sorted((r.id, r.venue) for r in merged.collect()) == [("1", sports.NO_VENUE), ("2", "new")]
    rows = {"league": {"standings": [[{"rank": 2, "team": {"name": "T"}, "points": 7, "goalsDiff": -3, "form": "LLWWDXW", "all": {"played": 5, "win": 2, "draw": 1, "lose": 2}}]]}}
    (tmp_path / "as.json").write_text(json.dumps({"response": [rows]}))
    assert tuple(sports.api_standings(spark, str(tmp_path / "as.json")).first()) == (2, "T", 5, 2, 1, 2, -3, 7, ["W", "W", "D", "W"])
    (tmp_path / "at.json").write_text(json.dumps({"response": [{"team": {"id": 4, "name": "Hà Nội FC", "code": None, "country": None}, "venue": None}]}))
    assert tuple(sports.api_teams(spark, str(tmp_path / "at.json")).first()) == ("4", "Hà Nội FC", "HÀ ", "h-n-i-fc", "", "")
    (tmp_path / "dt.json").write_text(json.dumps({"teams": [{"id": 9, "name": "A B", "shortName": "Ab", "tla": None, "area": {"name": "Anh"}, "venue": "V"}]}))
    assert tuple(sports.data_teams(spark, str(tmp_path / "dt.json")).first()) == ("9", "A B", "Ab", "a-b", "Anh", "V")
    days = spark.createDataFrame([(f"2026-07-{n:02d}T20:00:00Z",) for n in range(8, 25)], "start_time string")
    assert sports.in_window(days, F.lit("2026-07-13").cast("date")).count() == 9
    assert [sports.provider_name(*x) for x in ((None, "football-data"), ("k", "api-football"), ("k", "other"))] == ["mock", "api-football", "mock"]
    twice = spark.createDataFrame([("1", "a"), ("1", "b")], "id string, venue string").coalesce(1)
    assert [r.venue for r in sports.merge_matches(twice).collect()] == ["b"]
