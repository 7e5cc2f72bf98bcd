"""Pinned vectors of the folding, hashing, scoring and time functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import scoring, text, timeparse


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_folding(spark):
    r = one(
        spark, text.normalize_title(F.lit("  Arsenal: Hoàn tất BUỔI tập! ")), text.normalize_title(F.lit("Arsenal Đội")), text.normalize_search(F.lit("Đội tuyển Việt Nam")),
        text.slugify(F.lit("Thể Công Viettel & Hà Nội")), text.slugify_plain(F.lit("Nam Định")), text.slugify_ascii(F.lit("FC Köln")),
    )
    assert list(r) == ["arsenal hoan tat buoi tap", "arsenal oi", "doi tuyen viet nam", "the-cong-viettel-ha-noi", "nam-inh", "fc-k-ln"]


def test_hash(spark):
    assert list(one(spark, text.fnv1a(F.lit("abc|http://x")), text.fnv1a(F.lit("")))) == ["ef4b1e79", "811c9dc5"]

    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ (ord(c) if ord(c) < 65536 else 0xD800 + ((ord(c) - 65536) >> 10))) * 16777619 % 2**32
        return f"{h:08x}"

    assert one(spark, text.fnv1a(F.lit("Việt 😀 ok")))[0] == fnv("Việt 😀 ok")


def test_similarity(spark):
    a, b = (text.title_words(F.lit(t)) for t in ("Arsenal hoàn tất buổi tập chiến thuật", "Arsenal hoàn tất buổi tập trước trận"))
    assert one(spark, text.jaccard(a, b))[0] == pytest.approx(5 / 9)
    assert one(spark, text.jaccard(text.title_words(F.lit("")), text.title_words(F.lit(""))))[0] == 0


def test_tokens_keep_hyphens_and_drop_stop_words(spark):
    assert sorted(one(spark, text.tokens(F.lit("The semi-final của Đội: over AND over again")))[0]) == ["again", "semi-final"]


def test_clean_text(spark):
    r = one(spark, text.clean_text(F.lit("&lt;b&gt;Goal&lt;/b&gt; <script>x\n1</script>&amp; <style>y</style>fans  cheer")), text.clean_text(F.lit(None).cast("string")))
    assert list(r) == ["Goal & fans cheer", ""]


def test_names_terms_urls(spark):
    r = one(spark, text.initials(F.lit("Thể Công Viettel")), text.initials(F.lit(" ")), text.related_terms(F.lit("Arsenal: Đội hình - x")))
    assert list(r) == ["CV", "T", ["arsenal", "doi hinh"]]
    urls = ["https://vff.org.vn/a", "http://localhost/x", "ftp://a.b", "not a url", "http://127.0.0.1:80/"]
    assert [x[0] for x in spark.createDataFrame([(u,) for u in urls], "u string").select(text.safe_url(F.col("u"))).collect()] == [True, False, False, False, False]


def _hot(spark, age, n, rel, pop, vel, imp, verified):
    c = [F.lit(float(x)) for x in (age, n, rel, pop, vel, imp)]
    return one(spark, scoring.hotness(*c, F.lit(verified)))[0]


def test_hotness(spark):
    assert _hot(spark, 0, 5, 100, 100, 100, 100, False) == 84 and _hot(spark, 0, 5, 100, 100, 100, 100, True) >= 85
    assert _hot(spark, 2, 2, 93, 76, 84, 76, True) == 79 and _hot(spark, 40, 1, 90, 58, 45, 58, False) == 43
    labels = [one(spark, scoring.hotness_label(F.lit(x)))[0] for x in (84, 85, 10)]
    assert labels == ["Rất nóng", "Tin khẩn", "Bình thường"]


def test_reliability_and_personalization(spark):
    high = one(spark, scoring.reliability(F.lit(91.0), F.lit(2.0), F.lit(True), F.lit(False)))[0]
    low = one(spark, scoring.reliability(F.lit(60.0), F.lit(1.0), F.lit(False), F.lit(True)))[0]
    assert low < high <= 100
    p = lambda followed, penalty: one(spark, scoring.personalization(F.lit(followed), F.lit(70), F.lit(80), F.lit(2.0), penalty))[0]
    assert p(True, 0) > p(False, 0) > p(False, 20)
    assert one(spark, scoring.half_up(F.lit(-1.5)))[0] == -1


def test_importance_uses_given_unless_zero(spark):
    t, c = F.lit("Ordinary"), F.lit("x")
    got = one(spark, *[scoring.importance(t, c, F.lit(v).cast("int")) for v in (0, 30, None)], scoring.importance(F.lit("World Cup"), c), scoring.importance(F.lit("V-League"), c))
    assert list(got) == [58, 30, 58, 88, 76]


def test_statuses(spark):
    assert [one(spark, scoring.match_status(F.lit(s)))[0] for s in ("HT", "PEN", "NS")] == ["live", "finished", "scheduled"]
    assert [one(spark, scoring.match_status_text(F.lit(s)))[0] for s in ("PAUSED", "FINISHED", "TIMED")] == ["live", "finished", "scheduled"]


@pytest.mark.parametrize("given, vietnamese, want", [
    ("invalid", False, None), (None, False, None), ("", False, None), ("2026-07-13T19:00:00Z", False, (16, 0, 0)), ("Mon, 13 Jul 2026 11:48:02 EST", False, (15, 48, 2)),
    ("Mon, 13 Jul 2026 16:06:00 BST", False, (15, 6, 0)), ("7/13/2026 9:11:00 PM", True, (14, 11, 0)), ("7/13/2026 9:11 PM", True, (14, 11, 0)), ("2026-07-13T11:45:00Z", False, (11, 45, 0)),
    ("7/13/2026 9:11:00 PM", False, None), ("Mon, 13 Jul 2026 04:48:02 EDT", False, (8, 48, 2)), ("13 Jul 2026 04:48:02 PST", False, (12, 48, 2)), ("Mon, 13 Jul 2026 04:48:02 mdt", False, (10, 48, 2)),
])
def test_times(spark, given, vietnamese, want):
    now = F.lit("2026-07-13 16:00:00").cast("timestamp")
    got = one(spark, timeparse.normalize_timestamp(F.lit(given).cast("string"), now, F.lit(vietnamese)).cast("timestamp_ntz"))[0]
    assert got == (want and dt.datetime(2026, 7, 13, *want))
