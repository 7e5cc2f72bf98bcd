"""Hotness, reliability, personalization and what feeds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of hotness, patterns of importance and speculation, tones.
LABELS = ((85, "Tin khẩn"), (70, "Rất nóng"), (50, "Đang nóng"), (30, "Đáng chú ý"))
LOWEST_LABEL = "Bình thường"
MAJOR = "chung kết|final|vô địch|champion|world cup|đội tuyển việt nam|vietnam"
LEAGUE = "champions league|premier league|la liga|serie a|v.league|chuyển nhượng|transfer"
SPECULATIVE = "tin đồn|có thể|được cho là|reportedly|rumou?r|could|may "
TONES = ("red", "green", "blue", "amber", "cyan")
LIVE_CODES = ("1H", "HT", "2H", "ET", "BT", "P", "INT", "LIVE")
DONE_CODES = ("FT", "AET", "PEN")
LIVE_WORDS = ("LIVE", "IN_PLAY", "PAUSED")


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def hotness(age: Column, n: Column, rel: Column, pop: Column, vel: Column, imp: Column, verified: Column) -> Column:
    """N09. Additions in this order: a tie at .5 depends on it."""
    fresh = F.greatest(F.lit(0.0), F.lit(100.0) - age * 3.0)
    score = fresh * 0.22 + F.least(F.lit(100.0), n * 22.0) * 0.16 + rel * 0.16 + pop * 0.12 + vel * 0.14 + imp * 0.2
    return half_up(clamp(F.when(~verified | (n < 2), F.least(score, F.lit(84.0))).otherwise(score)))


def hotness_label(score: Column) -> Column:
    out = F.lit(LOWEST_LABEL)
    for least, label in reversed(LABELS):
        out = F.when(score >= least, label).otherwise(out)
    return out


def reliability(average: Column, n: Column, official: Column, speculative: Column, penalty: Column | float = 0.0) -> Column:
    """N11."""
    shared = F.least(F.lit(18.0), F.greatest(F.lit(0.0), n - 1.0) * 6.0)
    penalty = penalty if isinstance(penalty, Column) else F.lit(float(penalty))
    plus = F.when(official, 12.0).otherwise(0.0)
    minus = F.when(speculative, 15.0).otherwise(0.0)
    return half_up(clamp(average * 0.72 + shared + plus - minus - penalty))


def personalization(followed: Column, hot: Column, rel: Column, age: Column, penalty: float = 0.0) -> Column:
    """Not clamped, may be negative."""
    recent = F.greatest(F.lit(0.0), F.lit(100.0) - age * 2.5)
    return half_up(F.when(followed, 32.0).otherwise(0.0) + hot * 0.25 + rel * 0.2 + recent * 0.23 - F.lit(float(penalty)))


def importance(title: Column, category: Column, given: Column | None = None) -> Column:
    """A given value unless it is 0, else by two patterns."""
    t = F.lower(F.concat(title, F.lit(" "), category))
    found = F.when(t.rlike(MAJOR), 88.0).when(t.rlike(LEAGUE), 76.0).otherwise(58.0)
    return found if given is None else F.coalesce(F.nullif(given.cast("double"), F.lit(0.0)), found)


def speculative(title: Column, excerpt: Column) -> Column:
    """F14."""
    return F.lower(F.concat(title, F.lit(" "), excerpt)).rlike(SPECULATIVE)


def velocity(n: Column, age: Column) -> Column:
    """N13."""
    return F.least(F.lit(100.0), F.lit(28.0) + n * 17.0 + F.greatest(F.lit(0.0), F.lit(24.0) - age))


def trending_reasons(n: Column, age: Column, imp: Column) -> Column:
    """N16."""
    return F.array(
        F.when(n >= 2, F.concat(n.cast("int").cast("string"), F.lit(" nguồn độc lập cùng đưa tin"))).otherwise("Mới xuất hiện trên một nguồn"),
        F.when(age <= 6, "Được đăng trong 6 giờ gần đây").otherwise("Độ mới đang giảm theo thời gian"),
        F.when(imp >= 76, "Liên quan đội tuyển, giải đấu hoặc sự kiện lớn").otherwise("Mức quan tâm được ước tính từ chủ đề"),
    )


def match_status(short: Column) -> Column:
    """N15, short codes."""
    return F.when(short.isin(*LIVE_CODES), "live").when(short.isin(*DONE_CODES), "finished").otherwise("scheduled")


def match_status_text(status: Column) -> Column:
    """N15, words."""
    return F.when(status.isin(*LIVE_WORDS), "live").when(status == "FINISHED", "finished").otherwise("scheduled")
