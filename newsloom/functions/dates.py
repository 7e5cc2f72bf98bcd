"""Times as readers of the feed see them, in the feed's own zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Ho_Chi_Minh"
# Units of a distance in time, the seconds that each is long, and words for past and future.
UNITS = (("giây", 1), ("phút", 60), ("giờ", 3600), ("ngày", 86400), ("tháng", 30 * 86400), ("năm", 365 * 86400))
PAST, FUTURE = "trước", "nữa"


def local(ts: Column) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), ZONE)


def clock(ts: Column) -> Column:
    """20:30"""
    return F.date_format(local(ts), "HH:mm")


def day_and_clock(ts: Column) -> Column:
    """20:30 13/07"""
    return F.date_format(local(ts), "HH:mm dd/MM")


def local_day(ts: Column) -> Column:
    """2026-07-13"""
    return F.date_format(local(ts), "yyyy-MM-dd")


def iso(ts: Column) -> Column:
    """2026-07-13T13:30:00.000Z, of a time in UTC"""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def distance(ts: Column, now: Column) -> Column:
    """5 giờ trước: in the largest unit that the distance reaches, rounded half up; twelve rounded months are a year."""
    gap = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    size = F.abs(gap)

    def told(unit: str, long: int) -> Column:
        n = F.floor(size / F.lit(float(long)) + 0.5)
        text = F.concat(n.cast("string"), F.lit(f" {unit}"))
        return F.when(n == 12, F.lit(f"1 {UNITS[5][0]}")).otherwise(text) if unit == UNITS[4][0] else text

    out = told(*UNITS[5])
    for (unit, long), (_, next_long) in reversed(list(zip(UNITS, UNITS[1:]))):
        out = F.when(size < next_long, told(unit, long)).otherwise(out)
    return F.concat(out, F.when(gap < 0, F.lit(f" {FUTURE}")).otherwise(F.lit(f" {PAST}")))
