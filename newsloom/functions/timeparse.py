"""Publication times of many feeds as UTC. Forms that are not listed give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WEEKDAY = r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
_US = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])$"
# Hours of the zone names of RFC 822; EST stands for either time of its year and is read apart.
_ZONES = {"EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
_RFC = ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss xxx", "d MMM yyyy HH:mm xx")


def _instant(text: Column) -> Column:
    """ISO dates and times (without zone: UTC, as the session is) and RFC 822 with offset or zone name."""
    rfc = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), r"(?i)\s*(?:GMT|UTC|UT|Z)$", " +0000")
    for name, hours in _ZONES.items():
        rfc = F.regexp_replace(rfc, rf"(?i)\s*\b{name}$", f" {hours}")
    iso = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[Tt ]", "$1 ")
    is_iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?$")
    found = F.when(is_iso, iso.try_cast("timestamp"))
    for pattern in _RFC:
        found = F.coalesce(found, F.try_to_timestamp(rfc, F.lit(pattern)))
    return found


def normalize_timestamp(value: Column, now: Column, vietnamese: Column) -> Column:
    """Text -> UTC timestamp, in the steps of SURVEY 2.10; more than ten minutes ahead of now becomes now."""
    t = F.trim(F.regexp_replace(value, "[  ]", " "))
    n = lambda i: F.regexp_extract(t, _US, i)
    hour = n(4).cast("int") % 12 + F.when(F.upper(n(7)) == "PM", 12).otherwise(0)
    local = F.try_to_timestamp(
        F.concat_ws(" ", F.concat_ws("-", n(3), F.lpad(n(1), 2, "0"), F.lpad(n(2), 2, "0")), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), n(5), F.coalesce(F.nullif(n(6), F.lit("")), F.lit("00")))),
        F.lit("yyyy-MM-dd HH:mm:ss"),
    )
    as_gmt = _instant(F.regexp_replace(t, r"(?i)\b[BE]ST$", "GMT"))
    summer = F.month(as_gmt).between(3, 11)
    parsed = (
        F.when(vietnamese & t.rlike(_US), local - F.expr("INTERVAL 7 HOURS"))
        .when(t.rlike(r"(?i)\bBST$"), as_gmt - F.expr("INTERVAL 1 HOUR"))
        .when(t.rlike(r"(?i)\bEST$"), as_gmt + F.when(summer, F.expr("INTERVAL 4 HOURS")).otherwise(F.expr("INTERVAL 5 HOURS")))
        .otherwise(_instant(t))
    )
    return F.when(parsed > now + F.expr("INTERVAL 10 MINUTES"), now).otherwise(parsed)
