"""Folding, tokens, slugs and hashes of multilingual text, as JVM-side expressions."""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that tell nothing about a story. Compared with accent-folded tokens.
STOP_WORDS = (
    "cua và với trong trên cho sau trước khi là đã sẽ một những các được từ về tại theo vào ra qua do this that with from after "
    "before over into says said for the and but are was were has have had not new latest more than its their his her của đang không"
).split()
SPACE = r"[\s   -     　﻿]"


@functools.cache
def _fold_map() -> tuple[str, str]:
    """Letters whose canonical decomposition is one other letter and marks U+0300-036F; the marks themselves go."""
    src, dst = [], []
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
        if len(bare) == 1 and bare != c:
            src.append(c)
            dst.append(bare)
    return "".join(src) + "".join(map(chr, range(0x300, 0x370))), "".join(dst)


def strip_marks(x: Column) -> Column:
    return F.translate(x, *_fold_map())


def trim_space(x: Column) -> Column:
    """Without blanks of any kind, line ends and no-break ones too, at either end."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def normalize_title(x: Column) -> Column:
    """Lower case, no accents, other characters than a-z, 0-9 as blanks. A d with stroke is such a character."""
    bare = F.regexp_replace(strip_marks(F.lower(x)), rf"(?:(?!{SPACE})[^a-z0-9])", " ")
    return F.trim(F.regexp_replace(bare, f"{SPACE}+", " "))


def normalize_search(x: Column) -> Column:
    """As N02, but a d with stroke is a d."""
    bare = F.translate(strip_marks(F.lower(x)), "đ", "d")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def fold(given: str) -> str:
    """normalize_search of a constant, on the driver."""
    src, dst = _fold_map()
    table = {ord(c): dst[i] if i < len(dst) else None for i, c in enumerate(src)} | {ord("đ"): "d"}
    return re.sub("[^a-z0-9]+", " ", given.lower().translate(table)).strip(" ")


def slugify(x: Column) -> Column:
    """N05, the validating variant."""
    bare = F.translate(strip_marks(F.lower(x)), "đ", "d")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-|-$", "")


def slugify_plain(x: Column) -> Column:
    """N05, the variants that do not know the d with stroke."""
    return F.regexp_replace(F.regexp_replace(strip_marks(F.lower(x)), "[^a-z0-9]+", "-"), "^-|-$", "")


def slugify_ascii(x: Column) -> Column:
    """N05, the variant without decomposition."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def tokens(x: Column) -> Column:
    """The different folded words of more than two characters that are no stop words; hyphens stay."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    long = F.filter(F.split(F.lower(strip_marks(x)), "[^a-z0-9-]+"), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(long), stop)


def title_words(x: Column) -> Column:
    """N07's sets: different words of a normalized title, of more than two characters."""
    return F.array_distinct(F.filter(F.split(normalize_title(x), " "), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ > 0, both / any_).otherwise(0.0)


def fnv1a(x: Column) -> Column:
    """FNV-1a, 32 bits, over the first UTF-16 unit of every code point, as 8 hex digits."""
    points = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    units = F.transform(points, lambda c: F.when(c > 65535, F.lit(55296) + F.shiftright(c - 65536, 10)).otherwise(c).cast("bigint"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))
    return F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("bigint"), step))), 8, "0")


def content_hash(title: Column, url: Column) -> Column:
    """N06."""
    return fnv1a(F.concat(normalize_title(title), F.lit("|"), url))


@F.pandas_udf(StringType())
def decode_entities(x: pd.Series) -> pd.Series:
    """HTML entities have no built-in; batches go through Python's table."""
    return x.map(lambda s: None if s is None else html.unescape(s))


def clean_text(x: Column) -> Column:
    """Decode entities, drop scripts, styles and tags, collapse blanks."""
    given = F.coalesce(x, F.lit(""))
    t = F.when(F.contains(given, F.lit("&")), decode_entities(F.when(F.contains(given, F.lit("&")), given))).otherwise(given)
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]+>"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def initials(name: Column) -> Column:
    """First letters of the last two words, TBD for blank names."""
    given = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("TBD"))
    first = F.transform(F.filter(F.split(given, r"\s+"), lambda w: w != ""), lambda w: F.left(w, F.lit(1)))
    return F.upper(F.array_join(F.slice(first, F.greatest(F.lit(1), F.size(first) - 1), F.lit(2)), ""))


def related_terms(title: Column) -> Column:
    """Folded first two parts of a title, three characters or more."""
    parts = F.slice(F.split(title, "[:\\-–—]"), 1, 2)
    return F.filter(F.transform(parts, normalize_search), lambda t: F.length(t) >= 3)


def safe_url(x: Column) -> Column:
    """http or https to another host than this machine."""
    scheme, host = F.try_parse_url(x, F.lit("PROTOCOL")), F.try_parse_url(x, F.lit("HOST"))
    ok = F.lower(scheme).isin("http", "https") & ~F.lower(host).isin("localhost", "127.0.0.1", "::1", "[::1]")
    return F.coalesce(ok, F.lit(False))
