"""SQL fragments that the oracles share."""

from __future__ import annotations

from newsloom.functions import scoring
from newsloom.functions.text import STOP_WORDS
from newsloom.operators.search import TRANSFER  # noqa: F401
from newsloom.sources.articles import NOW


def d(x: object) -> str:
    return f"CAST({x} AS DOUBLE)"


def fold(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower({x})), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"


def title(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    words = rf"regexp_split_to_array(regexp_replace(lower(strip_accents({x})), '[^a-z0-9\s-]', ' ', 'g'), '\s+')"
    return f"list_distinct(list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains([{stop}], w)))"


def fnv(x: str) -> str:
    points = f"list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CAST(ord(c) AS BIGINT))"
    h = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {points}), lambda h, c: (xor(h, c) * CAST(16777619 AS BIGINT)) & CAST(4294967295 AS BIGINT))"
    return f"lpad(lower(to_hex({h})), 8, '0')"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + {d(0.5)}) AS INT)"


def clamp(x: str) -> str:
    return f"greatest({d(0)}, least({d(100)}, {x}))"


def hotness(age: str, n: str, rel: str, pop: str, vel: str, imp: str, verified: str) -> str:
    s = (
        f"(greatest({d(0)}, {d(100)} - {age} * {d(3)}) * {d(0.22)} + least({d(100)}, {n} * {d(22)}) * {d(0.16)} + {rel} * {d(0.16)} + {pop} * {d(0.12)}"
        f" + {vel} * {d(0.14)} + {imp} * {d(0.2)})"
    )
    return half_up(clamp(f"CASE WHEN NOT ({verified}) OR {n} < 2 THEN least({s}, {d(84)}) ELSE {s} END"))


def reliability(avg: str, n: str, official: str, spec: str, penalty: str = "0") -> str:
    return half_up(clamp(
        f"({avg} * {d(0.72)} + least({d(18)}, greatest({d(0)}, {n} - {d(1)}) * {d(6)}) + CASE WHEN {official} THEN {d(12)} ELSE {d(0)} END"
        f" - CASE WHEN {spec} THEN {d(15)} ELSE {d(0)} END - {d(penalty)})"
    ))


def personalization(followed: str, hot: str, rel: str, age: str, penalty: str = "0") -> str:
    return half_up(
        f"(CASE WHEN {followed} THEN {d(32)} ELSE {d(0)} END + {hot} * {d(0.25)} + {rel} * {d(0.2)} + greatest({d(0)}, {d(100)} - {age} * {d(2.5)}) * {d(0.23)} - {d(penalty)})"
    )


def velocity(n: str, age: str) -> str:
    return f"least({d(100)}, {d(28)} + {n} * {d(17)} + greatest({d(0)}, {d(24)} - {age}))"


def label(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN '{name}'" for least, name in scoring.LABELS) + f" ELSE '{scoring.LOWEST_LABEL}' END"


def speculative(t: str, e: str) -> str:
    return f"regexp_matches(lower({t} || ' ' || {e}), '{scoring.SPECULATIVE}')"


def importance(t: str) -> str:
    x = f"lower({t} || ' Bóng đá')"
    return f"CASE WHEN regexp_matches({x}, '{scoring.MAJOR}') THEN {d(88)} WHEN regexp_matches({x}, '{scoring.LEAGUE}') THEN {d(76)} ELSE {d(58)} END"


_N = r"CAST(regexp_extract(source, '(\d+)$', 1) AS INT)"

ARTICLES = f"""a AS (
  SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title, left(text, 520) AS excerpt,
         'https://news.example/' || CAST(doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR) AS url,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((doc_id * 7919) % 720 AS INT)) AS published,
         lang AS language, source, 80 + {_N} * 7 % 19 AS reliability, {_N} < 2 AS official
  FROM documents)"""

AGE = f"greatest({d(0)}, CAST(epoch(TIMESTAMP '{NOW}') - epoch(published) AS DOUBLE) / {d(3600)})"

ITEMS = ARTICLES + f""",
a1 AS (SELECT *, {AGE} AS age, {importance('title')} AS imp, CAST(reliability AS DOUBLE) AS rel,
              CASE WHEN language = 'en' THEN 'Bóng đá · Quốc tế' ELSE 'Bóng đá · Việt Nam' END AS category,
              CASE WHEN language = 'en' THEN 'Bóng đá quốc tế' ELSE 'Thể thao Việt Nam' END AS competition FROM a),
i AS (SELECT seq, 'rss-' || CAST(seq AS VARCHAR) AS id, title, left(excerpt, 420) AS summary, category, competition, source AS team,
             [source] AS sources, language, published, age, official,
             {hotness('age', d(1), 'rel', 'imp', velocity(d(1), 'age'), 'imp', 'official')} AS hotness,
             {reliability('rel', d(1), 'official', speculative('title', 'excerpt'))} AS reliability,
             {fold("title || ' ' || left(excerpt, 420) || ' ' || category || ' ' || competition || ' ' || source || ' ' || source || ' ' || title")} AS search_text
      FROM a1)"""
