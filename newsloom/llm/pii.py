"""Personal data in DataFrame operations only: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds in their order, what proposes them, their score out of 100, words near them that add CONTEXT_ADDS.
# The patterns of email and ip say the same as the plain ones of OP7_SQL; possessive, and begun only where a run of
# characters begins or the last match ended, they need no second look at a long run.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE_KINDS = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "local_phone": r"[0-9]{3}-[0-9]{4}",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "local_phone": "-"}
SCORES = {"email": 80, "ip": 60, "card": 85, "phone": 70, "iban": 85, "local_phone": 40}
CONTEXT = {
    "email": "(?i)mail|contact|write",
    "ip": "(?i)server|host|address|login",
    "card": "(?i)card|visa|pay|credit",
    "phone": "(?i)phone|call|tel|mobile|fax",
    "iban": "(?i)iban|bank|account",
    "local_phone": "(?i)phone|call|tel|mobile|fax",
}
CONTEXT_ADDS, KEPT_FROM, NEAR = 15, 50, 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def step(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number's remainder by 97 is 1, its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest, c):
        v = F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _proposed(text: Column, kind: str) -> Column:
    """kind, i, gap (length of what is between the match before and this one), its end and begin, match; a last row without match."""
    pattern = PATTERNS[kind]
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(NEAR)).alias("before"), F.left(p, F.lit(NEAR)).alias("after")))
    both = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    rows = F.transform(both, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["p"]["gap"].alias("gap"), z["p"]["before"].alias("before"), z["p"]["after"].alias("after"), z["m"].alias("m")))
    can = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.isNotNull()
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,before:string,after:string,m:string>>")
    return F.coalesce(F.when(can & text.rlike("[0-9@]"), rows), none)


def _valid() -> Column:
    """Over kind, m, before, after: whether the match is what its kind asks for."""
    digits = F.regexp_replace("m", "[^0-9]", "")
    n = F.length(digits)
    free = ~F.right("before", F.lit(1)).rlike("[A-Za-z0-9+-]") & ~F.left("after", F.lit(1)).rlike("[A-Za-z0-9-]")
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.col("m").rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .when(F.col("kind") == "iban", free & mod97(F.col("m")))
        .otherwise(free)
    )


def find_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, found: one row for each row of docs.

    found is an array of (start, kind_no, kind, end, score), by start and then kind; places count
    code points from 0, the end is exclusive. Matches of a kind are leftmost and do not overlap;
    one that fails its check is dropped without another try. Spans of the base kinds stay whatever
    their score; account numbers and local phone numbers need a free-standing match and
    KEPT_FROM points. Null text is empty; a text without matches has an empty array.
    """
    text = F.col("text")
    all_kinds = F.concat(*[_proposed(text, k) for k in KINDS])
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = numbered.select("doc_id", "row", F.explode_outer(all_kinds).alias("c")).select("doc_id", "row", "c.*")
    # One exchange by row serves the running sums and the grouping. A row's matches are bounded by its text.
    rows = rows.repartition("row")
    up_to = Window.partitionBy("row", "kind").orderBy("i")
    width = F.coalesce(F.length("m"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("gap") + width).over(up_to)).withColumn("after", F.lead("after").over(up_to))
    near = F.concat_ws(" ", "before", "after")
    score, base, number = F.lit(0), F.lit(0), F.lit(-1)
    for i, k in enumerate(KINDS):
        mine = F.col("kind") == k
        score = F.when(mine, SCORES[k] + F.when(near.rlike(CONTEXT[k]), CONTEXT_ADDS).otherwise(0)).otherwise(score)
        number = F.when(mine, i).otherwise(number)
    rows = rows.withColumn("score", score).withColumn("kind_no", number)
    kept = F.col("m").isNotNull() & _valid() & (F.col("kind").isin(*BASE_KINDS) | (F.col("score") >= KEPT_FROM))
    span = F.when(kept, F.struct((F.col("end") - width).alias("start"), "kind_no", "kind", "end", "score"))
    return rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("found")).drop("row")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, BASE_KINDS),
        F.sha2(_joined(F.filter("found", lambda s: s["kind_no"] < len(BASE_KINDS))), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        *map(number, KINDS[len(BASE_KINDS) :]),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0)).alias("top_score"),
    )


def _sql() -> str:
    plain = PATTERNS | {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
    }
    each = "\nUNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {i} AS kind_no, {SCORES[k]} AS points, '{CONTEXT[k]}' AS words, "
        f"regexp_extract_all(text, '{plain[k]}') AS ms, regexp_split_to_array(text, '{plain[k]}') AS ps FROM d"
        for i, k in enumerate(KINDS)
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({each}),
z AS (SELECT doc_id, kind, kind_no, points, words, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM k WHERE len(ms) > 0),
r AS (SELECT doc_id, kind, kind_no, points, words, i, ms[i] AS m, length(ps[i]) AS gap,
             right(ps[i], {NEAR}) AS bef, left(ps[i + 1], {NEAR}) AS aft FROM z),
w AS (SELECT *, CAST(sum(gap + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e,
             regexp_replace(m, '[^0-9]', '', 'g') AS digits,
             points + CASE WHEN regexp_matches(bef || ' ' || aft, words) THEN {CONTEXT_ADDS} ELSE 0 END AS score,
             NOT regexp_matches(right(bef, 1), '[A-Za-z0-9+-]') AND NOT regexp_matches(left(aft, 1), '[A-Za-z0-9-]') AS free
      FROM r),
v AS (SELECT *, CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: TRY_CAST(x AS HUGEINT) <= 255)) = 4
        WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
             CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INT)
                  WHEN CAST(substr(reverse(digits), i, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse(digits), i, 1) AS INT) - 9
                  ELSE 2 * CAST(substr(reverse(digits), i, 1) AS INT) END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
        WHEN 'iban' THEN free AND list_reduce(list_prepend(0, list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c:
             CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1
        ELSE free END AS ok FROM w),
g AS (SELECT doc_id, kind, kind_no, score, e - length(m) AS s, e FROM v WHERE ok AND (kind_no < 4 OR score >= {KEPT_FROM})),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)}, max(score) AS top_score,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (WHERE kind_no < 4) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, CAST(coalesce(top_score, 0) AS INT) AS top_score
FROM d LEFT JOIN a USING (doc_id)
"""


OP7_SQL = _sql()
