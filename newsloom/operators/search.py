"""Search, relation, personalization and pages over news items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import fold, normalize_search
from newsloom.operators.ranking import with_rank

# Stems of transfer news, in folded text.
TRANSFER = "(chuyen nhuong|thuong vu|transfer|sign(?:s|ed|ing)?|deal|loan|gia nhap|dam phan|hop dong)"


#: Rows up to the end of a page that a task may hold.
NEAR = 10_000


def search_text() -> Column:
    """P11 of an item."""
    return normalize_search(F.concat_ws(" ", "title", "summary", "category", "competition", "team", F.concat_ws(" ", "sources"), F.concat_ws(" ", "key_points")))


def filter_items(items: DataFrame, query: str = "", competition: str = "", team: str = "", min_hotness: int = 0) -> DataFrame:
    """the conditions that are given; empty ones and 0 do not count. Cheap ones first."""
    if competition:
        items = items.where(F.col("competition") == competition)
    if team:
        items = items.where(F.col("team") == team)
    if min_hotness:
        items = items.where(F.col("hotness") >= min_hotness)
    return items.where(F.contains(search_text(), F.lit(fold(query)))) if query else items


def long_enough(query: str, least: int = 2) -> bool:
    """whether a folded query is worth a search; a page shows nothing for shorter ones."""
    return len(fold(query)) >= least


def source_class(kind: str) -> Column:
    """all, rss, vi (anything but English, null too), international, official, youtube."""
    english = F.col("language").eqNullSafe(F.lit("en"))
    return {
        "all": F.lit(True), "rss": F.lit(True), "vi": ~english, "international": english,
        "official": F.exists("sources", lambda s: s.rlike(r"(?i)\b(?:vff|vpf)\b")),
        "youtube": F.exists("sources", lambda s: s.rlike("(?i)youtube")),
    }[kind]


def is_transfer() -> Column:
    """F06."""
    return search_text().rlike(f"(?i){TRANSFER}")


def mentions(terms: list[str], least: int = 0) -> Column:
    """How many of the terms an item's search_text holds; terms shorter than `least` do not count, the empty one is in every text."""
    folded = [t for t in map(fold, terms) if len(t) >= least]
    # One pass over one value: as an argument of a lambda the text is computed once, however many terms there are.
    held = lambda text: sum((F.contains(text, F.lit(t)).cast("int") for t in folded), F.lit(0))
    return F.get(F.transform(F.array("search_text"), held), F.lit(0))


def related(items: DataFrame, terms: list[str], exclude: str | None = None, limit: int = 5) -> DataFrame:
    """T05."""
    if exclude is not None:
        items = items.where(F.col("id") != exclude)
    r = items.withColumn("search_text", search_text()).withColumn("relevance", mentions(terms, 3)).where("relevance > 0")
    return r.orderBy(F.desc("relevance"), F.desc("hotness"), F.desc("reliability"), "seq").limit(limit)


def personalized(items: DataFrame, followed: list[str]) -> DataFrame:
    """Items with their rank."""
    p = items.withColumn("search_text", search_text())
    plus = F.when(mentions(followed) > 0, 120).otherwise(0) if followed else F.lit(0)
    return p.withColumn("rank_score", plus + F.col("hotness") + F.col("reliability"))


def paginate(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Rows of one page, with page and total_pages; the page is held between 1 and the last. Rows that tie in `order` may change places.

    Near pages are the best rows of each task and then of all. For pages beyond NEAR rows places come from with_rank: no task
    sees more than its range of the sort, however far the page is. Who turns pages often stores the order once, in
    operators.pages. df's own columns page and total_pages are replaced.
    """
    pages = max(1, -(-df.count() // size))
    page = min(max(1, page), pages)
    if page * size <= NEAR:
        rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
        return rows.withColumns({"page": F.lit(page), "total_pages": F.lit(pages)})
    here = F.col("_place").between((page - 1) * size, page * size - 1)
    return with_rank(df, order, "_place").where(here).drop("_place").withColumns({"page": F.lit(page), "total_pages": F.lit(pages)}).orderBy(*order)


def page_strip(spark, page: int, total: int) -> DataFrame:
    """First, last and near pages, and whether a gap stands before."""
    p = spark.range(1, total + 1).withColumnRenamed("id", "page").where((F.col("page") == 1) | (F.col("page") == total) | (F.abs(F.col("page") - page) <= 1))
    before = F.lag("page").over(Window.orderBy("page"))
    return p.select("page", F.coalesce(F.col("page") - before > 1, F.lit(False)).alias("gap"), (F.col("page") == page).alias("active"))
