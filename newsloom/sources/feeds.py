"""Feeds: registry, RSS and Atom, JSON and pattern scans over landed files."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import text
from newsloom.functions.timeparse import normalize_timestamp

# The built-in feeds.
DEFAULT_FEEDS = (
    ("VFF", "https://vff.org.vn/feed/", 98, "vi", True),
    ("VPF", "https://vpf.vn/feed/", 98, "vi", True),
    ("VnExpress Thể thao", "https://vnexpress.net/rss/the-thao.rss", 92, "vi", False),
    ("Tuổi Trẻ Thể thao", "https://tuoitre.vn/rss/the-thao.rss", 91, "vi", False),
    ("Thanh Niên Thể thao", "https://thanhnien.vn/rss/the-thao.rss", 90, "vi", False),
    ("VietNamNet Thể thao", "https://vietnamnet.vn/rss/the-thao.rss", 89, "vi", False),
    ("Dân trí Thể thao", "https://dantri.com.vn/rss/the-thao.rss", 89, "vi", False),
    ("VOV Thể thao", "https://vov.vn/rss/the-thao.rss", 91, "vi", False),
    ("BBC Sport Football", "https://feeds.bbci.co.uk/sport/football/rss.xml", 94, "en", False),
    ("The Guardian Football", "https://www.theguardian.com/football/rss", 92, "en", False),
    ("ESPN Soccer", "https://www.espn.com/espn/rss/soccer/news", 90, "en", False),
    ("Sky Sports Football", "https://www.skysports.com/rss/12040", 90, "en", False),
)
# What stands for what an item lacks, and the names of feeds given as a list.
NO_EXCERPT, NO_CATEGORY, PATTERN_EXCERPT = "Đọc nội dung đầy đủ tại nguồn gốc.", "Thể thao", "Trích đoạn ngắn từ RSS."
CUSTOM_NAME = "Nguồn tùy chỉnh "
PER_FEED, RELIABILITY, LANGUAGE = 16, 85, "vi"


def feed_registry(spark: SparkSession, config: str | None = None) -> DataFrame:
    """Feeds of a JSON array, else (also where it is broken) of a list with commas, else the built-in ones; only valid ones."""
    config = (config or "").strip()
    if not config:
        return spark.createDataFrame([list(f) for f in DEFAULT_FEEDS], schemas.FEED_CONFIG)
    one = spark.createDataFrame([(config,)], "config string")
    kinds = f"array<struct<{','.join(':'.join(c.split()) for c in schemas.FEED_CONFIG.split(', '))}>>"
    try:
        if not isinstance(json.loads(config), list):
            raise ValueError("feeds are a JSON array")
        feeds = one.select(F.inline(F.from_json("config", kinds))).withColumn("official", F.coalesce("official", F.lit(False)))
        return feeds.where((F.length("name") > 0) & F.col("url").startswith("https://") & F.col("language").isin("vi", "en"))
    except ValueError:  # no JSON, or no array
        urls = one.select(F.posexplode(F.split("config", ",")).alias("n", "url")).select("n", text.trim_space(F.col("url")).alias("url"))
        name = F.concat(F.lit(CUSTOM_NAME), (F.col("n") + 1).cast("string"))
        return urls.where(F.col("url").startswith("https://")).select(name.alias("name"), "url", F.lit(RELIABILITY).alias("reliability"), F.lit(LANGUAGE).alias("language"), F.lit(False).alias("official"))


_LINK, _GUID = "array<struct<`#text`:string,`@_href`:string>>", "struct<`#text`:string>"
_ITEM = {
    "title": "string", "link": _LINK, "guid": _GUID, "id": "string", "description": "string", "summary": "string", "content": "string", "pubDate": "string",
    "published": "string", "updated": "string", "category": "array<string>",
}
_XML = {"attributePrefix": "@_", "valueTag": "#text", "mode": "PERMISSIVE"}


def _fields(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Items of landed XML as text; a link may be text or an attribute."""
    schema = ", ".join(f"{name} {kind}" for name, kind in _ITEM.items())
    return spark.read.format("xml").schema(schema).options(rowTag=tag, **_XML).load(path).select("*", F.col("_metadata.file_path").alias("file"))


def _valid_articles(first: DataFrame, now: Column, *keep: str) -> DataFrame:
    """Items, with their feed's source, feed_url, reliability, language and official, as articles; only valid ones.

    A link is its address, else its text, else the feed's own address. Rows without title, without a link to http(s), or
    whose time cannot be read, are dropped.
    """
    link = F.get("link", F.lit(0))
    excerpt = F.left(text.clean_text(F.col("description")), F.lit(520))
    when = normalize_timestamp(F.coalesce("pubDate", "published", "updated"), now, F.coalesce(F.col("language") == "vi", F.lit(False)))
    raw = first.select(
        *keep, "pos", text.clean_text(F.col("title")).alias("title"), F.coalesce(link["@_href"], link["#text"], "feed_url").alias("url"),
        F.coalesce(F.nullif(excerpt, F.lit("")), F.lit(NO_EXCERPT)).alias("excerpt"), F.col("guid.`#text`").alias("guid"),
        F.coalesce(F.nullif(text.clean_text(F.get("category", F.lit(0))), F.lit("")), F.lit(NO_CATEGORY)).alias("category"), when.alias("published"),
        "source", "reliability", "language", "official", F.lit(False).alias("translated"),
    )
    valid = raw.where((F.length("title") > 0) & F.col("url").startswith("http") & F.col("published").isNotNull())
    return valid.withColumn("id", text.content_hash(F.col("title"), F.coalesce("guid", "url"))).drop("guid")


def rss_items(spark: SparkSession, path: str, now: Column, feeds: DataFrame | None = None, per_feed: int = PER_FEED) -> DataFrame:
    """Raw articles of all feeds landed under path: the first `per_feed` items of each file, of these the valid ones.

    A file is a feed. feeds has (file: the end of the landed file's path, name, url, reliability, language, official); a
    file that it lacks has null there and no Vietnamese times.
    """
    both = _fields(spark, path, "item").withColumn("kind", F.lit(0)).unionByName(_fields(spark, path, "entry").withColumn("kind", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("file").orderBy("kind", "at"))
    first = both.withColumn("at", F.monotonically_increasing_id()).withColumn("pos", place).where(F.col("pos") <= per_feed)
    feeds = feeds if feeds is not None else spark.createDataFrame([], f"file string, {schemas.FEED_CONFIG}")
    known = feeds.select(F.col("file").alias("f_file"), F.col("name").alias("source"), F.col("url").alias("feed_url"), "reliability", "language", F.coalesce("official", F.lit(False)).alias("official"))
    first = first.join(F.broadcast(known), F.col("file").endswith(F.col("f_file")), "left")  # a registry of feeds is a small list
    return _valid_articles(first, now, "file")


def feed_articles(bodies: DataFrame, feeds: DataFrame, now: Column, per_feed: int = PER_FEED) -> DataFrame:
    """S01, P01, F07 of feeds read as (source, place, body): RSS or Atom; one item or many; the first `per_feed` of each feed.

    feeds (name, url, reliability, language, official) tells about sources by name. seq numbers articles feed after feed,
    in the order of the list: what the news items of operators.feed start from. A body that is no XML has no items.
    """
    item = ",".join(f"{name}:{kind}" for name, kind in _ITEM.items())
    parsed = F.from_xml("body", f"channel struct<item:array<struct<{item}>>>, entry array<struct<{item}>>", _XML)
    items = F.slice(F.coalesce(F.col("x.channel.item"), F.col("x.entry")), 1, per_feed)
    each = bodies.select("source", "place", parsed.alias("x")).select("source", "place", F.posexplode(items).alias("pos", "item")).select("source", "place", (F.col("pos") + 1).alias("pos"), "item.*")
    known = feeds.select(F.col("name").alias("source"), F.col("url").alias("feed_url"), "reliability", "language", F.coalesce("official", F.lit(False)).alias("official"))
    valid = _valid_articles(each.join(F.broadcast(known), "source"), now, "place")  # a registry of feeds is a small list
    return valid.withColumn("seq", F.col("place").cast("long") * per_feed + F.col("pos") - 1).drop("place", "pos")


def json_articles(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON arrays of external articles. A file that holds anything but an array is an error when it is read."""
    landed = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    checked = F.when(F.col("v").rlike(r"^\s*\["), F.col("v")).otherwise(F.raise_error(F.lit("a JSON source must hold an array")))
    return landed.select(F.inline(F.from_json(checked, f"array<struct<{','.join(':'.join(c.split()) for c in schemas.EXTERNAL_ARTICLE.split(', '))}>>")))


def pattern_articles(landed: DataFrame, limit: int = 30) -> DataFrame:
    """(url, xml) -> items with a title in CDATA and a link on one line, by pattern: the first `limit`, external_id = place-link."""
    pattern = r"(?s)<item>.*?<title><!\[CDATA\[(.*?)\]\]></title>.*?<link>([^\n\r\u2028\u2029]*?)</link>.*?</item>"
    both = F.slice(F.arrays_zip(F.regexp_extract_all("xml", F.lit(pattern), F.lit(1)).alias("title"), F.regexp_extract_all("xml", F.lit(pattern), F.lit(2)).alias("link")), 1, limit)
    rows = landed.select(F.posexplode(both).alias("n", "x"))
    return rows.select(
        F.concat_ws("-", F.col("n").cast("string"), "x.link").alias("external_id"), text.trim_space(F.col("x.title")).alias("title"),
        text.trim_space(F.col("x.link")).alias("url"), F.lit(PATTERN_EXCERPT).alias("excerpt"),
    )


def mock_articles(items: DataFrame, now: Column, limit: int = 5, site: str = "https://example.com/demo/") -> DataFrame:
    """The first items (seq, id, slug, title, summary) as external articles; a report of five by its nature."""
    return items.orderBy("seq").limit(limit).select(
        F.col("id").alias("externalId"), F.concat(F.lit(site), "slug").alias("url"), "title", F.col("summary").alias("excerpt"), now.alias("publishedAt")
    )


def normalized(articles: DataFrame, source_id: str) -> DataFrame:
    """P03."""
    return articles.withColumns({
        "hash": text.content_hash(F.col("title"), F.col("url")), "title": F.regexp_replace(text.trim_space(F.col("title")), f"{text.SPACE}+", " "),
        "excerpt": F.left(text.trim_space(F.col("excerpt")), F.lit(500)), "source_id": F.lit(source_id), "language": F.lit("vi"),
    })


def retried(fetch: Callable[[], object], attempts: int = 2, wait: float = 0.0) -> object:
    """The ingestion side's retry; the last error is raised."""
    for n in range(attempts):
        try:
            return fetch()
        except OSError:
            if n + 1 == attempts:
                raise
            time.sleep(wait)
    raise ValueError("attempts is at least 1")


def union_of_available(reads: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The sources whose plans can be made, one after the other; an error only if none can.

    What fails while rows are read fails the action; sources.landed reads sources of which some may do that.
    """
    out, errors = None, []
    for n, read in enumerate(reads):
        try:
            df = read().withColumn("feed_pos", F.lit(n))
        except Exception as e:  # noqa: BLE001  whatever a source fails with, the others go on
            errors.append(e)
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise RuntimeError(f"no source could be read: {errors}")
    return out
