"""Enrichment by an outside model, behind an interface and off unless one is given.

Articles are asked about in batches, inside tasks. Answers are kept by the hash of what was asked, so nothing is asked twice:
an anti-join leaves only what has no answer yet, and equal articles are asked about once. A batch whose call fails has no
answers this time; articles without one stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BATCH, LARGEST_POINTS = 20, 3
ANSWER = "hash string, title string, summary string, key_points array<string>, topic string, importance int"
#: What a model gets, a list of {"id", "title", "excerpt"}, and gives: a list of {"id", "title", "summary", "key_points", "topic", "importance"}.
Ask = Callable[[list[dict]], list[dict]]


def asked_hash(title: Column, excerpt: Column) -> Column:
    """What tells questions apart. Null counts as empty."""
    return F.sha2(F.to_json(F.array(F.coalesce(title, F.lit("")), F.coalesce(excerpt, F.lit("")))), 256)


def accepted_answer(answer: object, ids: set[str]) -> tuple | None:
    """A row of ANSWER, if it belongs to what was asked, says something in title and summary, and keeps to its schema."""
    if not isinstance(answer, dict) or answer.get("id") not in ids or not answer.get("title") or not answer.get("summary"):
        return None
    points, importance = answer.get("key_points"), answer.get("importance")
    if not isinstance(points, list) or not 1 <= len(points) <= LARGEST_POINTS or not all(isinstance(p, str) for p in points):
        return None
    if type(importance) is not int or not 0 <= importance <= 100 or not all(isinstance(answer[c], str) for c in ("title", "summary")) or not isinstance(answer.get("topic"), str):
        return None
    return answer["id"], answer["title"], answer["summary"], points, answer["topic"], importance


def answers_at(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(ANSWER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ANSWER)


def _ask_all(ask: Ask, batch: int):
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = [dict(zip(("id", "title", "excerpt"), r.values())) for r in b.slice(at, batch).to_pylist()]
                try:
                    said = ask(some)
                except Exception:  # noqa: BLE001  a call that fails leaves its articles without an answer
                    continue
                ids = {r["id"] for r in some}
                fine = {r[0]: r for a in said if (r := accepted_answer(a, ids))}  # of two answers to one question the last
                if fine:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*fine.values()), kinds)], [c.split()[0] for c in ANSWER.split(", ")])

    return run


def enriched(articles: DataFrame, candidates: DataFrame, path: str, ask: Ask | None = None, batch: int = BATCH) -> DataFrame:
    """articles (title, excerpt, ...) with the answers to `candidates`, rows of them: title, excerpt, translated, topic, key_points, importance.

    Answers are read from path, and what has none is asked and appended there before; without `ask` nothing is asked or
    read, and nothing is translated. Articles have a unique seq; null titles and excerpts are asked as empty ones.
    """
    plain = {"translated": F.lit(False), "topic": F.lit(None).cast("string"), "key_points": F.lit(None).cast("array<string>"), "importance": F.lit(None).cast("int")}
    if ask is None:
        return articles.withColumns(plain)
    spark = articles.sparkSession
    chosen = candidates.select("seq", asked_hash(F.col("title"), F.col("excerpt")).alias("hash"), "title", "excerpt")
    open_ = chosen.groupBy("hash").agg(F.first(F.coalesce("title", F.lit(""))).alias("title"), F.first(F.coalesce("excerpt", F.lit(""))).alias("excerpt"))
    open_ = open_.join(answers_at(spark, path).select("hash"), "hash", "left_anti")
    open_.select("hash", "title", "excerpt").mapInArrow(_ask_all(ask, batch), ANSWER).write.mode("append").parquet(path)
    known = answers_at(spark, path).groupBy("hash").agg(F.max(F.struct("title", "summary", "key_points", "topic", "importance")).alias("answer"))
    a = chosen.select("seq", "hash").join(known, "hash").select("seq", "answer")
    return articles.join(a, "seq", "left").withColumns({
        "title": F.coalesce("answer.title", "title"), "excerpt": F.coalesce("answer.summary", "excerpt"), "translated": F.col("answer").isNotNull(),
        "topic": F.col("answer.topic"), "key_points": F.col("answer.key_points"), "importance": F.col("answer.importance"),
    }).drop("answer")


def over_http(url: str, headers: dict[str, str], request: Callable[[list[dict]], dict], answers: Callable[[dict], list[dict]], timeout: float = 35.0) -> Ask:
    """A model behind an address: `request` makes the JSON body, `answers` takes the list out of the JSON that comes back."""

    def ask(some: list[dict]) -> list[dict]:
        import urllib.request

        body = json.dumps(request(some)).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json", **headers}), timeout=timeout) as r:
            return answers(json.loads(r.read()))

    return ask
