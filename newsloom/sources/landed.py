"""S01, S06, S07, S15, S16 while they are read: a Python data source with a partition for each source.

Every source is fetched in a task of its own, with retries and a time-out there. One that fails gives a row with its error
instead of failing the job, so the others go on; only if none can be read is that an error. As a stream it is polled: a
batch asks every source once, and the offset is the number of polls.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsloom.operators.shared import materialize

NAME = "newsloom_sources"
#: Attempts and seconds of a source, and of a feed.
ATTEMPTS, TIMEOUT, FEED_TIMEOUT = 2, 8.0, 12.0
_SCHEMA = "source string, place int, poll int, body string, error string, attempts int"


@dataclass
class OneSource(InputPartition):
    """A source's number in the list, its name and address, and the poll it is read in."""

    place: int
    name: str
    url: str
    poll: int = 0


def _bytes(url: str, timeout: float) -> bytes:
    """What stands at a web address, or in a file of any store that Arrow reaches."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/rss+xml, application/json, application/xml;q=0.9"}), timeout=timeout) as r:
            return r.read()
    from pyarrow import fs

    # Spark writes local addresses as file:/x, which Arrow takes for a relative path.
    store, path = fs.FileSystem.from_uri("file:///" + url[6:] if url.startswith("file:/") and not url.startswith("file://") else url)
    with store.open_input_stream(path) as f:
        return f.read()


def fetch(one: OneSource, attempts: int, timeout: float, wait: float = 0.0) -> tuple:
    """A row for a source: its body, or the last error after so many attempts of so many seconds."""
    error = ""
    for n in range(1, attempts + 1):
        pool = ThreadPoolExecutor(1)
        try:
            return one.name, one.place, one.poll, pool.submit(_bytes, one.url, timeout).result(timeout).decode(), None, n
        except Late:
            error = f"no answer within {timeout:g} s"
        except Exception as e:  # noqa: BLE001  whatever a source fails with becomes its row
            error = f"{type(e).__name__}: {e}"
        finally:
            pool.shutdown(wait=False)
        time.sleep(wait if n < attempts else 0)
    return one.name, one.place, one.poll, None, error, attempts


class _Options:
    def __init__(self, options: dict):
        self.sources = json.loads(options.get("sources", "[]"))
        self.attempts, self.timeout = int(options.get("attempts", ATTEMPTS)), float(options.get("timeout", TIMEOUT))
        self.polls = int(options.get("polls", 1))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> list[OneSource]:
        return [OneSource(n, name, url) for n, (name, url) in enumerate(self.o.sources)]

    def read(self, partition: OneSource | None) -> Iterator[tuple]:
        if partition is not None:  # Spark reads a list without sources once
            yield fetch(partition, self.o.attempts, self.o.timeout)


class _StreamReader(DataSourceStreamReader):
    """Offset: how many polls were made. Each call for the newest offset is a poll, until there were `polls` of them (0: no end)."""

    def __init__(self, options: dict):
        self.o, self.made = _Options(options), 0

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        self.made = self.made + 1 if not self.o.polls or self.made < self.o.polls else self.made
        return {"polls": self.made}

    def partitions(self, start: dict, end: dict) -> list[OneSource]:
        self.made = max(self.made, end["polls"])
        return [OneSource(n, name, url, poll) for poll in range(start["polls"], end["polls"]) for n, (name, url) in enumerate(self.o.sources)]

    def read(self, partition: OneSource) -> Iterator[tuple]:
        yield fetch(partition, self.o.attempts, self.o.timeout)

    def commit(self, end: dict) -> None:
        pass


class Sources(DataSource):
    """Options: sources (a JSON array of [name, address]), attempts, timeout in seconds, polls (of a stream)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _options(sources: list[tuple[str, str]], attempts: int, timeout: float) -> dict[str, str]:
    return {"sources": json.dumps([list(s) for s in sources]), "attempts": str(attempts), "timeout": str(timeout)}


def read_sources(spark: SparkSession, sources: list[tuple[str, str]], attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> tuple[DataFrame, DataFrame]:
    """Sources (name, address) -> those read (source, place, body), and those that failed (source, place, error, attempts).

    All are asked at once and each only here: what they gave is written to the shared folder. place is a source's number in
    the list. A list is small, as feeds are; their bodies never meet in one place. RuntimeError if there are sources and
    none could be read.
    """
    spark.dataSource.register(Sources)
    rows = materialize(spark.read.format(NAME).options(**_options(sources, attempts, timeout)).load())
    good, bad = rows.where("error IS NULL").select("source", "place", "body"), rows.where("error IS NOT NULL").select("source", "place", "error", "attempts")
    if sources and not good.limit(1).count():
        said = "; ".join(f"{r.source}: {r.error}" for r in bad.orderBy("place").limit(5).collect())
        raise RuntimeError(f"no source could be read: {said}")
    return good, bad


def poll_sources(spark: SparkSession, sources: list[tuple[str, str]], polls: int = 0, attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> DataFrame:
    """The same as a stream (source, place, poll, body, error, attempts) that asks every source once a batch; 0 polls: for ever."""
    spark.dataSource.register(Sources)
    return spark.readStream.format(NAME).options(**_options(sources, attempts, timeout), polls=str(polls)).load()


def files_under(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The files that Spark finds under a path, as sources named by their address."""
    return [(f, f) for f in sorted(spark.read.format("binaryFile").load(path).inputFiles())]


def json_rows(good: DataFrame, schema: str) -> DataFrame:
    """Bodies of JSON, a row a line -> source, place, and the schema's columns."""
    lines = good.select("source", "place", F.explode(F.split("body", "\n")).alias("line")).where("line <> ''")
    return lines.select("source", "place", F.from_json("line", schema).alias("row")).select("source", "place", "row.*")
