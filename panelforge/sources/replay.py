"""REST-like sources as Spark data sources, replayed from files that Spark lists: no network.

A feed is a folder of JSON lines files. The driver only reads the small page index
that a reader's options name; pages themselves are opened by the tasks.
"""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FetchError(Exception):
    """A call that may be tried again; wait: seconds the other side asks for, if it does."""

    def __init__(self, message: str, wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


class RateLimit:
    """At most so many calls in any span of seconds; waits before a call that would be one too many."""

    def __init__(self, calls: int, span: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.calls, self.span, self.clock, self.sleep = calls, span, clock, sleep
        self.made: list[float] = []

    def wait(self) -> None:
        now = self.clock()
        self.made = [t for t in self.made if now - t < self.span]
        if len(self.made) >= self.calls:
            self.sleep(self.span - (now - self.made[0]))
            now = self.clock()
            self.made = [t for t in self.made if now - t < self.span]
        self.made.append(now)


def with_retry(call: Callable, tries: int = 3, first_wait: float = 1.0, factor: float = 2.0, jitter: float = 0.0, sleep: Callable[[float], None] = time.sleep, default=None):
    """call(), again after growing waits where it fails; after the last failure the default: a run goes on without that source."""
    for k in range(tries):
        try:
            return call()
        except FetchError as e:
            if k + 1 == tries:
                return default
            sleep((e.wait if e.wait is not None else first_wait * factor**k) + random.uniform(0, jitter))
    return default


class PagedReplay(DataSource):
    """Message pages: option path names a folder with symbol=<s>/page-<k>.json files, each a JSON list of messages, newest first.

    Pages are followed as a cursor feed would be: the next page holds older ids, and
    reading stops at ``max_pages``, at a short page (under ``page_size``) or at an id
    already seen. Option symbols limits the feed, in the order given; without it all
    are read. ``calls`` and ``span`` bound the calls of a task in time.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_replay"

    def schema(self) -> str:
        return "symbol string, id bigint, body string, created_at string, sentiment string"

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.max_pages, self.page_size = options["path"], int(options.get("max_pages", "5")), int(options.get("page_size", "30"))
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.calls, self.span = int(options.get("calls", "150")), float(options.get("span", "3600"))

    def partitions(self):
        # names only; a symbol's pages are read where its task runs
        names = self.symbols or sorted(d.removeprefix("symbol=") for d in os.listdir(self.path) if d.startswith("symbol="))
        return [InputPartition(s) for s in names]

    def _page(self, symbol: str, k: int) -> list[dict]:
        file = f"{self.path}/symbol={symbol}/page-{k}.json"
        if not os.path.exists(file):
            return []
        try:
            with open(file) as f:
                return json.load(f)
        except (OSError, ValueError) as e:
            raise FetchError(str(e)) from e

    def read(self, partition):
        limit, seen = RateLimit(self.calls, self.span), set()
        for k in range(self.max_pages):
            limit.wait()
            page = with_retry(lambda k=k: self._page(partition.value, k), first_wait=0.01, default=[])
            for m in page:
                if m["id"] in seen:
                    return
                seen.add(m["id"])
                yield (partition.value, m["id"], m.get("body"), m.get("created_at"), ((m.get("entities") or {}).get("sentiment") or {}).get("basic"))
            if len(page) < self.page_size:
                return


def trending(messages: DataFrame, n: int = 30) -> DataFrame:
    """The symbols with most messages, ties by name: what a feed's trending list gives."""
    return messages.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "symbol").limit(n)


def read_forum(spark: SparkSession, path: str, feeds: tuple[str, ...] = ("hot", "new", "rising")) -> DataFrame:
    """Posts of a forum's feeds (files <feed>.json, one JSON object a line), each post once, from the first feed that has it.

    A feed without a file is left out; lines that do not parse are too.
    """
    fields = "post_id string, created_utc double, title string, body string, score long, num_comments long"
    files = spark.read.schema(fields).json(path, mode="DROPMALFORMED", pathGlobFilter="{" + ",".join(f"{f}.json" for f in feeds) + "}")
    rank = F.array_position(F.array(*[F.lit(f) for f in feeds]), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    marked = files.withColumn("feed", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)).withColumn("feed_rank", rank).where("post_id is not null")
    once = marked.withColumn("feed_row", F.row_number().over(Window.partitionBy("post_id").orderBy("feed_rank", F.col("score").desc_nulls_last())))
    return once.where("feed_row = 1").drop("feed_row", "feed_rank")


class BarReplay(DataSource):
    """Daily bars by chunks of symbols from a folder of <symbol>.json files [[date, close, volume], ...]; symbols with / are skipped.

    Options start and warm_up (days, 60 if none): rows from warm_up days before the start
    on are read, so that indicators are warm on the first day asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "bar_replay"

    def schema(self) -> str:
        return "ticker string, date string, close double, volume double"

    def reader(self, schema):
        return _BarReader(self.options)


class _BarReader(DataSourceReader):
    def __init__(self, options) -> None:
        from datetime import date, timedelta

        self.path, self.chunk = options["path"], int(options.get("chunk", "100"))
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        start = options.get("start")
        self.since = (date.fromisoformat(start) - timedelta(days=int(options.get("warm_up", "60")))).isoformat() if start else ""

    def partitions(self):
        names = self.symbols or [f.removesuffix(".json") for f in os.listdir(self.path) if f.endswith(".json")]
        names = sorted(s for s in names if "/" not in s)
        return [InputPartition(names[i : i + self.chunk]) for i in range(0, len(names), self.chunk)]

    def read(self, partition) -> Iterator[tuple]:
        for s in partition.value:
            file = f"{self.path}/{s}.json"
            if not os.path.exists(file):
                continue
            with open(file) as f:
                for day, close, volume in json.load(f):
                    if day >= self.since:
                        yield (s, day, float(close), float(volume))


def prices_with_fallback(live: DataFrame, spare: DataFrame) -> DataFrame:
    """All bars of the live source, and the spare source's for tickers that the live one lacks altogether; source tells which."""
    have = live.select("ticker").distinct()
    rest = spare.join(have, "ticker", "left_anti")
    return live.withColumn("source", F.lit("live")).unionByName(rest.withColumn("source", F.lit("spare")), allowMissingColumns=True)


def write_by_ticker(bars: DataFrame, path: str) -> None:
    """One folder a ticker; only tickers written are replaced."""
    bars.repartition("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)
