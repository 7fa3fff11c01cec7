"""Micro-batch counterparts of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from panelforge.sources.files import append_new


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def dedup_within(stream: DataFrame, key: str, ts: str, delay: str = "7 days") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def append_incremental(stream: DataFrame, path: str, key: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Drain what is there: each batch is transformed and its new keys appended, so a replay adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        append_new(transform(df) if transform else df, path, key)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_stream(stream: DataFrame, ts: str, keys: list[str], aggs: list, delay: str = "1 day") -> DataFrame:
    """Tumbling event-time days in append mode: a day is final once the watermark has passed its end; rows later than that do not count."""
    days = stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, "1 day").alias("ds_day")).agg(*aggs)
    return days.withColumn("date", F.to_date("ds_day.start")).drop("ds_day")


def drain_days(days: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Final days into a store with a folder a date; a batch replaces the dates that it brings, so a replayed one changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        df.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    query = days.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return days.sparkSession.read.schema(days.schema).parquet(path)


def on_trading_dates(days: DataFrame, calendar: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Final days added up on the trading day on or after them; calendar: (date, trading_date)."""
    dated = days.join(calendar, "date").where("trading_date is not null")
    return dated.groupBy(*keys, "trading_date").agg(*[F.sum(c).alias(c) for c in sums])


class _Counter(StatefulProcessor):
    """Counts what a (date, ticker) has taken; a timer drops the count once no more rows of that day can come."""

    def __init__(self, cap: int, order: list[str], ts: str):
        self.cap, self.order, self.ts = cap, order, ts

    def init(self, handle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "n long")

    def _add(self, key, n: int) -> None:
        if not self.taken.exists():
            self.handle.registerTimer(int((pd.Timestamp(key[0]) + pd.Timedelta(days=1)).timestamp() * 1000))
        self.taken.update((n,))

    def handleInputRows(self, key, rows, timerValues):
        n = self.taken.get()[0] if self.taken.exists() else 0
        first = None
        for part in rows:  # no more than the free places are held
            if n < self.cap:
                first = part if first is None else pd.concat([first, part])
                first = first.sort_values(self.order, kind="stable").head(self.cap - n)
        if first is not None and len(first):
            self._add(key, n + len(first))
            yield first
        else:
            yield pd.DataFrame()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._add(key, int(initialState["gc_had"].iloc[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.taken.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def capped_stream(messages: DataFrame, cap: int, ts: str, key: str = "post_id", tickers: str = "tickers", order: list[str] | None = None, delay: str = "1 day", written: DataFrame | None = None) -> DataFrame:
    """Greedy capped selection as state: each message once, while any of its tickers is under the cap on the day of ts.

    Counters by (date, ticker) live in the state store and survive a restart with the
    checkpoint; without one, ``written`` (date, ticker of what was kept before) starts
    them. Rows of one batch go by ``order`` (ts and key, if none), batches in order of
    arrival. Copies of a key within the delay count once, as one message. Needs
    spark.sql.streaming.stateStore.providerClass to be the RocksDB provider.
    """
    order = order or [ts, key]
    once = messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    one = once.withColumn("gc_date", F.to_date(ts)).withColumn("gc_ticker", F.explode(F.array_distinct(tickers)))
    counted = one.groupBy("gc_date", "gc_ticker")
    had = None if written is None else written.groupBy(F.col("date").alias("gc_date"), F.col("ticker").alias("gc_ticker")).agg(F.count(F.lit(1)).alias("gc_had")).groupBy("gc_date", "gc_ticker")
    taken = counted.transformWithStateInPandas(_Counter(cap, order, ts), StructType(list(one.schema)), "Append", "EventTime", initialState=had, eventTimeColumnName=ts)
    # of the tickers that took it, the first stands for the message
    return taken.dropDuplicatesWithinWatermark([key]).drop("gc_date", "gc_ticker")


def drain_to_parquet(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there, batch by batch into one folder; a replayed batch is written once."""
    query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
