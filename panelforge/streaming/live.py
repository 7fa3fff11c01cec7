"""The live loop as scheduled batches: run logs, resumable steps, end of day."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.files import _files, write_text

RUN_LOG = "run_id string, market_open boolean, orders array<struct<ticker:string,action:string,status:string,notional:double>>, errors array<string>"


def run_if_open(market_open: bool, body: Callable[[], DataFrame]) -> DataFrame | None:
    """body(), or nothing while the market is closed."""
    return body() if market_open else None


def log_predictions(predictions: DataFrame, path: str, run_at: datetime) -> None:
    """Add one run's predictions; a run that is repeated replaces its own rows and no others."""
    run = run_at.strftime("%Y%m%d_%H%M%S")
    marked = predictions.withColumn("run", F.lit(run))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def day_orders(logs: DataFrame) -> DataFrame:
    """(action, status, n, notional) over the orders of a day's run logs."""
    orders = logs.select(F.explode("orders").alias("o")).select("o.*")
    return orders.groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("notional", F.lit(0.0))).alias("notional"))


def day_summary(logs: DataFrame) -> DataFrame:
    """One row: runs, runs with the market open, orders, buys and closes that went out, their notional, errors."""
    size = lambda c: F.coalesce(F.sum(F.size(F.coalesce(c, F.array()))), F.lit(0)).cast("long")
    sent = lambda action: F.filter("orders", lambda o: (o["action"] == action) & (o["status"] != "skipped"))
    spent = F.aggregate(F.coalesce(sent("BUY"), F.array().cast("array<struct<ticker:string,action:string,status:string,notional:double>>")), F.lit(0.0), lambda a, o: a + F.coalesce(o["notional"], F.lit(0.0)))
    return logs.agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("market_open").alias("n_open"), size(F.col("orders")).alias("n_orders"), size(sent("BUY")).alias("n_buys"), size(sent("CLOSE")).alias("n_closes"), F.coalesce(F.sum(spent), F.lit(0.0)).alias("notional"), size(F.col("errors")).alias("n_errors"))


class Markers:
    """Which steps of a long run are done: one empty file a step in a shared folder, so a restart skips them."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.folder, self.clock = spark, folder, clock

    def done(self, step: str) -> bool:
        fs, named = _files(self.spark, self.folder)
        return fs.exists(named(f"{self.folder}/{step}.done"))

    def mark(self, step: str) -> None:
        write_text(self.spark, f"{self.folder}/{step}.done", step)

    def run(self, steps: dict[str, Callable[[], None]], seconds: float | None = None) -> list[str]:
        """Run what is not done, in order, and mark it; stop before a step once the time is up. Returns the steps run."""
        began, ran = self.clock(), []
        for name, body in steps.items():
            if seconds is not None and self.clock() - began >= seconds:
                break
            if not self.done(name):
                body()
                self.mark(name)
                ran.append(name)
        return ran

    def lock(self, owner: str) -> bool:
        """Take the run for one owner: true if nobody else holds it."""
        fs, named = _files(self.spark, self.folder)
        fs.mkdirs(named(self.folder))
        if fs.createNewFile(named(f"{self.folder}/lock")):
            write_text(self.spark, f"{self.folder}/owner", owner)
            return True
        return fs.exists(named(f"{self.folder}/owner")) and self.spark.read.text(f"{self.folder}/owner").first().value == owner

    def release(self) -> None:
        fs, named = _files(self.spark, self.folder)
        fs.delete(named(f"{self.folder}/lock"), False)
        fs.delete(named(f"{self.folder}/owner"), False)
