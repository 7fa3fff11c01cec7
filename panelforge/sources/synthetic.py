"""Made-up messages for tests: the same rows for a seed, however the range is split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICKERS = ["AAPL", "TSLA", "MSFT", "NVDA", "AMD", "GOOG", "AMZN", "META"]
WEIGHTS = {"positive": 0.45, "negative": 0.30, "neutral": 0.25}
_BODIES = {"positive": "strong beat, bullish on", "negative": "weak quarter, bearish on", "neutral": "watching"}


def unit(seed: int, name: str, key: Column) -> Column:
    """A number in [0, 1) from md5 of seed, name and key."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def synthetic_posts(spark: SparkSession, n: int = 2000, days: int = 30, start: str = "2024-01-01", seed: int = 42) -> DataFrame:
    """(post_id, date, ticker, label, text, score): labels by WEIGHTS, tickers and days evenly."""
    k = F.col("id")
    tickers = F.array(*[F.lit(t) for t in TICKERS])
    pick = unit(seed, "label", k)
    label = F.when(pick < WEIGHTS["positive"], "positive").when(pick < WEIGHTS["positive"] + WEIGHTS["negative"], "negative").otherwise("neutral")
    rows = spark.range(n).select(
        k.alias("post_id"), F.date_add(F.lit(start).cast("date"), F.floor(unit(seed, "day", k) * days).cast("int")).alias("date"),
        F.get(tickers, F.floor(unit(seed, "ticker", k) * len(TICKERS)).cast("int")).alias("ticker"), label.alias("label"), F.floor(unit(seed, "score", k) * 200).cast("long").alias("score"),
    )
    body = F.when(F.col("label") == "positive", _BODIES["positive"]).when(F.col("label") == "negative", _BODIES["negative"]).otherwise(_BODIES["neutral"])
    return rows.withColumn("text", F.concat(body, F.lit(" $"), "ticker"))
