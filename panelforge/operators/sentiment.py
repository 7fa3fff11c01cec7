"""Daily and monthly aggregates of scored messages on a trading calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import columns as C
from panelforge.functions.text import native_value
from panelforge.storage import discard, stored


def mentions(messages: DataFrame, tickers: str = "tickers", out: str = "ticker") -> DataFrame:
    """One row for each (message, ticker); messages without one are dropped."""
    return messages.withColumn(out, F.explode(F.col(tickers))).drop(tickers)


def trading_calendar(days: DataFrame, dates: DataFrame, day: str = "date", date: str = "date") -> DataFrame:
    """(date, trading_date): the first trading day on or after each date, null past the last one.

    Both inputs are distinct dates, a few hundred rows a year, so one sorted window over them is small.
    """
    both = dates.select(F.col(date).alias("d")).distinct().withColumn("t", F.lit(None).cast("date")).unionByName(days.select(F.col(day).alias("d"), F.col(day).alias("t")).distinct())
    found = both.groupBy("d").agg(F.max("t").alias("t")).withColumn("trading_date", F.min("t").over(Window.orderBy("d").rowsBetween(0, Window.unboundedFollowing)))
    return found.select(F.col("d").alias("date"), "trading_date")


def on_trading_days(messages: DataFrame, days: DataFrame, date: str = "date", dates: DataFrame | None = None) -> DataFrame:
    """messages with trading_date; rows past the last trading day are dropped. dates: their distinct dates, if they can be had for less than from the messages."""
    dates = messages.select(F.col(date).alias("date")).distinct() if dates is None else dates
    calendar = trading_calendar(days, dates).withColumnRenamed("date", "calendar_date")
    return messages.join(calendar, F.col(date) == F.col("calendar_date")).drop("calendar_date").where("trading_date is not null")


def daily_sentiment(scored: DataFrame, min_mentions: int = 5, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """The flagship aggregate; scored: keys, post_id, label, prob_*, score, num_comments and, if there, native_label."""
    C.require_columns(scored, {*keys, "post_id", "label", "prob_positive", "prob_negative", "prob_neutral", "score", "num_comments"})
    for k in keys:
        scored = scored.where(F.col(k).isNotNull())
    net = F.col("prob_positive") - F.col("prob_negative")
    weight = C.at_least(C.number(F.col("score"), 1.0), 1.0)
    count = F.count("post_id")
    share = lambda name: F.try_divide(F.count_if(F.col("label") == name).cast("double"), count)
    aggs = [
        count.alias("mention_count"), F.avg(net).alias("net_sentiment_mean"), F.max(net).alias("net_sentiment_max"), F.min(net).alias("net_sentiment_min"),
        F.coalesce(F.stddev_samp(net), F.lit(0.0)).alias("net_sentiment_std"), share("positive").alias("positive_ratio"), share("negative").alias("negative_ratio"), share("neutral").alias("neutral_ratio"),
        F.avg("prob_positive").alias("prob_positive_mean"), F.avg("prob_negative").alias("prob_negative_mean"), F.avg("prob_neutral").alias("prob_neutral_mean"),
        F.try_divide(F.sum(net * weight), F.sum(weight)).alias("weighted_sentiment"), F.sum(weight).alias("total_upvotes"), F.sum("num_comments").alias("total_comments"),
    ]
    if "native_label" in scored.columns:
        aggs.append(F.avg(native_value(F.col("native_label"))).alias("native_sentiment"))
    return scored.groupBy(*keys).agg(*aggs).where(F.col("mention_count") >= min_mentions)


def bull_bear(labelled: DataFrame, keys: list[str], sentiment: str = "sentiment", user: str = "user_id", count_nulls: bool = False) -> DataFrame:
    """Bullish, bearish, total and distinct users; total counts labelled rows, or all of them."""
    bull, bear = F.count_if(F.col(sentiment) > 0), F.count_if(F.col(sentiment) < 0)
    total = F.count(F.lit(1)) if count_nulls else F.count(sentiment)
    return labelled.groupBy(*keys).agg(bull.alias("bullish_count"), bear.alias("bearish_count"), total.alias("total_count"), F.count_distinct(user).alias("unique_users"), (bull / F.greatest(bull + bear, F.lit(1))).alias("bullish_ratio"))


def forum_daily(posts: DataFrame, keys: list[str]) -> DataFrame:
    return posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("mention_count"), F.avg("score").alias("avg_score"), F.sum("num_comments").alias("total_comments"))


def news_daily(news: DataFrame, keys: list[str], sentiment: str = "sentiment") -> DataFrame:
    """The count is of scored articles: without a scorer it is 0."""
    return news.groupBy(*keys).agg(F.count(sentiment).alias("news_count"), F.avg(sentiment).alias("news_sentiment_mean"))


def model_daily(scores: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Means of model scores, each message once (the first by order); sums are exact to nine places, so their order does not matter."""
    once = keep_first(scores, ["message_id"], order)
    exact = lambda c: F.try_divide(F.sum(c.cast("decimal(18,9)")).cast("double"), F.count(c))
    return once.groupBy(*keys).agg(exact(F.col("prob_positive") - F.col("prob_negative")).alias("net_sentiment_mean"), exact(F.col("prob_negative")).alias("prob_neg_mean"), F.count(F.lit(1)).alias("msg_count"))


def mention_statistics(rows: DataFrame, least: int = 5) -> DataFrame:
    """Per ticker over its days: two groupings, the second over the first one's result."""
    daily = rows.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy("ticker").agg(F.count_if(F.col("n") >= least).alias("days_ge"), F.count(F.lit(1)).alias("total_days"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.avg("n").alias("avg_mentions"), F.sum("n").alias("total_mentions"))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("kf_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("kf_row = 1").drop("kf_row")


def cap_per_group(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; a group limit runs before the shuffle."""
    return df.withColumn("cap_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("cap_row") <= n).drop("cap_row")


def _under_cap(messages: DataFrame, cap: int, date: str, tickers: str, order: list[str], identity: list[str]) -> DataFrame:
    """Messages that are among the first ``cap`` of any of their tickers that day; what is over in a task goes before the shuffle."""
    one = messages.withColumn("gc_ticker", F.explode(F.array_distinct(tickers)))
    place = F.row_number().over(Window.partitionBy(date, "gc_ticker").orderBy(*order))
    found = one.withColumn("gc_place", place).where(F.col("gc_place") <= cap).drop("gc_place", "gc_ticker")
    return found.dropDuplicates(identity)


def greedy_cap(messages: DataFrame, cap: int, date: str = "date", key: str = "post_id", tickers: str = "tickers", order: list[str] | None = None) -> DataFrame:
    """Messages in order, kept while any of their tickers is under the cap that day; a kept one counts for all its tickers.

    order: what makes up the order of arrival (file and row; the key, if none), ties by
    key. A ticker counts once in a message; messages without one are dropped. A message
    is refused only when all its tickers are full, so as long as a ticker is not full,
    all its earlier messages were kept: it is full exactly from the (cap + 1)-th of them
    on. So a message is kept exactly if it is among the first ``cap`` of one of its
    tickers, which no task needs a whole day for. A key is kept once: of its rows (on
    several dates, say), those after the kept one count for nothing. Which they are
    depends on rows further ahead alone, so a few rounds over the keys with several
    rows settle it, each at least one row further ahead.
    """
    order = [*(order or []), key]
    many = messages.groupBy(key).agg(F.count(F.lit(1)).alias("gc_n")).where("gc_n > 1").select(F.col(key).alias("gc_key"))
    same = F.col(key).eqNullSafe(F.col("gc_key"))
    if not many.limit(1).count():
        return _under_cap(messages, cap, date, tickers, order, [key])
    many = stored(many, "cap-keys")
    numbered = messages.join(many, same, "left_semi").withColumn("gc_seq", F.row_number().over(Window.partitionBy(key).orderBy(*order, date)))
    rivals = stored(numbered, "cap-rivals")
    lone = messages.join(many, same, "left_anti").withColumn("gc_seq", F.lit(1))
    barred, written = None, [many, rivals]
    while True:
        left = rivals if barred is None else rivals.join(barred, same, "left").where("gc_after is null or gc_seq <= gc_after").drop("gc_key", "gc_after")
        kept = _under_cap(lone.unionByName(left), cap, date, tickers, [*order, "gc_seq"], [key, "gc_seq"])
        now = stored(kept.join(many, same, "left_semi").groupBy(F.col(key).alias("gc_key")).agg(F.min("gc_seq").alias("gc_after")), "cap-kept")
        written.append(now)
        if barred is not None and not now.exceptAll(barred).limit(1).count() and not barred.exceptAll(now).limit(1).count():
            out = stored(kept.drop("gc_seq"), "cap-result")
            discard(*written)
            return out
        barred = now


def cap_resumed(messages: DataFrame, written: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """What a restarted run adds: counters start at what is already written, then the first rows of each group up to n.

    Rows already written (by key and order) are not taken again.
    """
    had = written.groupBy(*key).agg(F.count(F.lit(1)).alias("cr_had"))
    fresh = messages.join(written.select(*key, *order).distinct(), [*key, *order], "left_anti")
    first = cap_per_group(fresh, key, order, n)
    numbered = first.withColumn("cr_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).join(had, key, "left")
    return numbered.where(F.col("cr_row") + F.coalesce("cr_had", F.lit(0)) <= n).drop("cr_row", "cr_had")


def latest_row(df: DataFrame, key: str, order: str = "date") -> DataFrame:
    return df.withColumn("lr_row", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("lr_row = 1").drop("lr_row")


def latest_values(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each column's last value that is not null."""
    return df.groupBy(key).agg(*[F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def value_or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))
