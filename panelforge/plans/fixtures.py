"""Messages, bars and scores made of the test tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored messages: event type is the ticker."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        e.alias("post_id"), F.col("ts"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("ticker"), "user_id", F.col("value"), "props",
        (e % 13).cast("string").alias("score"), (e % 7).alias("num_comments"), ((e % 97) / F.lit(100.0)).alias("prob_positive"), ((e % 89) / F.lit(200.0)).alias("prob_negative"), ((e % 5) / F.lit(10.0)).alias("prob_neutral"),
        F.when(e % 3 == 0, "positive").when(e % 3 == 1, "negative").otherwise("neutral").alias("label"), F.when(e % 5 == 0, "Bullish").when(e % 5 == 1, "Bearish").alias("native_label"),
        F.when(e % 4 == 0, 1.0).when(e % 4 == 1, -1.0).when(e % 4 == 3, 0.5).alias("sentiment"),
    )


MESSAGES = """msgs AS (SELECT event_id AS post_id, ts, CAST(ts AS DATE) AS date, event_type AS ticker, user_id, value, props, CAST(event_id % 13 AS VARCHAR) AS score, event_id % 7 AS num_comments,
 (event_id % 97) / 100.0::DOUBLE AS prob_positive, (event_id % 89) / 200.0::DOUBLE AS prob_negative, (event_id % 5) / 10.0::DOUBLE AS prob_neutral,
 CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS label, CASE event_id % 5 WHEN 0 THEN 'Bullish' WHEN 1 THEN 'Bearish' END AS native_label,
 CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE END AS sentiment FROM events)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as daily bars: the supplier's nation is the ticker, weekdays only."""
    l, s, n = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = l.select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity").where(F.weekday("date") < 5)
    rows = rows.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    price, volume = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), F.sum(F.col("l_quantity").cast("decimal(18,2)"))
    return rows.groupBy(F.col("n_name").alias("ticker"), "date").agg((F.floor(price.cast("double") / volume.cast("double") * 10000).cast("double") / 10000).alias("close"), volume.cast("double").alias("volume"))


def bar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of bars, from one column: every line has a supplier in a nation."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).where(F.weekday("date") < 5).distinct()


BARS = """bars AS (SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date, floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 10000) / 10000::DOUBLE AS close,
 CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE isodow(l_shipdate) < 6 GROUP BY 1, 2)"""


#: Lines whose mentions one task groups by order.
LINES_A_TASK = 250_000


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as messages with the nations of their lines as tickers."""
    o, l, s, n = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier", "nation"))
    lines = l.select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(n.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    # as many partitions as the lines need, so that what a task groups and counts does not grow with them
    lines = lines.select("l_orderkey", "n_name").repartition(max(1, -(-l.count() // LINES_A_TASK)), "l_orderkey")
    tickers = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("n_name")).alias("tickers"))
    k = F.col("o_orderkey")
    label = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "positive").when(F.col("o_orderpriority") == "5-LOW", "negative").otherwise("neutral")
    return o.join(tickers.hint("merge"), k == F.col("l_orderkey")).select(k.alias("post_id"), F.col("o_orderdate").cast("date").alias("date"), "tickers", label.alias("label"), ((k % 10) / F.lit(10.0)).alias("prob_positive"), ((k % 7) / F.lit(10.0)).alias("prob_negative"), ((k % 3) / F.lit(10.0)).alias("prob_neutral"), (k % 11).alias("score"), (k % 5).alias("num_comments"))


ORDER_MENTIONS = """om AS (SELECT DISTINCT o_orderkey AS post_id, CAST(o_orderdate AS DATE) AS date, n_name AS ticker,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'positive' WHEN o_orderpriority = '5-LOW' THEN 'negative' ELSE 'neutral' END AS label,
 (o_orderkey % 10) / 10.0::DOUBLE AS prob_positive, (o_orderkey % 7) / 10.0::DOUBLE AS prob_negative, (o_orderkey % 3) / 10.0::DOUBLE AS prob_neutral, o_orderkey % 11 AS score, o_orderkey % 5 AS num_comments
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

DAILY = """count(post_id) AS mention_count, avg(prob_positive - prob_negative) AS net_sentiment_mean, max(prob_positive - prob_negative) AS net_sentiment_max, min(prob_positive - prob_negative) AS net_sentiment_min,
 coalesce(stddev_samp(prob_positive - prob_negative), 0) AS net_sentiment_std, count(*) FILTER (WHERE label = 'positive') / count(post_id)::DOUBLE AS positive_ratio, count(*) FILTER (WHERE label = 'negative') / count(post_id)::DOUBLE AS negative_ratio,
 count(*) FILTER (WHERE label = 'neutral') / count(post_id)::DOUBLE AS neutral_ratio, avg(prob_positive) AS prob_positive_mean, avg(prob_negative) AS prob_negative_mean, avg(prob_neutral) AS prob_neutral_mean,
 sum((prob_positive - prob_negative) * greatest(score::DOUBLE, 1)) / sum(greatest(score::DOUBLE, 1)) AS weighted_sentiment, sum(greatest(score::DOUBLE, 1)) AS total_upvotes, sum(num_comments)::BIGINT AS total_comments"""
DAILY_DOUBLES = ["net_sentiment_mean", "net_sentiment_max", "net_sentiment_min", "net_sentiment_std", "positive_ratio", "negative_ratio", "neutral_ratio", "prob_positive_mean", "prob_negative_mean", "prob_neutral_mean", "weighted_sentiment", "total_upvotes"]


def _simpson(f: str, x: str) -> str:
    """Integral from 0 to x of f(u), times 6000."""
    return f"(({x}) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f.replace('U', f'(i * ({x}) / 2000)')})))"


def t_upper_sql(t: str, df: str) -> str:
    """P(T >= t) of Student's distribution, by the angle atan(t / sqrt(df))."""
    part, whole = (_simpson(f"pow(greatest(cos(U), 0), ({df}) - 1)", x) for x in (f"atan(abs({t}) / sqrt({df}))", "pi() / 2"))
    return f"(0.5 - 0.5 * sign({t}) * {part} / {whole})"


def z_upper_sql(z: str) -> str:
    """P(Z >= z) of the normal distribution."""
    return f"(0.5 - {_simpson('exp(-U * U / 2)', z)} / 6000 / sqrt(2 * pi()))"


#: Paired tests of each strategy in the table ``long`` (date, strategy, ret) against the one called hold.
PAIRED = f"""pd AS (SELECT x.strategy, round(x.ret - h.ret, 9) AS d FROM long x JOIN long h USING (date) WHERE h.strategy = 'hold' AND x.strategy <> 'hold'),
 pm AS (SELECT strategy, count(*) AS n, avg(d) AS mean_diff, avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0) AS t_statistic FROM pd GROUP BY 1),
 pk AS (SELECT strategy, d, rank() OVER (PARTITION BY strategy ORDER BY abs(d)) + (count(*) OVER (PARTITION BY strategy, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY strategy, abs(d)) AS c FROM pd WHERE d <> 0),
 pw AS (SELECT strategy, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_statistic, count(*)::DOUBLE AS k, sum(c * c - 1)::DOUBLE AS ties FROM pk GROUP BY 1),
 paired AS (SELECT strategy, n, mean_diff, t_statistic, w_statistic, {t_upper_sql('t_statistic', '(n - 1)')} AS p_value_ttest, {z_upper_sql('((w_statistic - k * (k + 1) / 4) / sqrt(k * (k + 1) * (2 * k + 1) / 24 - ties / 48))')} AS p_value_wilcoxon FROM pm JOIN pw USING (strategy)),
 tested AS (SELECT *, p_value_ttest < 0.05 OR p_value_wilcoxon < 0.05 AS significant_005 FROM paired)"""
