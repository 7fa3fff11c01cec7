"""Panels: bars with indicators, joins of sources on (ticker, date), targets, months, hygiene."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import columns as C
from panelforge.functions import series as S
from panelforge.functions import stats as T


def bar_features(bars: DataFrame) -> DataFrame:
    """Window indicators of (ticker, date, close, volume): bands, volatility, volume ratio, five-day forward return."""
    w = S.by("ticker")
    upper, mid, lower = S.bollinger(F.col("close"), w)
    out = bars.withColumn("ret", S.pct_change(F.col("close"), w)).withColumn("bb_upper", upper).withColumn("bb_middle", mid).withColumn("bb_lower", lower)
    return (
        out.withColumn("bb_width", S.band_width(F.col("bb_upper"), F.col("bb_middle"), F.col("bb_lower"))).withColumn("bb_pct", S.band_position(F.col("close"), F.col("bb_upper"), F.col("bb_lower")))
        .withColumn("volatility_20d", S.rolling(F.stddev_samp, F.col("ret"), w, 20)).withColumn("volume_ratio", C.ratio(F.col("volume"), S.rolling(F.avg, F.col("volume"), w, 20)))
        .withColumn("return_5d_forward", S.forward_return(F.col("close"), w, 5))
    )


def with_target(panel: DataFrame, h: int = 1, close: str = "close") -> DataFrame:
    """target: 1 if the close h rows on is higher; each ticker's last h rows are dropped."""
    w = S.by("ticker")
    return panel.withColumn("next_close", F.lead(close, h).over(w)).where("next_close is not null").withColumn("target", (F.col("next_close") > F.col(close)).cast("int"))


def excess_over(panel: DataFrame, benchmark: DataFrame, ret: str, out: str = "excess") -> DataFrame:
    """ret minus the benchmark's on the date; benchmark: one row a date, broadcast by size at run time."""
    b = benchmark.select("date", F.col(ret).alias("benchmark_ret"))
    return panel.join(b, "date", "left").withColumn(out, F.col(ret) - F.col("benchmark_ret"))


def join_sources(base: DataFrame, others: list[DataFrame], keys: list[str], needed: str) -> DataFrame:
    """Full outer fold over the sources, then only rows with the base's needed column: the optimizer makes it left joins."""
    return reduce(lambda a, b: a.join(b, keys, "full"), others, base).where(F.col(needed).isNotNull())


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))


def enrich_mentions(panel: DataFrame, net: str, mentions: str) -> DataFrame:
    """Change of a signal against its 7-row mean, 30-row z-score of mentions, and event days (z of 2 or more)."""
    w = S.by("ticker")
    z = S.z_score(F.col(mentions), w, 30, 5)
    out = panel.withColumn("sent_delta_ma7", F.col(net) - S.rolling(F.avg, F.col(net), w, 7, 2)).withColumn("mention_zscore_30d", z)
    return out.withColumn("signal_change", F.col(net) - F.lag(net).over(w)).withColumn("event_day", C.flag(F.col("mention_zscore_30d") >= 2))


def month_ends(bars: DataFrame, value: str = "close") -> DataFrame:
    """Last non-null value of every month from a ticker's first to its last, empty months included."""
    month = F.trunc("date", "MM")
    last = bars.where(F.col(value).isNotNull()).groupBy("ticker", month.alias("month")).agg(F.max_by(value, "date").alias(value))
    spans = last.groupBy("ticker").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return spans.join(last, ["ticker", "month"], "left")


def month_gaps(rows: DataFrame) -> DataFrame:
    """Months without any row between a ticker's first and last."""
    have = rows.select("ticker", F.trunc("date", "MM").alias("month")).distinct()
    spans = have.groupBy("ticker").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return spans.join(have, ["ticker", "month"], "left_anti")


def liquidity(bars: DataFrame, n: int = 60, least: int = 30) -> DataFrame:
    """Rolling median of close x volume."""
    w = S.by("ticker")
    return bars.withColumn("dollar_vol", S.rolling_median(F.col("close") * F.col("volume"), w, n, least))


def winsorise(panel: DataFrame, column: str, group: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the group's exact quantiles, which are found by counts, whatever the size of a group."""
    cuts = T.group_quantiles(panel, [group], column, [low, high]).select(group, F.col("q0").alias("w_lo"), F.col("q1").alias("w_hi"))
    return panel.join(cuts, group).withColumn(column, F.least(F.greatest(F.col(column), F.col("w_lo")), F.col("w_hi"))).drop("w_lo", "w_hi")


def deciles(panel: DataFrame, column: str, group: str, tie: str, n: int = 10) -> DataFrame:
    """decile 0..n-1 within the group by rank, ties in order of ``tie``; null where the group has fewer than n rows."""
    over = Window.partitionBy(group)
    ranked = panel.where(F.col(column).isNotNull()).withColumn("q_rank", F.row_number().over(over.orderBy(column, tie))).withColumn("q_n", F.count(F.lit(1)).over(over))
    return ranked.withColumn("decile", F.when(F.col("q_n") >= n, S.qcut_bucket(F.col("q_rank"), F.col("q_n"), n))).drop("q_rank", "q_n")


def quantile_bins(panel: DataFrame, column: str, probs: list[float]) -> DataFrame:
    """bin: how many of the column's exact quantiles lie below the value (right-closed); 0 where it is null."""
    cuts = [c for c in T.exact_quantiles(panel, column, probs) if c is not None]
    over = [F.coalesce((F.col(column) > F.lit(c)).cast("int"), F.lit(0)) for c in cuts]
    return panel.withColumn("bin", reduce(lambda a, b: a + b, over, F.lit(0)))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of equal bins from the smallest to the largest value, the last one closed; empty bins have 0."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    width = F.lit((float(hi) - float(lo)) / bins if hi is not None else 0.0)
    placed = df.where(F.col(column).isNotNull()).select(F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col(column) - F.lit(lo), width), F.lit(0.0))).cast("int") + 1).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def null_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])


def quality_report(panel: DataFrame, ratio: str, date: str, low: str, high: str) -> DataFrame:
    """Counts of values out of range, in one pass."""
    return panel.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col(ratio) < 0) | (F.col(ratio) > 1)).alias("bad_ratio"), F.count_if((F.col(date) < F.lit(low).cast("date")) | (F.col(date) > F.lit(high).cast("date"))).alias("bad_date"))


def hash_order(key: str, seed: int) -> Column:
    """A fixed random order: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def deterministic_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(n)


def permute_within(df: DataFrame, columns: list[str], key: str, group: str | list[str], seed: int = 42) -> DataFrame:
    """Placebo: the columns dealt anew among the rows of each group, by hash order."""
    part = [group] if isinstance(group, str) else group
    rows = df.withColumn("p_row", F.row_number().over(Window.partitionBy(*part).orderBy(key)))
    dealt = df.withColumn("p_row", F.row_number().over(Window.partitionBy(*part).orderBy(hash_order(key, seed), key))).select(*part, "p_row", *columns)
    return rows.drop(*columns).join(dealt, [*part, "p_row"]).drop("p_row")


def permute_all(df: DataFrame, columns: list[str], key: str, seed: int = 42, prefix: int = 3) -> DataFrame:
    """Placebo over the whole table: rows by key and rows by hash are numbered alike and joined.

    Numbers are made without one task for all: hashes fall in 16 ** prefix even bins by
    their first digits, keys are hashed too for their order, and only the bins'
    totals meet in one place.
    """
    def numbered(order: Column, out: str) -> DataFrame:
        binned = df.withColumn("pa_order", order).withColumn("pa_bin", F.substring("pa_order", 1, prefix))
        totals = binned.groupBy("pa_bin").agg(F.count(F.lit(1)).alias("pa_n"))
        under = totals.select("pa_bin", F.coalesce(F.sum("pa_n").over(Window.orderBy("pa_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("pa_under"))  # one row a bin
        return binned.join(F.broadcast(under), "pa_bin").withColumn(out, F.col("pa_under") + F.row_number().over(Window.partitionBy("pa_bin").orderBy("pa_order", key))).drop("pa_bin", "pa_under", "pa_order")

    rows = numbered(hash_order(key, seed), "p_row").drop(*columns)
    dealt = numbered(hash_order(key, seed + 1), "p_row").select("p_row", *columns)
    return rows.join(dealt, "p_row").drop("p_row")


def join_monthly(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both panels by ticker and month."""
    return left.join(right, ["ticker", "month"])


def join_left(base: DataFrame, others: list[DataFrame], keys: list[str], zeros: list[str]) -> DataFrame:
    """Every row of base with what each other has for its keys; missing counts are 0. Frames share the keys, so one partitioning serves all joins."""
    joined = reduce(lambda a, b: a.join(b, keys, "left"), others, base)
    return joined.fillna(0, subset=[z for z in zeros if z in joined.columns])


def excess_targets(panel: DataFrame, benchmark: DataFrame, h: int) -> DataFrame:
    """Return over h rows minus the benchmark's between the same two dates; target: whether it is positive.

    benchmark: (date, close), one row a date. Rows without a close h rows on, or
    without the benchmark's on either date, are left out.
    """
    w = S.by("ticker")
    ahead = panel.withColumn("fwd_close", F.lead("close", h).over(w)).withColumn("fwd_date", F.lead("date", h).over(w)).where("fwd_close is not null and fwd_date is not null")
    now = benchmark.select(F.col("date"), F.col("close").alias("bench_now"))
    then = benchmark.select(F.col("date").alias("fwd_date"), F.col("close").alias("bench_fwd"))
    both = ahead.join(now, "date", "left").join(then, "fwd_date", "left").where("bench_now is not null and bench_fwd is not null")
    own, bench = F.try_divide("fwd_close", "close") - 1, F.try_divide("bench_fwd", "bench_now") - 1
    return both.withColumn("ret_ticker", own).withColumn("ret_bench", bench).withColumn("excess", own - bench).withColumn("target", (own > bench).cast("int"))


def verify_targets(official: DataFrame, closes: DataFrame, h: int = 1) -> DataFrame:
    """One row: how many targets there are and how many a second way contradicts.

    The second way numbers each ticker's bars and joins bar k to bar k + h.
    """
    numbered = closes.select("ticker", "date", "close", F.row_number().over(S.by("ticker")).alias("k"))
    later = numbered.select("ticker", (F.col("k") - h).alias("k"), F.col("close").alias("later"))
    again = numbered.join(later, ["ticker", "k"]).select("ticker", "date", (F.col("later") > F.col("close")).cast("int").alias("again"))
    both = official.select("ticker", "date", "target").join(again, ["ticker", "date"], "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("again").isNull() | (F.col("target") != F.col("again"))).alias("mismatches"))


def rows_by_period(rows: DataFrame, date: str = "date") -> DataFrame:
    """(period, name, n): counts by year, quarter, month and ticker in one pass."""
    periods = F.array(
        F.struct(F.lit("year").alias("period"), F.year(date).cast("string").alias("name")), F.struct(F.lit("quarter").alias("period"), F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string")).alias("name")),
        F.struct(F.lit("month").alias("period"), F.date_format(date, "yyyy-MM").alias("name")), F.struct(F.lit("ticker").alias("period"), F.col("ticker").alias("name")),
    )
    # one row for each ticker and day goes on, so the four-fold explode is small
    days = rows.groupBy("ticker", date).agg(F.count(F.lit(1)).alias("c"))
    return days.select("c", F.inline(periods)).groupBy("period", "name").agg(F.sum("c").alias("n"))


def head_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def survivorship(universe: DataFrame, last_dates: DataFrame, end: str) -> DataFrame:
    """One row of audit counts: tickers wanted, with and without prices, delisted before the end, and the survivors' share."""
    marked = universe.select("ticker").join(last_dates, "ticker", "left")
    gone = F.col("last_date") < F.lit(end).cast("date")
    counted = marked.agg(F.count(F.lit(1)).alias("n_universe"), F.count_if(F.col("last_date").isNull()).alias("n_no_price"), F.count_if(gone).alias("n_delisted"), F.count_if(~gone).alias("n_survivors"))
    return counted.withColumn("survivor_share", F.try_divide(F.col("n_survivors").cast("double"), F.col("n_survivors") + F.col("n_delisted")))
