"""Strategy simulation, order selection and sizing, temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import stats as T


def long_only(panel: DataFrame, signal: str = "signal", ret: str = "ret") -> DataFrame:
    """Per date the mean return of rows with signal 1, 0 without any."""
    return panel.groupBy("date").agg(F.coalesce(F.avg(F.when(F.col(signal) == 1, F.col(ret))), F.lit(0.0)).alias("ret"))


def buy_and_hold(panel: DataFrame, ret: str = "ret") -> DataFrame:
    return panel.groupBy("date").agg(F.avg(ret).alias("ret"))


def compare(strategies: dict[str, DataFrame]) -> DataFrame:
    """(date, strategy, ret) over the dates that all strategies have."""
    out = None
    for name, s in strategies.items():
        one = s.where("ret is not null").select("date", F.lit(name).alias("strategy"), "ret")
        out = one if out is None else out.unionByName(one)
    both = out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date")))
    return both.where(F.col("n") == len(strategies)).drop("n")


def metrics(returns: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Per strategy: periods, cumulative return, CAGR, Sharpe ratio, maximum drawdown."""
    ret = F.col("ret")
    base = returns.groupBy("strategy").agg(F.count(ret).alias("n"), T.cumulative(ret).alias("cumulative"), T.cagr(ret, per_year).alias("cagr"), T.sharpe(ret, per_year).alias("sharpe"))
    return base.join(T.drawdowns(returns, "strategy"), "strategy")


def top_fraction(panel: DataFrame, score: str, q: float = 0.9, least: int = 10) -> DataFrame:
    """Rows at or over their date's q-quantile; dates with fewer than ``least`` rows or without a score are skipped.

    The cut is exact and found by counts (T.group_quantiles), so no task holds a date.
    """
    cuts = T.group_quantiles(panel, ["date"], score, [q]).where(F.col("n_rows") >= least).select("date", F.col("q0").alias("tf_cut"))
    return panel.join(cuts, "date").where(F.col(score) >= F.col("tf_cut")).drop("tf_cut")


def rebalance_dates(dates: DataFrame, h: int) -> DataFrame:
    """Every h-th of the distinct dates."""
    return dates.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("k") % h == 0).select("date")


def top_fraction_backtest(panel: DataFrame, score: str, ret: str, h: int, cost: float = 0.002) -> DataFrame:
    """Non-overlapping periods of the top decile, cost paid each time: one row (trades, mean, cumulative, Sharpe)."""
    held = top_fraction(panel.join(rebalance_dates(panel, h), "date"), score)
    periods = held.groupBy("date").agg((F.avg(ret) - cost).alias("ret"), F.count(F.lit(1)).alias("trades"))
    return periods.agg(F.sum("trades").alias("trades"), F.avg("ret").alias("mean_ret"), T.cumulative(F.col("ret")).alias("cumulative"), T.sharpe(F.col("ret"), 252 / h).alias("sharpe"))


def backtest_against_benchmark(panel: DataFrame, score: str, ret: str, h: int, cost: float = 0.002, least: int = 10) -> DataFrame:
    """Metrics of the top decile, cost paid each period, and of all rows without cost, over the same non-overlapping periods."""
    dealt = panel.join(rebalance_dates(panel, h), "date")
    top = top_fraction(dealt, score, least=least).groupBy("date").agg((F.avg(ret) - cost).alias("ret"), F.count(F.lit(1)).alias("trades"))
    bench = dealt.groupBy("date").agg(F.avg(ret).alias("ret")).join(top.select("date"), "date", "left_semi")
    both = top.withColumn("strategy", F.lit("top")).unionByName(bench.withColumn("strategy", F.lit("benchmark")).withColumn("trades", F.lit(0).cast("long")))
    return metrics(both, 252 / h).drop("cagr").join(both.groupBy("strategy").agg(F.sum("trades").alias("trades")), "strategy")


def decile_spread(panel: DataFrame, ret: str, n: int = 10) -> DataFrame:
    """Mean return by month and decile, and lowest minus highest, realised a month later."""
    wide = panel.where(F.col("decile").isNotNull()).groupBy("month").pivot("decile", list(range(n))).agg(F.avg(ret))
    return wide.withColumn("long_short", F.col("0") - F.col(str(n - 1))).withColumn("realised", F.add_months("month", 1))


def select_buys(signals: DataFrame, limit: int = 20) -> DataFrame:
    return signals.where("signal = 1").orderBy(F.col("confidence").desc(), "ticker").limit(limit)


def plan_actions(positions: DataFrame, buys: DataFrame) -> DataFrame:
    """(ticker, action): close what is held and not bought, open what is bought and not held, else maintain."""
    both = positions.select("ticker", F.lit(True).alias("held")).join(buys.select("ticker", F.lit(True).alias("bought")), "ticker", "full")
    return both.select("ticker", F.when(F.col("bought").isNull(), "CLOSE").when(F.col("held").isNull(), "OPEN").otherwise("MAINTAIN").alias("action"))


def size_orders(actions: DataFrame, equity: float, buying_power: float, n_target: int, min_notional: float = 1.0) -> DataFrame:
    """Opens at min(equity / targets, buying power / opens); those under the minimum are skipped."""
    opens = actions.where("action = 'OPEN'")
    # at most as many as the buys that were selected
    n_open = opens.count()
    sized = opens.withColumn("notional", F.lit(min(equity / max(n_target, 1), buying_power / max(n_open, 1))))
    return sized.select("ticker", F.lit("BUY").alias("action"), "notional", F.when(F.col("notional") < min_notional, "skipped").otherwise("submitted").alias("status"))


def temporal_split(panel: DataFrame, test: float = 0.2, validation: float = 0.2) -> DataFrame:
    """split: train, val or test by unique dates in order."""
    days = panel.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    before = F.floor(F.col("n") * (1 - test))
    inner = F.floor(before * (1 - validation))
    named = days.select("date", F.when(F.col("k") <= inner, "train").when(F.col("k") <= before, "val").otherwise("test").alias("split"))
    return panel.join(named, "date")


def class_weight(panel: DataFrame, label: str = "target", slack: float = 0.05) -> DataFrame:
    """neg / pos where the classes differ by more than the slack, else 1; one row."""
    share = F.avg(F.col(label).cast("double"))
    return panel.agg(F.when(F.abs(share - 0.5) * 2 > slack, F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1))).otherwise(1.0).alias("scale_pos_weight"))


def verdict(precision: float, sharpe: float, trades: int, placebo: bool) -> bool:
    """The pre-registered rule."""
    return precision >= 0.55 and sharpe > 0.5 and trades >= 100 and not placebo


def verdicts(results: DataFrame) -> DataFrame:
    """results (name, precision, sharpe, trades, placebo) with the rule's outcome; null where a figure is missing."""
    rule = (F.col("precision") >= 0.55) & (F.col("sharpe") > 0.5) & (F.col("trades") >= 100) & ~F.col("placebo")
    return results.withColumn("success", rule)


def best_model(results: DataFrame, metric: str = "auc_mean") -> DataFrame:
    """The row with the largest metric, the first by name where several tie; rows without a metric do not count."""
    return results.where(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(F.col(metric).desc(), "name").limit(1)


def objectives(measured: DataFrame, accuracy: float = 0.55, sharpe: float = 1.0, drawdown: float = 0.15, p_value: float = 0.05) -> DataFrame:
    """Which of the four objectives each strategy meets; a missing figure meets none."""
    met = lambda c: F.coalesce(c, F.lit(False))
    return measured.withColumn("met_accuracy", met(F.col("accuracy") > accuracy)).withColumn("met_sharpe", met(F.col("sharpe") > sharpe)).withColumn("met_drawdown", met(F.col("max_drawdown") < drawdown)).withColumn("met_p_value", met(F.col("p_value") < p_value))
