"""Monthly contrarian evaluation: hygiene, groups by sentiment, spread, alpha, exposure, placebo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import series as S
from panelforge.functions import stats as T
from panelforge.operators import panel as P

MIN_PRICE, EXTREME = 1.0, 2.0


def hygiene(panel: DataFrame, ret: str = "ret") -> tuple[DataFrame, DataFrame]:
    """(clean panel, one row of counts): rows under the least price go, returns are clipped to each month's 1 % and 99 % quantiles."""
    kept = panel.where(F.col("price") >= MIN_PRICE)
    counts = panel.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("price") < MIN_PRICE).alias("n_penny"), F.count_if((F.col("price") >= MIN_PRICE) & (F.abs(ret) > EXTREME)).alias("n_extreme"), F.count_if(F.col("price") >= MIN_PRICE).alias("n_clean"))
    return P.winsorise(kept, ret, "month"), counts


def group_count(panel: DataFrame) -> int:
    """Ten groups if the median month has 50 names or more, else five."""
    middle = panel.groupBy("month").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("m")).first().m
    return 10 if middle is not None and middle >= 50 else 5


def sentiment_groups(panel: DataFrame, n: int, column: str = "bullishness", part: list[str] | None = None) -> DataFrame:
    """grp 0..n-1 by rank within the month (ties by ticker); null in months with fewer than n distinct values."""
    part = part or ["month"]
    over = Window.partitionBy(*part)
    present = F.col(column).isNotNull()
    ranked = panel.where(present).withColumn("sg_rank", F.row_number().over(over.orderBy(column, "ticker"))).withColumn("sg_n", F.count(F.lit(1)).over(over))
    ranked = ranked.withColumn("sg_first", (F.lag(column).over(over.orderBy(column, "ticker")).isNull() | (F.lag(column).over(over.orderBy(column, "ticker")) != F.col(column))).cast("int"))
    ranked = ranked.withColumn("sg_kinds", F.sum("sg_first").over(over))
    return ranked.withColumn("grp", F.when(F.col("sg_kinds") >= n, S.qcut_bucket(F.col("sg_rank"), F.col("sg_n"), n))).drop("sg_rank", "sg_n", "sg_first", "sg_kinds")


def spread(grouped: DataFrame, n: int, ret: str = "ret", part: list[str] | None = None) -> DataFrame:
    """(part, month, low, high, ret): mean returns of the lowest and highest group and their difference, in the month after."""
    part = part or []
    low, high = F.avg(F.when(F.col("grp") == 0, F.col(ret))), F.avg(F.when(F.col("grp") == n - 1, F.col(ret)))
    both = grouped.where(F.col("grp").isNotNull() & F.col(ret).isNotNull()).groupBy(*part, "month").agg(low.alias("low"), high.alias("high"))
    return both.select(*part, F.add_months("month", 1).alias("month"), "low", "high", (F.col("low") - F.col("high")).alias("ret")).where("ret is not null")


def group_returns(grouped: DataFrame, ret: str = "ret") -> DataFrame:
    """Per group: mean of its monthly mean returns, their t, and median size and volatility of its rows."""
    monthly = grouped.where(F.col("grp").isNotNull() & F.col(ret).isNotNull()).groupBy("grp", "month").agg(F.avg(ret).alias("m"))
    means = monthly.groupBy("grp").agg(F.avg("m").alias("mean_ret"), T.t_of_mean(F.col("m")).alias("t"))
    exposure = grouped.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.percentile("size", F.lit(0.5)).alias("size_med"), F.percentile("vol", F.lit(0.5)).alias("vol_med"), F.count(F.lit(1)).alias("n"))
    return means.join(exposure, "grp")


def placebo_spreads(panel: DataFrame, n: int, times: int, column: str = "bullishness", ret: str = "ret") -> DataFrame:
    """(placebo, month, ret): the spread after the column is dealt anew within each month, once for each placebo, in one job.

    Grows with rows x times; monthly panels have a row for each ticker and month.
    """
    rows = panel.where(F.col(column).isNotNull()).select("ticker", "month", column, ret)
    many = rows.withColumn("placebo", F.explode(F.sequence(F.lit(1), F.lit(times))))
    many = many.withColumn("ps_key", F.concat_ws(":", F.col("placebo").cast("string"), "ticker"))
    dealt = P.permute_within(many, [column], "ps_key", ["placebo", "month"])
    return spread(sentiment_groups(dealt, n, column, ["placebo", "month"]), n, ret, ["placebo"])


def contrarian_evaluation(panel: DataFrame, factors: DataFrame, names: tuple[str, ...] = ("mkt_rf", "smb", "hml"), times: int = 100) -> DataFrame:
    """One row with the counts of hygiene, groups, months, spread and its t, alpha and its t, placebo mean and p, and the verdict.

    panel: ticker, month (a date), price, ret (over the next month), bullishness.
    factors: month and the named columns. p is the share of placebo alphas at or over
    the real one; success needs alpha > 0, t > 2 and p < 0.05.
    """
    clean, counts = hygiene(panel)
    clean = clean.select("ticker", "month", "bullishness", "ret")
    n = group_count(clean)
    real = spread(sentiment_groups(clean, n), n)
    known = counts.first().asDict() | {"n_groups": n}
    known |= real.agg(F.count(F.lit(1)).alias("n_months"), F.avg("ret").alias("ls_mean"), T.t_of_mean(F.col("ret")).alias("ls_t")).first().asDict()
    fitted = T.alpha(real, factors, names=names).first()
    alpha, t, n_obs = (fitted.alpha, fitted.t, fitted.n) if fitted else (None, None, 0)
    known |= {"alpha": alpha, "alpha_t": t, "n_obs": n_obs}
    kinds = {k: "long" if k.startswith("n_") else "double" for k in known}
    dealt = T.alpha(placebo_spreads(clean, n, times), factors, "placebo", names=names).where("alpha is not null")
    tested = dealt.agg(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in known.items()], F.avg("alpha").alias("placebo_mean"), F.count("alpha").alias("n_placebo"), F.avg((F.col("alpha") >= F.lit(alpha).cast("double")).cast("double")).alias("p_value"))
    return tested.withColumn("success", F.coalesce((F.col("alpha") > 0) & (F.col("alpha_t") > 2) & (F.col("p_value") < 0.05), F.lit(False)))
