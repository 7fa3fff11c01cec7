"""Statistics in DataFrame form: risk metrics, ranks, tests."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelforge.storage import discard, stored


def sharpe(ret: Column, per_year: float = 252.0) -> Column:
    return F.try_divide(F.avg(ret) * F.sqrt(F.lit(per_year)), F.nullif(F.stddev_samp(ret), F.lit(0.0)))


def cumulative(ret: Column) -> Column:
    return F.product(1 + ret) - 1


def cagr(ret: Column, per_year: float = 252.0) -> Column:
    return F.when(F.product(1 + ret) > 0, F.pow(F.product(1 + ret), F.lit(per_year) / F.count(ret)) - 1).otherwise(F.lit(float("-inf")))


def t_of_mean(c: Column) -> Column:
    return F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0)))


def drawdowns(returns: DataFrame, key: str, order: str = "date", ret: str = "ret") -> DataFrame:
    """Largest fall from the running peak of compounded wealth, as a positive fraction."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("wealth", F.product(1 + F.col(ret)).over(w)).withColumn("peak", F.max("wealth").over(w))
    return curve.groupBy(key).agg((-F.min(F.col("wealth") / F.col("peak") - 1) + 0.0).alias("max_drawdown"))


#: Ranks of so many distinct values are broadcast to the rows; beyond, rows and ranks meet in a shuffle.
BROADCAST_VALUES = 200_000


def value_ranks(df: DataFrame, column: str, sums: list[Column] | None = None, bins: int = 256, part: list[str] | None = None, exact: bool = False) -> DataFrame:
    """(part, value, n, before, sums): each distinct value of a part, how often it occurs, and how many of the part's rows lie below it.

    Equal values are added up first, in a shuffle with partial sums. Approximate
    quantiles then cut the values into bins that are counted on their own; only one
    total for each bin of a part meets in one task. So no task sees all rows of a part, whatever is tied.
    exact: values keep their type (else they are doubles), and nulls are values too, the last ones.
    """
    part = part or []
    rows, value = (df, F.col(column)) if exact else (df.where(F.col(column).isNotNull()), F.col(column).cast("double"))
    values = rows.groupBy(*part, value.alias("value")).agg(F.count(F.lit(1)).alias("n"), *(sums or []))
    number = F.col("value").cast("double")
    cuts = values.agg(F.percentile_approx(number, [i / bins for i in range(1, bins)], 10_000).alias("cuts")).first().cuts
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<double>")
    binned = values.withColumn("vr_bin", F.when(F.col("value").isNull(), bins).otherwise(F.size(F.filter(edges, lambda e: e < number))))
    totals = binned.groupBy(*part, "vr_bin").agg(F.sum("n").alias("vr_n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    under = totals.withColumn("vr_under", F.coalesce(F.sum("vr_n").over(earlier(Window.partitionBy(*part).orderBy("vr_bin"))), F.lit(0))).drop("vr_n")  # one row a bin
    here = F.coalesce(F.sum("n").over(earlier(Window.partitionBy(*part, "vr_bin").orderBy("value"))), F.lit(0))
    ranked = binned.withColumn("vr_here", here)
    if part:
        ranked = _beside(ranked, under, [*part, "vr_bin"])
    else:
        ranked = ranked.join(F.broadcast(under), "vr_bin")  # one row a bin
    return ranked.withColumn("before", F.col("vr_here") + F.col("vr_under")).drop("vr_bin", "vr_here", "vr_under")


def _beside(rows: DataFrame, found: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """rows with the other columns of their match in found; keys may be null."""
    named = found.withColumnsRenamed({k: f"b_{i}_{k}" for i, k in enumerate(keys)})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"b_{i}_{k}")) for i, k in enumerate(keys)])
    return rows.join(F.broadcast(named) if small else named, same).drop(*[f"b_{i}_{k}" for i, k in enumerate(keys)])


def average_ranks(df: DataFrame, column: str, part: list[str], out: str) -> DataFrame:
    """df with the rank of a number among its part's rows, ties averaged, nulls last. Ranks belong to values, so no task holds a part."""
    ranks = stored(value_ranks(df, column, part=part, exact=True).select(*part, F.col("value").alias("ar_value"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(out)), "average-ranks")
    return _beside(df.withColumn("ar_value", F.col(column)), ranks, [*part, "ar_value"], ranks.count() <= BROADCAST_VALUES).drop("ar_value")


def _digit(v: Column, lo: Column, hi: Column, inside: Column, bins: int, few: int) -> Column:
    """A number that never falls as v grows: v itself among few values, steps of an eighth of an octave over wide brackets, equal steps over narrow ones."""
    octave = F.floor(F.signum(v) * (F.log2(F.abs(F.nullif(v, F.lit(0.0)))) + 1100) * 8)
    narrow = ((lo > 0) & (hi <= 4 * lo)) | ((hi < 0) & (lo >= 4 * hi))
    return F.when(inside <= few, v).when(narrow, F.floor((v - lo) / (hi - lo) * bins).cast("double")).otherwise(F.coalesce(octave, F.lit(0)).cast("double"))


def group_quantiles(df: DataFrame, keys: list[str], column: str, probs: list[float], bins: int = 1024, few: int = 4096) -> DataFrame:
    """(keys, n_rows, q0, q1, ...): exact interpolated quantiles of each group, found digit by digit.

    Every wanted place of every group has a bracket of values around it. A round counts
    the bracket's rows by a digit of their values and goes on with the digit that holds
    the place, until one value is left; all groups and places share a round. Only counts
    are shuffled, at most one for each digit and bracket from a task, so a group may be
    of any size. Nulls and NaN do not count, groups without a value give no row.
    """
    named = [f"gq_{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(column).cast("double").alias("gq_v")).where("gq_v is not null and not isnan(gq_v)")
    rows = stored(rows, "quantile-values")
    same = lambda other: [F.col(n).eqNullSafe(F.col(f"{other}_{n}")) for n in named]
    under = lambda df_, other: df_.select(*[F.col(n).alias(f"{other}_{n}") for n in named], *[c for c in df_.columns if c not in named])
    sizes = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("gq_n"), F.min("gq_v").alias("gq_lo"), F.max("gq_v").alias("gq_hi")).where("gq_n > 0")
    at = [F.lit(float(p)) * (F.col("gq_n") - 1) for p in probs]
    places = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    brackets = stored(sizes.select(*named, "gq_n", F.explode(places).alias("gq_place"), "gq_lo", "gq_hi", F.lit(0).cast("long").alias("gq_before"), F.col("gq_n").alias("gq_inside")), "quantile-brackets")
    written, done = [rows, brackets], None
    # without keys there are at most two brackets a quantile
    side = (lambda d: d) if keys else F.broadcast
    while True:
        closed = brackets.where("gq_lo = gq_hi").select(*named, "gq_n", "gq_place", F.col("gq_lo").alias("gq_value"))
        done = closed if done is None else done.unionByName(closed)
        open_ = brackets.where("gq_lo < gq_hi")
        if not open_.limit(1).count():
            break
        ranges = under(open_.select(*named, "gq_lo", "gq_hi", "gq_inside").distinct(), "r")
        met = rows.join(side(ranges), reduce(lambda x, y: x & y, [*same("r"), F.col("gq_v").between(F.col("gq_lo"), F.col("gq_hi"))]))
        digit = _digit(F.col("gq_v"), F.col("gq_lo"), F.col("gq_hi"), F.col("gq_inside"), bins, few)
        bracket = [*named, "gq_lo", "gq_hi"]
        counts = met.groupBy(*bracket, digit.alias("gq_digit")).agg(F.count(F.lit(1)).alias("c"), F.min("gq_v").alias("least"), F.max("gq_v").alias("most"))
        ahead = F.coalesce(F.sum("c").over(Window.partitionBy(*bracket).orderBy("gq_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        steps = under(counts.withColumn("ahead", ahead).withColumnsRenamed({"gq_lo": "s_lo", "gq_hi": "s_hi"}), "s")
        here = reduce(lambda x, y: x & y, [*same("s"), F.col("gq_lo") == F.col("s_lo"), F.col("gq_hi") == F.col("s_hi")])
        found = side(open_).join(steps, here).where("gq_place >= gq_before + ahead and gq_place < gq_before + ahead + c")
        brackets = stored(found.select(*named, "gq_n", "gq_place", F.col("least").alias("gq_lo"), F.col("most").alias("gq_hi"), (F.col("gq_before") + F.col("ahead")).alias("gq_before"), F.col("c").alias("gq_inside")), "quantile-brackets")
        written.append(brackets)
    # two values a quantile at most
    values = done.groupBy(*named, "gq_n").agg(F.map_from_entries(F.collect_list(F.struct("gq_place", "gq_value"))).alias("gq_values"))
    value = lambda k: F.element_at("gq_values", k.cast("long"))
    inner = [value(F.floor(x)) + (value(F.ceil(x)) - value(F.floor(x))) * (x - F.floor(x)) for x in at]
    out = stored(values.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], F.col("gq_n").alias("n_rows"), *[q.alias(f"q{i}") for i, q in enumerate(inner)]), "quantiles")
    discard(*written)
    return out


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Interpolated quantiles of all rows, without a task that holds them all; None without any."""
    found = group_quantiles(df, [], column, probs)
    row = found.first()
    discard(found)
    return [row[f"q{i}"] if row else None for i in range(len(probs))]


def auc(df: DataFrame, score: str, label: str, part: list[str] | None = None, least: int = 1) -> DataFrame:
    """Exact AUC by average ranks, for each group with both labels and ``least`` rows."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranked = value_ranks(rows, score, [F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")], part=part)
    pos, neg, above = F.sum("p"), F.sum("q"), F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2.0))
    counted = ranked.groupBy(*(part or []))
    out = counted.agg(pos.alias("n_pos"), neg.alias("n_neg"), F.try_divide(above - pos * (pos + 1) / 2.0, (pos * neg).cast("double")).alias("auc"))
    return out.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") + F.col("n_neg") >= least))


def auc_summary(monthly: DataFrame, over: float = 0.55) -> DataFrame:
    """One row of periods' AUCs: how many, mean, deviation, and the share over a threshold."""
    return monthly.agg(F.count("auc").alias("n_months"), F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.avg((F.col("auc") > over).cast("double")).alias("share_over"))


def spearman(df: DataFrame, pairs: list[tuple[str, str]], part: list[str] | None = None, least: int = 3) -> DataFrame:
    """Rank correlation of each pair over rows where both are there, in long form; null where a side has under three values."""
    part = part or []
    out = None
    for x, y in pairs:
        both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        # ranks belong to values, so equal pairs are added up and meet the ranks of their values
        rank = (F.col("before") + (F.col("n") + 1) / 2.0)
        rx = value_ranks(both, x, part=part).select(*part, F.col("value").alias("vx"), rank.alias("rx"))
        ry = value_ranks(both, y, part=part).select(*part, F.col("value").alias("vy"), rank.alias("ry"))
        counted = both.groupBy(*part, F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")).agg(F.count(F.lit(1)).alias("c"))
        ranked = _beside(_beside(counted, rx, [*part, "vx"]), ry, [*part, "vy"])
        distinct = [F.count_distinct("vx"), F.count_distinct("vy")]
        c, a, b = F.col("c"), F.col("rx"), F.col("ry")
        n = F.sum(c)
        cov = F.sum(c * a * b) - F.sum(c * a) * F.sum(c * b) / n
        var = (F.sum(c * a * a) - F.sum(c * a) * F.sum(c * a) / n) * (F.sum(c * b * b) - F.sum(c * b) * F.sum(c * b) / n)
        rho = F.when(F.least(*distinct) >= 3, F.try_divide(cov, F.sqrt(var)))
        one = ranked.groupBy(*part).agg(n.alias("n"), rho.alias("rho")).where(F.col("n") >= least).select(*part, F.lit(x).alias("feature"), F.lit(y).alias("against"), "n", "rho")
        out = one if out is None else out.unionByName(one)
    return out


def strongest(correlations: DataFrame, n: int) -> DataFrame:
    """The n rows with the largest absolute correlation, ties by name."""
    return correlations.where(F.col("rho").isNotNull()).orderBy(F.abs("rho").desc(), "feature").limit(n)


def sign_flips(correlations: DataFrame, period: str, least: float = 0.02) -> DataFrame:
    """Per feature: periods whose correlation is over the least in size, and whether both signs occur among them."""
    strong = correlations.where(F.abs("rho") > least)
    return strong.groupBy("feature").agg(F.count(F.lit(1)).alias("n_periods"), F.count_if(F.col("rho") > 0).alias("n_positive"), ((F.max("rho") > 0) & (F.min("rho") < 0)).alias("flips"))


def top_precision(predictions: DataFrame, score: str, label: str, q: float = 0.9) -> DataFrame:
    """One row: the exact q-quantile of all scores, the rows at or over it, and the share of label 1 among them."""
    (cut,) = exact_quantiles(predictions, score, [q])
    top = predictions.where(F.col(score) >= F.lit(cut))
    return top.agg(F.lit(cut).cast("double").alias("cut"), F.count(F.lit(1)).alias("n_top"), F.avg(F.col(label).cast("double")).alias("precision"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts, accuracy, and precision, recall and F1 of both classes, in one row; class 1 without a suffix, class 0 with _0."""
    tp, fp = F.count_if((F.col(label) == 1) & (F.col(pred) == 1)), F.count_if((F.col(label) == 0) & (F.col(pred) == 1))
    fn, tn = F.count_if((F.col(label) == 1) & (F.col(pred) == 0)), F.count_if((F.col(label) == 0) & (F.col(pred) == 0))
    counts = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    scored = counts.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    for right, false, missed, end in (("tp", "fp", "fn", ""), ("tn", "fn", "fp", "_0")):
        p, r = F.col(f"precision{end}"), F.col(f"recall{end}")
        scored = scored.withColumn(f"precision{end}", F.try_divide(F.col(right), F.col(right) + F.col(false))).withColumn(f"recall{end}", F.try_divide(F.col(right), F.col(right) + F.col(missed)))
        scored = scored.withColumn(f"f1{end}", F.try_divide(2 * p * r, p + r))
    return scored


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_upper(t: float, df: float) -> float:
    """P(T >= t) of Student's distribution."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def wilcoxon_upper(ranks_plus: float, n: int, ties: float, whole_ranks: bool) -> float:
    """P(W+ >= w): exact for up to 50 untied differences, else the normal approximation with tie correction."""
    if n <= 50 and whole_ranks:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1
        for r in range(1, n + 1):
            counts[r:] = counts[r:] + counts[: len(counts) - r].copy()
        return float(counts[int(ranks_plus) :].sum() / counts.sum())
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return 0.5 * math.erfc((ranks_plus - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else float("nan")


def paired_statistics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, mean difference, t, and Wilcoxon's positive rank sum with its tie sums."""
    diffs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.col(a) - F.col(b))
    base = diffs.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), t_of_mean(F.col("d")).alias("t_statistic")).first()
    sizes = diffs.where("d <> 0").select(F.abs("d").alias("size"), (F.col("d") > 0).alias("up"))
    ties = value_ranks(sizes, "size", [F.count_if("up").alias("ups")]).select(F.col("n").cast("double").alias("k"), (F.col("ups") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("plus"))
    signed = ties.agg(F.coalesce(F.sum("plus"), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum("k"), F.lit(0.0)).cast("long").alias("n_nonzero"), F.coalesce(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")), F.lit(0.0)).alias("tie_sum"))
    return signed.select(F.lit(base.n).cast("long").alias("n"), F.lit(base.mean_diff).cast("double").alias("mean_diff"), F.lit(base.t_statistic).cast("double").alias("t_statistic"), "*")


def paired_test(pairs: DataFrame, a: str, b: str) -> dict:
    """One-sided paired t and Wilcoxon tests of a > b; significant if either p is under 0.05."""
    r = paired_statistics(pairs, a, b).first()
    out = {"mean_diff": r.mean_diff, "t_statistic": r.t_statistic, "p_value_ttest": None, "w_statistic": None, "p_value_wilcoxon": None, "significant_005": False, "n_paired_obs": r.n}
    if r.n >= 2 and r.t_statistic is not None:
        out["p_value_ttest"] = t_upper(r.t_statistic, r.n - 1)
    if r.n >= 2 and r.n_nonzero >= 2:
        out |= {"w_statistic": r.w_plus, "p_value_wilcoxon": wilcoxon_upper(r.w_plus, r.n_nonzero, r.tie_sum, r.tie_sum == 0)}
    out["significant_005"] = any(p is not None and p < 0.05 for p in (out["p_value_ttest"], out["p_value_wilcoxon"]))
    return out


@F.pandas_udf(DoubleType())
def _t_upper(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(n) or n < 1 else t_upper(x, n) for x, n in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _wilcoxon_upper(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or k < 2 else wilcoxon_upper(x, int(k), c, c == 0) for x, k, c in zip(w, n, ties, strict=True)], dtype=float)


def paired_tests(returns: DataFrame, baseline: str, digits: int = 9, order: str = "date") -> DataFrame:
    """Each strategy against the baseline on common dates: one-sided paired t and Wilcoxon tests, one row a strategy.

    returns: strategy, date, ret. Differences are rounded to ``digits`` places, so that what
    cancels counts as zero whatever the order of addition. The p-values are worked out on
    the finished rows; significant if either is under 0.05, a missing one never is.
    """
    base = returns.where(F.col("strategy") == baseline).select(order, F.col("ret").alias("pt_base"))
    diffs = returns.where(F.col("strategy") != baseline).join(base, order).select("strategy", F.round(F.col("ret") - F.col("pt_base"), digits).alias("d")).where("d is not null")
    mean = diffs.groupBy("strategy").agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), t_of_mean(F.col("d")).alias("t_statistic"))
    # equal sizes first; a strategy has one row a date at most
    sizes = diffs.where("d <> 0").groupBy("strategy", F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("d") > 0).alias("ups"))
    below = F.coalesce(F.sum("k").over(Window.partitionBy("strategy").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("plus", F.col("ups") * (below + (F.col("k") + 1) / 2.0)).withColumn("k", F.col("k").cast("double"))
    signed = ranked.groupBy("strategy").agg(F.sum("plus").alias("w_statistic"), F.sum("k").alias("n_nonzero"), F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("tie_sum"))
    both = mean.join(signed, "strategy", "left").withColumn("w_statistic", F.when(F.col("n_nonzero") >= 2, F.col("w_statistic")))
    tested = both.withColumn("p_value_ttest", _t_upper("t_statistic", F.col("n") - 1.0)).withColumn("p_value_wilcoxon", _wilcoxon_upper("w_statistic", "n_nonzero", "tie_sum"))
    small = lambda c: F.coalesce(F.col(c) < 0.05, F.lit(False))
    return tested.withColumn("significant_005", small("p_value_ttest") | small("p_value_wilcoxon")).drop("n_nonzero", "tie_sum")


def with_p_value(correlations: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Correlations with their two-sided p-value by Student's distribution, 0 for a perfect one; one row a correlation."""
    r, free = F.col(rho), F.col(n) - 2.0
    t = F.abs(r) * F.sqrt(free / F.nullif(1 - r * r, F.lit(0.0)))
    return correlations.withColumn("p_value", F.when(F.abs(r) >= 1, 0.0).otherwise(2 * _t_upper(t, free)))


def ols_hac(y: np.ndarray, x: np.ndarray, lags: int = 3, least: int = 12) -> tuple[float | None, float | None]:
    """Intercept and its t with Newey-West errors; for the few monthly rows of a finished aggregate."""
    if len(y) < least:
        return None, None
    x = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    # each row's part in the intercept's error; its variance with weighted autocovariances
    z = (y - x @ beta) * (x @ inv[0])
    var = z @ z + 2 * sum((1 - lag / (lags + 1)) * (z[lag:] @ z[:-lag]) for lag in range(1, lags + 1))
    return float(beta[0]), float(beta[0] / math.sqrt(var)) if var > 0 else None


def alpha(returns: DataFrame, factors: DataFrame, key: str | None = None, ret: str = "ret", month: str = "month", names: tuple[str, ...] = ("mkt_rf", "smb", "hml"), lags: int = 3) -> DataFrame:
    """(key, alpha, t, n): regression of monthly returns on factors, one small task for each key (strategy or permutation)."""
    label = key or "alpha_key"
    rows = returns.withColumn(label, F.lit(0)) if key is None else returns
    joined = rows.where(F.col(ret).isNotNull()).join(factors, month).dropna(subset=list(names)).select(label, month, ret, *names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(month, kind="stable")
        a, t = ols_hac(pdf[ret].to_numpy(float), pdf[list(names)].to_numpy(float), lags)
        return pd.DataFrame({label: [pdf[label].iloc[0]], "alpha": [a], "t": [t], "n": [len(pdf)]})

    out = joined.groupBy(label).applyInPandas(run, f"{label} {dict(rows.dtypes)[label]}, alpha double, t double, n long")
    return out.drop(label) if key is None else out
