"""Ordered-series functions per key: shifts, rolling windows, exponential averages, indicators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.storage import discard, stored


def by(key: str | list[str], order: str = "date") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def rolling(fn, c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """fn over the last n rows, null until ``least`` (n, if none) values are there."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) >= (least or n), fn(c).over(frame))


def rolling_median(c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return rolling(lambda x: F.percentile(x, F.lit(0.5)), c, w, n, least)


def pct_change(c: Column, w: WindowSpec) -> Column:
    """Change against the row before, gaps filled forward first."""
    filled = F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(filled, before) - 1


def forward_return(c: Column, w: WindowSpec, h: int) -> Column:
    return F.try_divide(F.lead(c, h).over(w), c) - 1


def compound_lead(ret: Column, w: WindowSpec, h: int) -> Column:
    out = F.lit(1.0)
    for i in range(1, h + 1):
        out = out * (1 + F.lead(ret, i).over(w))
    return out - 1


def z_score(c: Column, w: WindowSpec, n: int, least: int) -> Column:
    sd = rolling(F.stddev_samp, c, w, n, least)
    return F.try_divide(c - rolling(F.avg, c, w, n, least), F.nullif(sd, F.lit(0.0)))


def bollinger(c: Column, w: WindowSpec, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle, lower band; the deviation is that of the population."""
    mid, sd = rolling(F.avg, c, w, n), rolling(F.stddev_pop, c, w, n)
    return mid + k * sd, mid, mid - k * sd


def band_width(upper: Column, middle: Column, lower: Column) -> Column:
    return F.when(middle != 0, (upper - lower) / middle)


def band_position(c: Column, upper: Column, lower: Column) -> Column:
    return F.when(upper != lower, (c - lower) / (upper - lower))


def wealth(ret: Column, w: WindowSpec) -> Column:
    return F.product(1 + ret).over(w.rowsBetween(Window.unboundedPreceding, 0))


def qcut_bucket(rank: Column, n: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a rank 1..n by interpolated quantiles of the ranks, right-closed."""
    return F.greatest(F.ceil((rank - 1) * buckets / F.greatest(n - 1, F.lit(1))).cast("int") - 1, F.lit(0))


#: What lies so many halvings back no longer reaches a double.
_HALVINGS = 80


def scan_blocks(rows: DataFrame, key: str, order: str, block: Column, last: str, written: list[DataFrame]) -> DataFrame:
    """rows with es_block, es_k (their number in the key, from 1), es_first (that of their block's first row), es_n (rows of the key) and es_before (``last`` of the row before).

    A block must hold few rows; only one row a block is put in order over a whole key.
    What is read twice is written once, and added to ``written``.
    """
    marked = stored(rows.withColumn("es_block", block), "series")
    written.append(marked)
    sizes = marked.groupBy(key, "es_block").agg(F.count(F.lit(1)).alias("es_rows"), F.max_by(last, order).alias("es_last"))
    over = Window.partitionBy(key).orderBy("es_block")
    ahead = F.coalesce(F.sum("es_rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = sizes.select(key, "es_block", (ahead + 1).alias("es_first"), F.lag("es_last").over(over).alias("es_last"), F.sum("es_rows").over(Window.partitionBy(key)).alias("es_n"))
    inside = Window.partitionBy(key, "es_block").orderBy(order)
    placed = marked.join(heads, [key, "es_block"])
    return placed.withColumn("es_k", F.col("es_first") + F.row_number().over(inside) - 1).withColumn("es_before", F.coalesce(F.lag(last).over(inside), F.col("es_last"))).drop("es_last")


def ema_scan(rows: DataFrame, key: str, order: str, averages: dict[str, tuple[Column, float, int]], written: list[DataFrame]) -> DataFrame:
    """Exponential averages of rows from scan_blocks(); averages: name -> (values, alpha, number of the row they start at).

    y = (1 - alpha) y + alpha x is a linear step, so steps of a block compose to one
    pair (decay, sum), and the value before a block follows from the pairs of earlier
    blocks. Only pairs cross blocks: a key of any length is worked on block by block, in
    as many tasks as there are blocks. The first value is x itself; null before it.
    """
    decay = {n: -math.log(1 - alpha) for n, (_, alpha, _) in averages.items()}
    k, first, start = F.col("es_k"), F.col("es_first"), {n: s for n, (_, _, s) in averages.items()}
    step = {n: F.when(k > s, x * alpha).when(k == s, x) for n, (x, alpha, s) in averages.items()}
    inside = Window.partitionBy(key, "es_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"es_y_{n}": F.sum(step[n] * F.exp((k - first) * decay[n])).over(inside) * F.exp((first - k) * decay[n]) for n in averages})
    local = stored(local, "series")
    written.append(local)
    ends = local.groupBy(key, "es_block").agg(F.max("es_k").alias("es_end"), *[F.coalesce(F.max_by(f"es_y_{n}", "es_k"), F.lit(0.0)).alias(f"es_b_{n}") for n in averages])
    over = Window.partitionBy(key).orderBy("es_end")
    reach = math.ceil(_HALVINGS * math.log(2) / min(decay.values()))
    near = over.rangeBetween(-reach, 0)

    def summed(n: str) -> Column:
        return F.aggregate(F.collect_list(F.struct("es_end", f"es_b_{n}")).over(near), F.lit(0.0), lambda acc, p: acc + p[f"es_b_{n}"] * F.exp((p["es_end"] - F.col("es_end")) * decay[n]))

    sums = {n: summed(n) for n in averages}
    carried = ends.select(key, "es_block", "es_end", *[c.alias(f"es_c_{n}") for n, c in sums.items()])
    carried = carried.select(key, "es_block", *[F.coalesce(F.lag(f"es_c_{n}").over(over), F.lit(0.0)).alias(f"es_c_{n}") for n in averages])
    whole = local.join(carried, [key, "es_block"])
    out = {n: F.when(k >= start[n], F.coalesce(F.col(f"es_y_{n}"), F.lit(0.0)) + F.col(f"es_c_{n}") * F.exp((first - k - 1) * decay[n])) for n in averages}
    return whole.withColumns(out).drop(*[f"es_{x}_{n}" for n in averages for x in ("y", "c")])


def day_block(order: str = "date", days: int = 256) -> Column:
    return F.floor(F.unix_date(order) / days)


def with_momentum(bars: DataFrame, key: str = "ticker", order: str = "date", close: str = "close", least: int = 26, block: Column | None = None, rsi_n: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """bars with RSI and MACD columns, null until warmed up; keys with fewer than ``least`` bars get nulls.

    block: what cuts a key's rows into runs of few hundred, in order (256 days, if none).
    Rows without a close take no part and get nulls.
    """
    names, written = bars.columns, []
    there = scan_blocks(bars.where(F.col(close).isNotNull()), key, order, day_block(order) if block is None else block, close, written)
    step = F.coalesce(F.col(close).cast("double") - F.col("es_before"), F.lit(0.0))
    x = F.col(close).cast("double")
    firsts = ema_scan(there, key, order, {"wm_up": (F.greatest(step, F.lit(0.0)), 1 / rsi_n, 1), "wm_down": (F.greatest(-step, F.lit(0.0)), 1 / rsi_n, 1), "wm_fast": (x, 2 / (fast + 1), 1), "wm_slow": (x, 2 / (slow + 1), 1)}, written)
    line = firsts.withColumn("wm_line", F.col("wm_fast") - F.col("wm_slow"))
    both = ema_scan(line, key, order, {"wm_signal": (F.col("wm_line"), 2 / (signal + 1), slow)}, written)
    discard(*written[:-1])
    k, enough = F.col("es_k"), F.col("es_n") >= least
    ready = slow + signal - 1
    out = {
        "rsi": F.when(enough & (k >= rsi_n), F.when(F.col("wm_down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("wm_up") / F.nullif("wm_down", F.lit(0.0))))),
        "macd": F.when(enough & (k >= slow), F.col("wm_line")), "macd_signal": F.when(enough & (k >= ready), F.col("wm_signal")), "macd_hist": F.when(enough & (k >= ready), F.col("wm_line") - F.col("wm_signal")),
    }
    done = both.select(*names, *[c.alias(n) for n, c in out.items()])
    return done.unionByName(bars.where(F.col(close).isNull()).select("*", *[F.lit(None).cast("double").alias(n) for n in out]))


def ema_fold(values: Column, alpha: float) -> Column:
    """Exponential averages of an ordered array without Python; for short series (quadratic)."""
    step = lambda acc, x: F.array_append(acc, F.coalesce(F.element_at(acc, -1) * (1 - alpha) + x * alpha, x))
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1), step)
