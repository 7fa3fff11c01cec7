"""Queries of ordered-series functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import series as S
from panelforge.functions import stats as T
from panelforge.operators import panel as P
from panelforge.operators import sentiment as M
from panelforge.plans.fixtures import BARS, MESSAGES, bars, messages, read
from panelforge.plans.registry import query

_W = "PARTITION BY ticker ORDER BY date"


@query("w1_w2_leads", f"WITH {BARS} SELECT ticker, date, lead(close, 1) OVER w AS close_1, lead(close, 10) OVER w AS close_10, lead(date, 5) OVER w AS date_5 FROM bars WINDOW w AS ({_W})", ["close_1", "close_10"])
def w1(spark, sf):
    w = S.by("ticker")
    return bars(spark, sf).select("ticker", "date", F.lead("close", 1).over(w).alias("close_1"), F.lead("close", 10).over(w).alias("close_10"), F.lead("date", 5).over(w).alias("date_5"))


@query("w3_compound_lead", f"WITH {BARS}, r AS (SELECT ticker, date, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS ({_W})) SELECT ticker, date, (1 + lead(ret, 1) OVER w) * (1 + lead(ret, 2) OVER w) * (1 + lead(ret, 3) OVER w) - 1 AS ret_3 FROM r WINDOW w AS ({_W})", ["ret_3"])
def w3(spark, sf):
    w = S.by("ticker")
    r = bars(spark, sf).withColumn("ret", S.pct_change(F.col("close"), w))
    return r.select("ticker", "date", S.compound_lead(F.col("ret"), w, 3).alias("ret_3"))


@query("w4_pct_change_pad", f"WITH {BARS}, g AS (SELECT ticker, date, CASE WHEN day(date) % 5 <> 0 THEN close END AS close FROM bars), f AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM g) SELECT ticker, date, c / lag(c) OVER ({_W}) - 1 AS ret FROM f", ["ret"])
def w4(spark, sf):
    g = bars(spark, sf).withColumn("close", F.when(F.dayofmonth("date") % 5 != 0, F.col("close")))
    return g.select("ticker", "date", S.pct_change(F.col("close"), S.by("ticker")).alias("ret"))


@query("w6_w7_rolling", f"WITH {BARS} SELECT ticker, date, CASE WHEN count(close) OVER (w ROWS 6 PRECEDING) >= 2 THEN avg(close) OVER (w ROWS 6 PRECEDING) END AS ma7, CASE WHEN count(close) OVER (w ROWS 19 PRECEDING) >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS ma20, CASE WHEN count(close) OVER (w ROWS 29 PRECEDING) >= 5 THEN stddev_samp(close) OVER (w ROWS 29 PRECEDING) END AS sd30 FROM bars WINDOW w AS ({_W})", ["ma7", "ma20", "sd30"])
def w6(spark, sf):
    w, c = S.by("ticker"), F.col("close")
    return bars(spark, sf).select("ticker", "date", S.rolling(F.avg, c, w, 7, 2).alias("ma7"), S.rolling(F.avg, c, w, 20).alias("ma20"), S.rolling(F.stddev_samp, c, w, 30, 5).alias("sd30"))


@query("w8_rolling_median", f"WITH {BARS} SELECT ticker, date, CASE WHEN count(close) OVER (w ROWS 59 PRECEDING) >= 30 THEN quantile_cont(close * volume, 0.5) OVER (w ROWS 59 PRECEDING) END AS dollar_vol FROM bars WINDOW w AS ({_W})", ["dollar_vol"])
def w8(spark, sf):
    return P.liquidity(bars(spark, sf)).select("ticker", "date", "dollar_vol")


@query("w5_w9_w10_p20_signals", f"""WITH {MESSAGES}, d AS (SELECT ticker, date, avg(prob_positive - prob_negative) AS net, count(*)::DOUBLE AS n FROM msgs GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN count(net) OVER (w ROWS 6 PRECEDING) >= 2 THEN net - avg(net) OVER (w ROWS 6 PRECEDING) END AS sent_delta_ma7, CASE WHEN count(n) OVER (w ROWS 29 PRECEDING) >= 5 THEN (n - avg(n) OVER (w ROWS 29 PRECEDING)) / nullif(stddev_samp(n) OVER (w ROWS 29 PRECEDING), 0) END AS mention_zscore_30d, net - lag(net) OVER w AS signal_change FROM d WINDOW w AS ({_W}))
 SELECT ticker, date, sent_delta_ma7, mention_zscore_30d, signal_change, CAST(coalesce(mention_zscore_30d >= 2, false) AS INTEGER) AS event_day FROM s""", ["sent_delta_ma7", "mention_zscore_30d", "signal_change"])
def w9(spark, sf):
    d = messages(spark, sf).groupBy("ticker", "date").agg(F.avg(F.col("prob_positive") - F.col("prob_negative")).alias("net"), F.count(F.lit(1)).cast("double").alias("n"))
    return P.enrich_mentions(d, "net", "n").select("ticker", "date", "sent_delta_ma7", "mention_zscore_30d", "signal_change", "event_day")


@query("w11_latest_non_null", f"WITH {MESSAGES} SELECT ticker, arg_max(sentiment, post_id) FILTER (WHERE sentiment IS NOT NULL) AS sentiment, arg_max(native_label, post_id) FILTER (WHERE native_label IS NOT NULL) AS native_label FROM msgs GROUP BY 1", ["sentiment"])
def w11(spark, sf):
    return M.latest_values(messages(spark, sf), "ticker", "post_id", ["sentiment", "native_label"])


@query("w12_w13_w14_momentum", f"""WITH RECURSIVE {BARS}, o AS (SELECT ticker, date, close, row_number() OVER ({_W}) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
 x AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY k), 0) AS d FROM o),
 e AS (SELECT ticker, date, k, close AS f, close AS s, greatest(d, 0) AS u, greatest(-d, 0) AS v FROM x WHERE k = 1
  UNION ALL SELECT x.ticker, x.date, x.k, e.f * (1 - 2/13.0::DOUBLE) + x.close * (2/13.0::DOUBLE), e.s * (1 - 2/27.0::DOUBLE) + x.close * (2/27.0::DOUBLE), e.u * (1 - 1/14.0::DOUBLE) + greatest(x.d, 0) * (1/14.0::DOUBLE), e.v * (1 - 1/14.0::DOUBLE) + greatest(-x.d, 0) * (1/14.0::DOUBLE) FROM e JOIN x ON x.ticker = e.ticker AND x.k = e.k + 1),
 m AS (SELECT *, f - s AS line FROM e),
 g AS (SELECT ticker, k, line AS sig FROM m WHERE k = 26 UNION ALL SELECT m.ticker, m.k, g.sig * 0.8::DOUBLE + m.line * 0.2::DOUBLE FROM g JOIN m ON m.ticker = g.ticker AND m.k = g.k + 1)
 SELECT o.ticker, o.date, o.close, CASE WHEN m.k >= 14 THEN CASE WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END END AS rsi, CASE WHEN m.k >= 26 THEN line END AS macd, CASE WHEN m.k >= 34 THEN sig END AS macd_signal, CASE WHEN m.k >= 34 THEN line - sig END AS macd_hist
 FROM o JOIN m ON o.ticker = m.ticker AND o.k = m.k LEFT JOIN g ON g.ticker = m.ticker AND g.k = m.k""", ["close", "rsi", "macd", "macd_signal", "macd_hist"])
def w12(spark, sf):
    return S.with_momentum(bars(spark, sf).drop("volume"))


@query("w12_ema_fold", f"WITH RECURSIVE {BARS}, a AS (SELECT ticker, strftime(date, '%Y-%m') AS month, avg(close) AS x FROM bars GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY month) AS k FROM a), e AS (SELECT ticker, k, x AS ema FROM o WHERE k = 1 UNION ALL SELECT o.ticker, o.k, e.ema * 0.75::DOUBLE + o.x * 0.25::DOUBLE FROM e JOIN o ON o.ticker = e.ticker AND o.k = e.k + 1) SELECT ticker, k::INTEGER AS k, ema FROM e", ["ema"])
def w12_fold(spark, sf):
    a = bars(spark, sf).groupBy("ticker", F.date_format("date", "yyyy-MM").alias("month")).agg(F.avg("close").alias("x"))
    s = a.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "x"))), lambda r: r["x"]).alias("xs"))
    return s.select("ticker", F.posexplode(S.ema_fold(F.col("xs"), 0.25)).alias("k", "ema")).select("ticker", (F.col("k") + 1).alias("k"), "ema")


@query("w15_w16_w17_bar_features", f"""WITH {BARS}, i AS (SELECT *, close / lag(close) OVER w - 1 AS ret, lead(close, 5) OVER w / close - 1 AS fwd, count(*) OVER (w ROWS 19 PRECEDING) AS n, avg(close) OVER (w ROWS 19 PRECEDING) AS mid, stddev_pop(close) OVER (w ROWS 19 PRECEDING) AS sd, avg(volume) OVER (w ROWS 19 PRECEDING) AS mv FROM bars WINDOW w AS ({_W})),
 j AS (SELECT *, count(ret) OVER (w ROWS 19 PRECEDING) AS nr, stddev_samp(ret) OVER (w ROWS 19 PRECEDING) AS sr FROM i WINDOW w AS ({_W}))
 SELECT ticker, date, CASE WHEN n >= 20 THEN 4 * sd / mid END AS bb_width, CASE WHEN n >= 20 AND sd > 0 THEN (close - mid + 2 * sd) / (4 * sd) END AS bb_pct, CASE WHEN nr >= 20 THEN sr END AS volatility_20d, CASE WHEN n >= 20 THEN volume / mv END AS volume_ratio, fwd AS return_5d_forward FROM j""", ["bb_width", "bb_pct", "volatility_20d", "volume_ratio", "return_5d_forward"])
def w15(spark, sf):
    return P.bar_features(bars(spark, sf)).select("ticker", "date", "bb_width", "bb_pct", "volatility_20d", "volume_ratio", "return_5d_forward")


@query("w18_wealth_drawdown", f"WITH {BARS}, r AS (SELECT ticker, date, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS ({_W})), x AS (SELECT ticker, date, product(1 + least(greatest(ret, -0.05), 0.05)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM r WHERE ret IS NOT NULL), p AS (SELECT *, max(wealth) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM x) SELECT ticker, -min(wealth / peak - 1) + 0.0 AS max_drawdown FROM p GROUP BY 1", ["max_drawdown"])
def w18(spark, sf):
    from panelforge.functions.stats import drawdowns

    r = bars(spark, sf).withColumn("ret", S.pct_change(F.col("close"), S.by("ticker"))).where("ret is not null")
    return drawdowns(r.withColumn("ret", F.least(F.greatest("ret", F.lit(-0.05)), F.lit(0.05))), "ticker")


@query("w19_deciles", f"WITH {BARS}, m AS (SELECT ticker, date_trunc('month', date)::DATE AS month, avg(close) AS x FROM bars GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY x, ticker) AS k, count(*) OVER (PARTITION BY month) AS n FROM m) SELECT ticker, month, CASE WHEN n >= 10 THEN greatest(ceil((k - 1) * 10 / greatest(n - 1, 1)::DOUBLE)::INTEGER - 1, 0) END AS decile FROM r")
def w19(spark, sf):
    m = bars(spark, sf).groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.avg("close").alias("x"))
    return P.deciles(m, "x", "month", "ticker").select("ticker", "month", "decile")


@query("w20_quartile_bins", "WITH c AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders) SELECT o_orderkey, (CAST(o_totalprice > q[1] AS INTEGER) + CAST(o_totalprice > q[2] AS INTEGER) + CAST(o_totalprice > q[3] AS INTEGER)) AS bin FROM orders, c")
def w20(spark, sf):
    return P.quantile_bins(read(spark, sf, "orders"), "o_totalprice", [0.25, 0.5, 0.75]).select("o_orderkey", "bin")


@query("w21_winsorise", "WITH x AS (SELECT event_id, CAST(ts AS DATE) AS date, value FROM events), q AS (SELECT date, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM x GROUP BY 1) SELECT event_id, date, least(greatest(value, lo), hi) AS value FROM x JOIN q USING (date)", ["value"])
def w21(spark, sf):
    x = read(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("date"), "value")
    return P.winsorise(x, "value", "date")


@query("w22_group_transform", f"WITH {MESSAGES} SELECT post_id, avg(CAST(label = 'positive' AS INTEGER)) OVER (PARTITION BY date) AS up_rate FROM msgs", ["up_rate"])
def w22(spark, sf):
    return messages(spark, sf).select("post_id", F.avg((F.col("label") == "positive").cast("int")).over(Window.partitionBy("date")).alias("up_rate"))


@query("w23_average_ranks", "SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem", ["r"])
def w23(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return T.average_ranks(rows, "l_quantity", ["l_returnflag"], "r").select("l_orderkey", "l_linenumber", "l_partkey", "r")


@query("w24_g5_month_ends", f"WITH {BARS}, l AS (SELECT ticker, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close FROM bars WHERE month(date) <> 3 GROUP BY 1, 2), s AS (SELECT ticker, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM l GROUP BY 1) SELECT ticker, month, close FROM s LEFT JOIN l USING (ticker, month)", ["close"])
def w24(spark, sf):
    return P.month_ends(bars(spark, sf).where(F.month("date") != 3))


@query("w25_rebalance_dates", f"WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM bars)) SELECT date FROM d WHERE k % 5 = 0")
def w25(spark, sf):
    from panelforge.operators.portfolio import rebalance_dates

    return rebalance_dates(bars(spark, sf), 5)


@query("w26_equity_relative", f"WITH {BARS} SELECT ticker, date, close / first_value(close) OVER ({_W}) - 1 AS rel FROM bars", ["rel"])
def w26(spark, sf):
    return bars(spark, sf).select("ticker", "date", (F.col("close") / F.first("close").over(S.by("ticker")) - 1).alias("rel"))
