"""Queries of statistics, portfolios and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import series as S
from panelforge.functions import stats as T
from panelforge.operators import panel as P
from panelforge.operators import portfolio as B
from panelforge.operators import training as L
from panelforge.plans.fixtures import BARS, PAIRED, bars, read, t_upper_sql
from panelforge.plans.registry import query

_PANEL = f"{BARS}, r AS (SELECT ticker, date, close, volume, lead(close) OVER w / close - 1 AS raw, close / lag(close) OVER w - 1 AS past FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), panel AS (SELECT ticker, date, close, volume, past, least(greatest(raw, -0.02), 0.02) AS ret, CAST(past < 0 AS INTEGER) AS signal FROM r WHERE raw IS NOT NULL AND past IS NOT NULL)"
_STRATS = "s AS (SELECT date, coalesce(avg(ret) FILTER (WHERE signal = 1), 0) AS a, avg(ret) AS b FROM panel GROUP BY 1), long AS (SELECT date, 'contrarian' AS strategy, a AS ret FROM s UNION ALL SELECT date, 'hold', b FROM s)"

_STRATS3 = "s AS (SELECT date, coalesce(avg(ret) FILTER (WHERE signal = 1), 0) AS a, coalesce(avg(ret) FILTER (WHERE past > 0), 0) AS b, avg(ret) AS c FROM panel GROUP BY 1), long AS (SELECT date, 'contrarian' AS strategy, a AS ret FROM s UNION ALL SELECT date, 'momentum', b FROM s UNION ALL SELECT date, 'hold', c FROM s)"


def _panel(spark, sf):
    w = S.by("ticker")
    r = bars(spark, sf).withColumn("raw", S.forward_return(F.col("close"), w, 1)).withColumn("past", S.pct_change(F.col("close"), w)).where("raw is not null and past is not null")
    return r.select("ticker", "date", "close", "volume", "past", F.least(F.greatest("raw", F.lit(-0.02)), F.lit(0.02)).alias("ret"), (F.col("past") < 0).cast("int").alias("signal"))


def _strategies(spark, sf):
    p = _panel(spark, sf)
    return B.compare({"contrarian": B.long_only(p), "hold": B.buy_and_hold(p)})


def _three_strategies(spark, sf):
    p = _panel(spark, sf)
    return B.compare({"contrarian": B.long_only(p), "momentum": B.long_only(p.withColumn("up", (F.col("past") > 0).cast("int")), "up"), "hold": B.buy_and_hold(p)})


@query("a9_a10_b1_b2_strategies", f"WITH {_PANEL}, {_STRATS} SELECT * FROM long", ["ret"])
def b1(spark, sf):
    return _strategies(spark, sf)


@query("t1_t2_t3_t4_a24_metrics", f"""WITH {_PANEL}, {_STRATS}, w AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM long), p AS (SELECT *, max(wealth) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM w)
 SELECT strategy, count(*) AS n, product(1 + ret) - 1 AS cumulative, pow(product(1 + ret), 252.0 / count(*)) - 1 AS cagr, avg(ret) * sqrt(252) / stddev_samp(ret) AS sharpe, -min(wealth / peak - 1) + 0.0 AS max_drawdown FROM p GROUP BY 1""", ["cumulative", "cagr", "sharpe", "max_drawdown"])
def t4(spark, sf):
    return B.metrics(_strategies(spark, sf))


@query("t5_paired_statistics", f"""WITH {_PANEL}, {_STRATS}, d AS (SELECT round(a - b, 9) AS d FROM s), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM d WHERE d <> 0)
 SELECT (SELECT count(*) FROM d) AS n, (SELECT avg(d) FROM d) AS mean_diff, (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) FROM d) AS t_statistic, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, count(*) AS n_nonzero, sum(c * c - 1)::DOUBLE AS tie_sum FROM k""", ["mean_diff", "t_statistic", "w_plus", "tie_sum"])
def t5(spark, sf):
    wide = _strategies(spark, sf).groupBy("date").pivot("strategy", ["contrarian", "hold"]).agg(F.first("ret"))
    return T.paired_statistics(wide.select(F.round(F.col("contrarian") - F.col("hold"), 9).alias("a"), F.lit(0.0).alias("b")), "a", "b")


@query("t5_paired_p_values", f"WITH {_PANEL}, {_STRATS3}, {PAIRED} SELECT strategy, n, mean_diff, t_statistic, w_statistic, p_value_ttest, p_value_wilcoxon, significant_005 FROM tested", ["mean_diff", "t_statistic", "w_statistic", "p_value_ttest", "p_value_wilcoxon"])
def t5_p_values(spark, sf):
    return T.paired_tests(_three_strategies(spark, sf), "hold")


@query("t6_spearman", f"WITH {_PANEL}, k AS (SELECT rank() OVER (ORDER BY past) + (count(*) OVER (PARTITION BY past) - 1) / 2.0 AS a, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2.0 AS b FROM panel), c AS (SELECT count(*) AS n, corr(a, b) AS rho FROM k) SELECT 'past' AS feature, 'ret' AS against, n, rho, 2 * {t_upper_sql('(abs(rho) * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')} AS p_value FROM c", ["rho", "p_value"])
def t6(spark, sf):
    return T.with_p_value(T.spearman(_panel(spark, sf), [("past", "ret")]))


@query("t6_spearman_by_decade", f"WITH {_PANEL}, x AS (SELECT year(date) // 10 * 10 AS decade, volume, ret FROM panel), k AS (SELECT decade, rank() OVER (PARTITION BY decade ORDER BY volume) + (count(*) OVER (PARTITION BY decade, volume) - 1) / 2.0 AS a, rank() OVER (PARTITION BY decade ORDER BY ret) + (count(*) OVER (PARTITION BY decade, ret) - 1) / 2.0 AS b FROM x), c AS (SELECT decade, count(*) AS n, corr(a, b) AS rho FROM k GROUP BY 1) SELECT decade, 'volume' AS feature, 'ret' AS against, n, rho, 2 * {t_upper_sql('(abs(rho) * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')} AS p_value FROM c", ["rho", "p_value"])
def t6_decades(spark, sf):
    decade = F.floor(F.year("date") / 10) * 10
    return T.with_p_value(T.spearman(_panel(spark, sf).withColumn("decade", decade), [("volume", "ret")], ["decade"]))


@query("t7_pearson_sign_flip", f"WITH {_PANEL}, rho AS (SELECT corr(past, ret) FILTER (WHERE date < DATE '1999-01-01') AS train_rho, corr(past, ret) FILTER (WHERE date >= DATE '1999-01-01') AS test_rho FROM panel) SELECT *, sign(train_rho) <> sign(test_rho) AS flips FROM rho", ["train_rho", "test_rho"])
def t7(spark, sf):
    early = F.col("date") < F.lit("1999-01-01").cast("date")
    both = _panel(spark, sf).agg(F.corr(F.when(early, F.col("past")), F.when(early, F.col("ret"))).alias("train_rho"), F.corr(F.when(~early, F.col("past")), F.when(~early, F.col("ret"))).alias("test_rho"))
    return both.withColumn("flips", F.signum("train_rho") != F.signum("test_rho"))


@query("t8_t_of_mean", f"WITH {_PANEL} SELECT ticker, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t FROM panel GROUP BY 1", ["t"])
def t8(spark, sf):
    return _panel(spark, sf).groupBy("ticker").agg(T.t_of_mean(F.col("ret")).alias("t"))


@query("m10_auc_overall", "WITH x AS (SELECT n_chars::DOUBLE AS s, quality AS y FROM documents JOIN labels USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x) SELECT count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM k", ["auc"])
def m10(spark, sf):
    x = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("s"), F.col("quality").alias("y"))
    return T.auc(x, "s", "y")


@query("m10_auc_monthly", f"WITH {_PANEL}, x AS (SELECT date_trunc('month', date)::DATE AS month, -past AS s, CAST(ret > 0 AS INTEGER) AS y FROM panel), k AS (SELECT month, y, rank() OVER (PARTITION BY month ORDER BY s) + (count(*) OVER (PARTITION BY month, s) - 1) / 2.0 AS r FROM x), g AS (SELECT month, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, sum(r) FILTER (WHERE y = 1)::DOUBLE AS sr FROM k GROUP BY 1) SELECT month, n_pos, n_neg, (sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS auc FROM g WHERE n_pos > 0 AND n_neg > 0 AND n_pos + n_neg >= 20", ["auc"])
def m10_monthly(spark, sf):
    x = _panel(spark, sf).select(F.trunc("date", "MM").alias("month"), (-F.col("past")).alias("s"), (F.col("ret") > 0).cast("int").alias("y"))
    return T.auc(x, "s", "y", ["month"], 20)


@query("m10_share_of_months", f"WITH {_PANEL}, x AS (SELECT date_trunc('month', date)::DATE AS month, -past AS s, CAST(ret > 0 AS INTEGER) AS y FROM panel), k AS (SELECT month, y, rank() OVER (PARTITION BY month ORDER BY s) + (count(*) OVER (PARTITION BY month, s) - 1) / 2.0 AS r FROM x), g AS (SELECT month, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, sum(r) FILTER (WHERE y = 1)::DOUBLE AS sr FROM k GROUP BY 1), monthly AS (SELECT month, n_pos, n_neg, (sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS auc FROM g WHERE n_pos > 0 AND n_neg > 0 AND n_pos + n_neg >= 20) SELECT count(*) AS n_months, avg(auc) AS auc_mean, stddev_samp(auc) AS auc_std, avg(CAST(auc > 0.55 AS INTEGER)) AS share_over FROM monthly", ["auc_mean", "auc_std", "share_over"])
def m10_share(spark, sf):
    return T.auc_summary(m10_monthly(spark, sf))


@query("a21_a22_confusion", f"WITH {_PANEL}, c AS (SELECT count(*) FILTER (WHERE ret > 0 AND signal = 1) AS tp, count(*) FILTER (WHERE ret <= 0 AND signal = 1) AS fp, count(*) FILTER (WHERE ret > 0 AND signal = 0) AS fn, count(*) FILTER (WHERE ret <= 0 AND signal = 0) AS tn FROM panel) SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, tn::DOUBLE / (tn + fn) AS precision_0, tn::DOUBLE / (tn + fp) AS recall_0, 2.0::DOUBLE * tn / (2 * tn + fp + fn) AS f1_0 FROM c", ["accuracy", "precision", "recall", "f1", "precision_0", "recall_0", "f1_0"])
def a21(spark, sf):
    return T.confusion(_panel(spark, sf).withColumn("y", (F.col("ret") > 0).cast("int")), "y", "signal")


@query("b4_o4_top_decile_backtest", f"WITH {_PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM panel)), x AS (SELECT p.*, quantile_cont(-past, 0.9) OVER (PARTITION BY date) AS cut, count(*) OVER (PARTITION BY date) AS n FROM panel p JOIN d USING (date) WHERE k % 5 = 0), q AS (SELECT date, avg(ret) - 0.002 AS ret, count(*) AS trades FROM x WHERE n >= 10 AND -past >= cut GROUP BY 1) SELECT sum(trades)::BIGINT AS trades, avg(ret) AS mean_ret, product(1 + ret) - 1 AS cumulative, avg(ret) * sqrt(252 / 5.0) / stddev_samp(ret) AS sharpe FROM q", ["mean_ret", "cumulative", "sharpe"])
def b4(spark, sf):
    return B.top_fraction_backtest(_panel(spark, sf).withColumn("s", -F.col("past")), "s", "ret", 5)


@query("b4_backtest_against_benchmark", f"WITH {_PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM panel)), x AS (SELECT p.*, quantile_cont(-past, 0.9) OVER (PARTITION BY date) AS cut, count(*) OVER (PARTITION BY date) AS n FROM panel p JOIN d USING (date) WHERE k % 5 = 0), q AS (SELECT date, avg(ret) FILTER (WHERE -past >= cut) - 0.002 AS top, avg(ret) AS bench, count(*) FILTER (WHERE -past >= cut) AS trades FROM x WHERE n >= 10 GROUP BY 1), l AS (SELECT 'top' AS strategy, date, top AS ret, trades FROM q UNION ALL SELECT 'benchmark', date, bench, 0 FROM q), w AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM l), p AS (SELECT *, max(wealth) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM w) SELECT strategy, count(*) AS n, product(1 + ret) - 1 AS cumulative, avg(ret) * sqrt(252 / 5.0) / stddev_samp(ret) AS sharpe, -min(wealth / peak - 1) + 0.0 AS max_drawdown, sum(trades)::BIGINT AS trades FROM p GROUP BY 1", ["cumulative", "sharpe", "max_drawdown"])
def b4_benchmark(spark, sf):
    return B.backtest_against_benchmark(_panel(spark, sf).withColumn("s", -F.col("past")), "s", "ret", 5)


@query("b5_a16_decile_spread", f"""WITH {_PANEL}, m AS (SELECT ticker, date_trunc('month', date)::DATE AS month, avg(past) AS x, avg(ret) AS ret FROM panel GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY x, ticker) AS r, count(*) OVER (PARTITION BY month) AS n FROM m),
 q AS (SELECT *, greatest(ceil((r - 1) * 5 / greatest(n - 1, 1)::DOUBLE)::INTEGER - 1, 0) AS d FROM k WHERE n >= 5) SELECT month, avg(ret) FILTER (WHERE d = 0) AS low, avg(ret) FILTER (WHERE d = 4) AS high, avg(ret) FILTER (WHERE d = 0) - avg(ret) FILTER (WHERE d = 4) AS long_short, (month + INTERVAL 1 MONTH)::DATE AS realised FROM q GROUP BY month""", ["low", "high", "long_short"])
def b5(spark, sf):
    m = _panel(spark, sf).groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.avg("past").alias("x"), F.avg("ret").alias("ret"))
    return B.decile_spread(P.deciles(m, "x", "month", "ticker", 5), "ret", 5).select("month", F.col("0").alias("low"), F.col("4").alias("high"), "long_short", "realised")


@query("m1_p21_targets", f"WITH {BARS}, x AS (SELECT ticker, date, close, lead(close, 3) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM bars) SELECT ticker, date, CAST(nx > close AS INTEGER) AS target FROM x WHERE nx IS NOT NULL")
def m1(spark, sf):
    return P.with_target(bars(spark, sf), 3).select("ticker", "date", "target")


@query("m2_temporal_split", f"WITH {_PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)) SELECT p.ticker, date, CASE WHEN k <= floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM panel p JOIN d USING (date)")
def m2(spark, sf):
    return B.temporal_split(_panel(spark, sf)).select("ticker", "date", "split")


@query("m3_class_weight", f"WITH {_PANEL}, y AS (SELECT CAST(ret > 0.005 AS INTEGER) AS t FROM panel) SELECT CASE WHEN abs(avg(t) - 0.5) * 2 > 0.05 THEN count(*) FILTER (WHERE t = 0)::DOUBLE / count(*) FILTER (WHERE t = 1) ELSE 1 END AS scale_pos_weight FROM y", ["scale_pos_weight"])
def m3(spark, sf):
    return B.class_weight(_panel(spark, sf).withColumn("target", (F.col("ret") > 0.005).cast("int")))


_ROUND = """WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity::DOUBLE AS quantity, CASE WHEN l_linenumber > 1 THEN l_linenumber::DOUBLE END AS line FROM lineitem),
 f AS (SELECT 0 AS feature, quantity AS v, 0.5 - y AS g FROM d UNION ALL SELECT 1, line, 0.5 - y FROM d), c AS (SELECT feature, v, sum(g)::DOUBLE AS g, count(*) * 0.25::DOUBLE AS h FROM f GROUP BY ALL),
 k AS (SELECT feature, v, sum(g) FILTER (WHERE v IS NOT NULL) OVER w AS g, sum(h) FILTER (WHERE v IS NOT NULL) OVER w AS h, sum(g) OVER p AS gt, sum(h) OVER p AS ht, coalesce(sum(g) FILTER (WHERE v IS NULL) OVER p, 0) AS gm, coalesce(sum(h) FILTER (WHERE v IS NULL) OVER p, 0) AS hm, max(v) OVER p AS top FROM c WINDOW w AS (PARTITION BY feature ORDER BY v NULLS FIRST ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature)),
 s AS (SELECT feature, v, side AS missing_left, top, g + CASE WHEN side THEN gm ELSE 0 END AS gl, h + CASE WHEN side THEN hm ELSE 0 END AS hl, gt, ht, hm FROM k, (VALUES (false), (true)) o(side) WHERE v IS NOT NULL AND (v < top OR (NOT side AND hm > 0))),
 z AS (SELECT *, 0.5 * (pow(greatest(abs(gl) - 0.1, 0), 2) / (hl + 1) + pow(greatest(abs(gt - gl) - 0.1, 0), 2) / (ht - hl + 1) - pow(greatest(abs(gt) - 0.1, 0), 2) / (ht + 1)) AS gain FROM s WHERE hl >= 5 AND ht - hl >= 5),
 b AS (SELECT * FROM z ORDER BY round(gain, 6) DESC, feature, missing_left, v LIMIT 1)
 SELECT CASE feature WHEN 0 THEN 'quantity' ELSE 'line' END AS feature, CASE WHEN v = top THEN NULL ELSE v END AS threshold, missing_left, gain, -sign(gl) * greatest(abs(gl) - 0.1, 0) / (hl + 1) * 0.05 AS left_leaf, -sign(gt - gl) * greatest(abs(gt - gl) - 0.1, 0) / (ht - hl + 1) * 0.05 AS right_leaf, hl AS left_cover, ht - hl AS right_cover FROM b"""


@query("m4_boosting_round", _ROUND, ["gain", "left_leaf", "right_leaf", "left_cover", "right_cover"])
def m4_round(spark, sf):
    """The first split of boosted trees over all lines, with missing values among them."""
    d = read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("target"), F.col("l_quantity").cast("double").alias("quantity"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("double")).alias("line"))
    model = L.train_trees(d, ["quantity", "line"], rounds=1, depth=1, rows=1.0, columns=1.0)
    root, left, right = model.trees[0]
    row = (model.features[root["feature"]], None if root["threshold"] == float("inf") else root["threshold"], root["missing_left"], root["gain"], left["leaf"], right["leaf"], left["cover"], right["cover"])
    return spark.createDataFrame([row], "feature string, threshold double, missing_left boolean, gain double, left_leaf double, right_leaf double, left_cover double, right_cover double")


@query("m4_m6_m7_walk_forward")
def m7(spark, sf):
    p = P.bar_features(_panel(spark, sf).drop("ret")).withColumn("target", (F.col("return_5d_forward") > 0).cast("int")).where("return_5d_forward is not null")
    return L.walk_forward(p, ["bb_width", "bb_pct", "volatility_20d", "volume_ratio", "past"], rounds=5, depth=3)


@query("m7_walk_forward_rates", f"WITH {_PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)), x AS (SELECT ticker, date, CAST(ret > 0 AS INTEGER) AS target, k <= floor(n * 0.5) AS early FROM panel JOIN d USING (date)), rates AS (SELECT ticker, avg(target) AS rate FROM x WHERE early GROUP BY 1) SELECT ticker, date, target, coalesce(rate, 0.5) AS proba, CAST(coalesce(rate, 0.5) >= 0.5 AS INTEGER) AS pred FROM x LEFT JOIN rates USING (ticker) WHERE NOT early", ["proba"])
def m7_rates(spark, sf):
    p = _panel(spark, sf).withColumn("target", (F.col("ret") > 0).cast("int"))
    return L.walk_forward(p, [], fit=L.group_rates("ticker"))


@query("m12_placebo_permutation", "WITH e AS (SELECT event_id, CAST(ts AS DATE) AS date, value FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY event_id) AS i, row_number() OVER (PARTITION BY date ORDER BY md5('42:' || event_id), event_id) AS j FROM e) SELECT x.event_id, x.date, y.value FROM a x JOIN a y ON x.date = y.date AND x.i = y.j", ["value"])
def m12(spark, sf):
    rows = read(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("date"), "value")
    return P.permute_within(rows, ["value"], "event_id", "date")


@query("m13_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 200")
def m13(spark, sf):
    return P.deterministic_sample(read(spark, sf, "orders"), "o_orderkey", 200).select("o_orderkey")
