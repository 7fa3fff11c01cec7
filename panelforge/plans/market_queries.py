"""Queries of panel joins, evaluation, folds, live roll-ups and text scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import columns as C
from panelforge.functions import series as S
from panelforge.functions import stats as T
from panelforge.functions import text as X
from panelforge.operators import evaluation as E
from panelforge.operators import folds as K
from panelforge.operators import panel as P
from panelforge.operators import portfolio as B
from panelforge.operators import rule_sentiment as R
from panelforge.operators import sentiment as M
from panelforge.operators import training as L
from panelforge.plans.fixtures import BARS, MESSAGES, ORDER_MENTIONS, PAIRED, bars, messages, order_mentions, read
from panelforge.plans.registry import query
from panelforge.plans.study_queries import _PANEL, _STRATS3, _panel, _strategies, _three_strategies
from panelforge.sources.synthetic import synthetic_posts
from panelforge.streaming import live

_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2.0"
_MARKET = "mk AS (SELECT date, avg(close) AS close FROM bars GROUP BY 1)"


def _market(spark, sf):
    """The mean close of all tickers, as an index."""
    return bars(spark, sf).groupBy("date").agg(F.avg("close").alias("close"))


@query("j2_monthly_panel", f"WITH {BARS}, {ORDER_MENTIONS}, a AS (SELECT ticker, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close FROM bars GROUP BY 1, 2), b AS (SELECT ticker, date_trunc('month', date)::DATE AS month, count(*) AS n FROM om GROUP BY 1, 2) SELECT ticker, month, close, n FROM a JOIN b USING (ticker, month)", ["close"])
def j2(spark, sf):
    n = M.mentions(order_mentions(spark, sf)).groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return P.join_monthly(P.month_ends(bars(spark, sf)).where("close is not null"), n)


@query("j4_outer_scores", f"WITH {BARS}, {ORDER_MENTIONS}, a AS (SELECT ticker, date, avg(prob_positive - prob_negative) AS net, count(*) AS msg_count FROM om GROUP BY 1, 2) SELECT ticker, date, close, net, msg_count FROM bars FULL JOIN a USING (ticker, date) WHERE close IS NOT NULL", ["close", "net"])
def j4(spark, sf):
    m = M.mentions(order_mentions(spark, sf))
    a = m.groupBy("ticker", "date").agg(F.avg(F.col("prob_positive") - F.col("prob_negative")).alias("net"), F.count(F.lit(1)).alias("msg_count"))
    return P.join_sources(bars(spark, sf), [a], ["ticker", "date"], "close").select("ticker", "date", "close", "net", "msg_count")


@query("j5_left_fold", f"WITH {BARS}, {ORDER_MENTIONS}, a AS (SELECT ticker, date, count(*) AS n_posts FROM om GROUP BY 1, 2), b AS (SELECT ticker, date, count(*) AS n_urgent, avg(score) AS score FROM om WHERE label = 'positive' GROUP BY 1, 2), c AS (SELECT ticker, date, sum(num_comments)::BIGINT AS comments FROM om WHERE label = 'negative' GROUP BY 1, 2) SELECT ticker, date, close, coalesce(n_posts, 0) AS n_posts, coalesce(n_urgent, 0) AS n_urgent, score, coalesce(comments, 0) AS comments FROM bars LEFT JOIN a USING (ticker, date) LEFT JOIN b USING (ticker, date) LEFT JOIN c USING (ticker, date)", ["close", "score"])
def j5(spark, sf):
    m = M.mentions(order_mentions(spark, sf))
    parts = [
        m.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n_posts")),
        m.where("label = 'positive'").groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n_urgent"), F.avg("score").alias("score")),
        m.where("label = 'negative'").groupBy("ticker", "date").agg(F.sum("num_comments").alias("comments")),
    ]
    return P.join_left(bars(spark, sf).drop("volume"), parts, ["ticker", "date"], ["n_posts", "n_urgent", "comments"])


@query("j7_p21_excess_targets", f"WITH {BARS}, {_MARKET}, x AS (SELECT ticker, date, close, lead(close, 5) OVER w AS fc, lead(date, 5) OVER w AS fd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, x.date, fd AS fwd_date, fc / x.close - b.close / a.close AS excess, CAST(fc / x.close - 1 > b.close / a.close - 1 AS INTEGER) AS target FROM x JOIN mk a ON x.date = a.date JOIN mk b ON x.fd = b.date WHERE fc IS NOT NULL", ["excess"])
def j7(spark, sf):
    return P.excess_targets(bars(spark, sf), _market(spark, sf), 5).select("ticker", "date", "fwd_date", "excess", "target")


@query("o5_top_decile_precision", f"WITH {_PANEL}, c AS (SELECT quantile_cont(-past, 0.9) AS cut FROM panel) SELECT (SELECT cut FROM c) AS cut, count(*) AS n_top, avg(CAST(ret > 0 AS INTEGER)) AS precision FROM panel, c WHERE -past >= cut", ["cut", "precision"])
def o5(spark, sf):
    return T.top_precision(_panel(spark, sf).withColumn("s", -F.col("past")).withColumn("y", (F.col("ret") > 0).cast("int")), "s", "y")


@query("a14_quantiles_at_scale", "SELECT quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem", ["p01", "p50", "p99"])
def a14_scale(spark, sf):
    return T.group_quantiles(read(spark, sf, "lineitem"), [], "l_extendedprice", [0.01, 0.5, 0.99]).select(F.col("q0").alias("p01"), F.col("q1").alias("p50"), F.col("q2").alias("p99"))


@query("o8_head_and_tail", f"WITH {BARS}, t AS (SELECT ticker, date, close FROM bars) SELECT * FROM (SELECT 'head' AS part, * FROM t ORDER BY date, ticker LIMIT 10) UNION ALL SELECT * FROM (SELECT 'tail' AS part, * FROM t ORDER BY date DESC, ticker DESC LIMIT 10)", ["close"])
def o8(spark, sf):
    b = bars(spark, sf).select("ticker", "date", "close")
    order = ["date", "ticker"]
    return P.head_rows(b, order, 10).select(F.lit("head").alias("part"), "*").unionByName(P.tail_rows(b, order, 10).select(F.lit("tail").alias("part"), "*"))


_FEATURES = ["past", "volume", "close"]
_RHO = " UNION ALL ".join(f"SELECT '{f}' AS feature, 'ret' AS against, count(*) AS n, corr(a, b) AS rho FROM (SELECT {_RANK.format(p=1, c=f)} AS a, {_RANK.format(p=1, c='ret')} AS b FROM panel)" for f in _FEATURES)


@query("o9_strongest_features", f"WITH {_PANEL}, rho AS ({_RHO}) SELECT * FROM rho ORDER BY abs(rho) DESC, feature LIMIT 2", ["rho"])
def o9(spark, sf):
    return T.strongest(T.spearman(_panel(spark, sf), [(f, "ret") for f in _FEATURES]), 2)


_RHO_YEAR = " UNION ALL ".join(f"SELECT y AS year, '{f}' AS feature, 'ret' AS against, count(*) AS n, corr(a, b) AS rho FROM (SELECT y, {_RANK.format(p='y', c=f)} AS a, {_RANK.format(p='y', c='ret')} AS b FROM (SELECT *, year(date)::INTEGER AS y FROM panel)) GROUP BY y HAVING count(*) >= 30" for f in _FEATURES)


def _by_year(spark, sf):
    return T.spearman(_panel(spark, sf).withColumn("year", F.year("date")), [(f, "ret") for f in _FEATURES], ["year"], 30)


@query("t6_spearman_by_year", f"WITH {_PANEL} {_RHO_YEAR}", ["rho"])
def t6_year(spark, sf):
    return _by_year(spark, sf)


@query("t6_sign_flips", f"WITH {_PANEL}, rho AS ({_RHO_YEAR}) SELECT feature, count(*) AS n_periods, count(*) FILTER (WHERE rho > 0) AS n_positive, max(rho) > 0 AND min(rho) < 0 AS flips FROM rho WHERE abs(rho) > 0.02 GROUP BY 1")
def t6_flips(spark, sf):
    return T.sign_flips(_by_year(spark, sf), "year")


@query("t6_spearman_by_liquidity", f"WITH {_PANEL}, c AS (SELECT quantile_cont(volume, [0.25, 0.5, 0.75]) AS q FROM panel), x AS (SELECT past, ret, CAST(volume > q[1] AS INTEGER) + CAST(volume > q[2] AS INTEGER) + CAST(volume > q[3] AS INTEGER) AS bin FROM panel, c) SELECT bin, 'past' AS feature, 'ret' AS against, count(*) AS n, corr(a, b) AS rho FROM (SELECT bin, {_RANK.format(p='bin', c='past')} AS a, {_RANK.format(p='bin', c='ret')} AS b FROM x) GROUP BY 1", ["rho"])
def t6_liquidity(spark, sf):
    return T.spearman(P.quantile_bins(_panel(spark, sf), "volume", [0.25, 0.5, 0.75]), [("past", "ret")], ["bin"])


_MONTHLY = f"{_PANEL}, s AS (SELECT date, coalesce(avg(ret) FILTER (WHERE signal = 1), 0) AS a, avg(ret) AS b FROM panel GROUP BY 1), m AS (SELECT date_trunc('month', date)::DATE AS month, avg(a) AS y, avg(b) AS x FROM s GROUP BY 1)"


@query("t9_alpha_hac", f"""WITH {_MONTHLY}, c AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM m),
 z AS (SELECT month, (y - b0 - b1 * x) * (sxx - sx * x) / (n * sxx - sx * sx) AS z FROM m, c), l AS (SELECT z, lag(z, 1, 0) OVER w AS z1, lag(z, 2, 0) OVER w AS z2, lag(z, 3, 0) OVER w AS z3 FROM z WINDOW w AS (ORDER BY month))
 SELECT max(b0) AS alpha, max(b0) / sqrt(sum(z * z) + 2 * sum(0.75::DOUBLE * z * z1 + 0.5::DOUBLE * z * z2 + 0.25::DOUBLE * z * z3)) AS t, max(n) AS n FROM l, c""", ["alpha", "t"])
def t9(spark, sf):
    wide = _strategies(spark, sf).groupBy("date").pivot("strategy", ["contrarian", "hold"]).agg(F.first("ret"))
    month = wide.groupBy(F.trunc("date", "MM").alias("month")).agg(F.avg("contrarian").alias("ret"), F.avg("hold").alias("mkt"))
    return T.alpha(month.select("month", "ret"), month.select("month", "mkt"), names=("mkt",))


_TIMES = 20
_GROUPS = "row_number() OVER (PARTITION BY {p} ORDER BY bullishness, ticker) AS r, count(*) OVER (PARTITION BY {p}) AS k, count(DISTINCT bullishness) OVER (PARTITION BY {p}) AS kinds"
_SPREAD = "avg(ret) FILTER (WHERE g = 0) - avg(ret) FILTER (WHERE g = 4) AS ret"
_GRP = "CASE WHEN kinds >= 5 THEN greatest(ceil((r - 1) * 5 / greatest(k - 1, 1)::DOUBLE)::INTEGER - 1, 0) END AS g"
_CONTRARIAN = f"""{_PANEL}, p AS (SELECT ticker, date_trunc('month', date)::DATE AS month, avg(past) AS bullishness, avg(ret) * 20 AS ret, min(close) / 900 AS price FROM panel GROUP BY 1, 2),
 f AS (SELECT month, avg(ret) AS mkt FROM p GROUP BY 1), kept AS (SELECT * FROM p WHERE price >= 1), q AS (SELECT month, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM kept GROUP BY 1),
 clean AS (SELECT ticker, month, bullishness, least(greatest(ret, lo), hi) AS ret FROM kept JOIN q USING (month)),
 g AS (SELECT *, {_GRP} FROM (SELECT *, {_GROUPS.format(p='month')} FROM clean)),
 sp AS (SELECT (month + INTERVAL 1 MONTH)::DATE AS month, {_SPREAD} FROM g WHERE g IS NOT NULL GROUP BY month)"""


def _monthly(spark, sf):
    return _panel(spark, sf).groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.avg("past").alias("bullishness"), (F.avg("ret") * 20).alias("ret"), (F.min("close") / 900).alias("price"), F.avg("volume").alias("size"), F.coalesce(F.stddev_samp("past"), F.lit(0.0)).alias("vol"))


@query("b6_contrarian_evaluation", f"""WITH {_CONTRARIAN}, spn AS (SELECT * FROM sp WHERE ret IS NOT NULL), xy AS (SELECT spn.month, spn.ret AS y, f.mkt AS x FROM spn JOIN f USING (month)),
 c AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM xy), z AS (SELECT month, (y - b0 - b1 * x) * (sxx - sx * x) / (n * sxx - sx * sx) AS z FROM xy, c),
 l AS (SELECT z, lag(z, 1, 0) OVER w AS z1, lag(z, 2, 0) OVER w AS z2, lag(z, 3, 0) OVER w AS z3 FROM z WINDOW w AS (ORDER BY month)),
 fit AS (SELECT max(b0) AS alpha, max(b0) / sqrt(sum(z * z) + 2 * sum(0.75::DOUBLE * z * z1 + 0.5::DOUBLE * z * z2 + 0.25::DOUBLE * z * z3)) AS alpha_t, max(n) AS n_obs FROM l, c),
 pl AS (SELECT clean.*, placebo, placebo || ':' || ticker AS key FROM clean, (SELECT unnest(range(1, {_TIMES + 1})) AS placebo)),
 pa AS (SELECT placebo, month, ticker, ret, row_number() OVER (PARTITION BY placebo, month ORDER BY key) AS i FROM pl), pb AS (SELECT placebo, month, bullishness, row_number() OVER (PARTITION BY placebo, month ORDER BY md5('42:' || key), key) AS i FROM pl),
 pg AS (SELECT *, {_GRP} FROM (SELECT *, {_GROUPS.format(p='placebo, month')} FROM pa JOIN pb USING (placebo, month, i))), ps AS (SELECT placebo, (month + INTERVAL 1 MONTH)::DATE AS month, {_SPREAD} FROM pg WHERE g IS NOT NULL GROUP BY placebo, pg.month),
 al AS (SELECT placebo, regr_intercept(ps.ret, f.mkt) AS a FROM ps JOIN f USING (month) WHERE ps.ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 12)
 SELECT (SELECT count(*) FROM p) AS n_raw, (SELECT count(*) FROM p WHERE price < 1) AS n_penny, (SELECT count(*) FROM kept WHERE abs(ret) > 2) AS n_extreme, (SELECT count(*) FROM kept) AS n_clean, 5::BIGINT AS n_groups, (SELECT count(*) FROM spn) AS n_months,
 (SELECT avg(ret) FROM spn) AS ls_mean, (SELECT avg(ret) / (stddev_samp(ret) / sqrt(count(*))) FROM spn) AS ls_t, max(alpha) AS alpha, max(alpha_t) AS alpha_t, max(n_obs) AS n_obs, avg(a) AS placebo_mean, count(a) AS n_placebo, avg(CAST(a >= alpha AS INTEGER)) AS p_value,
 max(alpha) > 0 AND max(alpha_t) > 2 AND avg(CAST(a >= alpha AS INTEGER)) < 0.05 AS success FROM al, fit""", ["ls_mean", "ls_t", "alpha", "alpha_t", "placebo_mean", "p_value"])
def b6(spark, sf):
    p = _monthly(spark, sf)
    return E.contrarian_evaluation(p.drop("size", "vol"), p.groupBy("month").agg(F.avg("ret").alias("mkt")), ("mkt",), _TIMES)


@query("b6_group_exposure", f"WITH {_CONTRARIAN}, e AS (SELECT ticker, date_trunc('month', date)::DATE AS month, avg(volume) AS size, coalesce(stddev_samp(past), 0) AS vol FROM panel GROUP BY 1, 2), gm AS (SELECT g AS grp, month, avg(ret) AS m FROM g WHERE g IS NOT NULL GROUP BY 1, 2), a AS (SELECT grp, avg(m) AS mean_ret, avg(m) / (stddev_samp(m) / sqrt(count(m))) AS t FROM gm GROUP BY 1), x AS (SELECT g AS grp, quantile_cont(size, 0.5) AS size_med, quantile_cont(vol, 0.5) AS vol_med, count(*) AS n FROM g JOIN e USING (ticker, month) WHERE g IS NOT NULL GROUP BY 1) SELECT * FROM a JOIN x USING (grp)", ["mean_ret", "t", "size_med", "vol_med"])
def b6_exposure(spark, sf):
    clean, _ = E.hygiene(_monthly(spark, sf))
    return E.group_returns(E.sentiment_groups(clean, 5))


@query("b3_objectives", f"""WITH {_PANEL}, {_STRATS3}, {PAIRED},
 w AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM long), p AS (SELECT *, max(wealth) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM w),
 k AS (SELECT strategy, avg(ret) * sqrt(252) / stddev_samp(ret) AS sharpe, -min(wealth / peak - 1) + 0.0 AS max_drawdown, avg(CAST(round(ret, 9) > 0 AS INTEGER)) AS accuracy FROM p GROUP BY 1)
 SELECT strategy, accuracy, sharpe, max_drawdown, least(p_value_ttest, p_value_wilcoxon) AS p_value, accuracy > 0.55 AS met_accuracy, sharpe > 1 AS met_sharpe, max_drawdown < 0.15 AS met_drawdown, coalesce(significant_005, false) AS met_p_value FROM k LEFT JOIN tested USING (strategy)""", ["accuracy", "sharpe", "max_drawdown", "p_value"])
def b3(spark, sf):
    runs = _three_strategies(spark, sf)
    # what cancels to zero counts as zero, whatever the order of addition
    right = runs.groupBy("strategy").agg(F.avg((F.round("ret", 9) > 0).cast("int")).alias("accuracy"))
    tested = T.paired_tests(runs, "hold").select("strategy", F.least("p_value_ttest", "p_value_wilcoxon").alias("p_value"))
    measured = B.metrics(runs).join(right, "strategy").join(tested, "strategy", "left")
    return B.objectives(measured).select("strategy", "accuracy", "sharpe", "max_drawdown", "p_value", "met_accuracy", "met_sharpe", "met_drawdown", "met_p_value")


@query("b9_survivorship", f"WITH {BARS}, u AS (SELECT n_name AS ticker FROM nation UNION ALL SELECT 'NO_PRICE'), x AS (SELECT ticker, max(date) AS d FROM bars GROUP BY 1), m AS (SELECT ticker, d FROM u LEFT JOIN x USING (ticker)) SELECT count(*) AS n_universe, count(*) FILTER (WHERE d IS NULL) AS n_no_price, count(*) FILTER (WHERE d < DATE '2001-12-01') AS n_delisted, count(*) FILTER (WHERE d >= DATE '2001-12-01') AS n_survivors, count(*) FILTER (WHERE d >= DATE '2001-12-01')::DOUBLE / nullif(count(d), 0) AS survivor_share FROM m", ["survivor_share"])
def b9(spark, sf):
    last = bars(spark, sf).groupBy("ticker").agg(F.max("date").alias("last_date"))
    universe = read(spark, sf, "nation").select(F.col("n_name").alias("ticker")).unionByName(spark.range(1).select(F.lit("NO_PRICE").alias("ticker")))
    return P.survivorship(universe, last, "2001-12-01")


_TESTS = [1998, 1999, 2000, 2001, 2002]
_FOLD_ROWS = ", ".join(f"(1990, {t - 2}, {t})" for t in _TESTS)


def _fold_sql(key: str) -> str:
    return f"""{_PANEL}, d AS (SELECT ticker, date, year(date) AS y, dayofweek(date) AS weekday, month(date) AS month, CAST(ret > 0 AS INTEGER) AS target FROM panel), folds(first, last, test) AS (VALUES {_FOLD_ROWS}),
 ok AS (SELECT test, last FROM folds JOIN d ON y BETWEEN first AND last GROUP BY 1, 2 HAVING count(*) >= 50 AND count(DISTINCT target) = 2 AND (SELECT count(*) FROM d AS e WHERE e.y = test) >= 20),
 rates AS (SELECT test, {key} AS key, avg(target) AS rate FROM ok JOIN d ON y BETWEEN 1990 AND last GROUP BY 1, 2),
 pr AS (SELECT test AS test_year, ticker, date, target, coalesce(rate, 0.5) AS proba FROM ok JOIN d ON y = test LEFT JOIN rates USING (test) WHERE rates.key = d.{key} OR rates.key IS NULL),
 k AS (SELECT *, {_RANK.format(p='test_year', c='proba')} AS r FROM pr),
 fm AS (SELECT test_year::INTEGER AS test_year, count(*) AS n_test, avg(CAST((proba >= 0.5) = (target = 1) AS INTEGER)) AS accuracy, coalesce(count(*) FILTER (WHERE target = 1 AND proba >= 0.5)::DOUBLE / nullif(count(*) FILTER (WHERE proba >= 0.5), 0), 0) AS precision, coalesce(count(*) FILTER (WHERE target = 1 AND proba >= 0.5)::DOUBLE / nullif(count(*) FILTER (WHERE target = 1), 0), 0) AS recall,
  (sum(r) FILTER (WHERE target = 1) - count(*) FILTER (WHERE target = 1) * (count(*) FILTER (WHERE target = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER (WHERE target = 1) * count(*) FILTER (WHERE target = 0)) AS auc FROM k GROUP BY 1)"""


def _labelled(spark, sf):
    return _panel(spark, sf).select("ticker", "date", (F.dayofweek("date") - 1).alias("weekday"), F.month("date").alias("month"), (F.col("ret") > 0).cast("int").alias("target"))


@query("m8_year_folds", f"WITH {_fold_sql('ticker')} SELECT * FROM fm", ["accuracy", "precision", "recall", "auc"])
def m8(spark, sf):
    return K.rate_folds(_labelled(spark, sf), ["ticker"], L.year_folds(1990, _TESTS)).drop("name")


def _newton_sql(steps: int = 8) -> str:
    """Newton's method for a constant and one feature, a common table expression a step."""
    q, g0, g1 = "(1 / (1 + exp(-(b0 + b1 * x))))", "sum(target - {q})", "sum(x * (target - {q}))"
    h = [f"sum({w} * {q} * (1 - {q}))" for w in ("1", "x", "x * x")]
    det = f"({h[0]} * {h[2]} - {h[1]} * {h[1]})"
    a, b = g0.format(q=q), g1.format(q=q)
    out = f"{_PANEL}, d AS MATERIALIZED (SELECT year(date) AS y, dayofweek(date) AS weekday, month(date) AS month, CAST(ret > 0 AS INTEGER) AS target FROM panel), e AS MATERIALIZED (SELECT 'weekday' AS name, weekday::DOUBLE AS x, y, target FROM d UNION ALL SELECT 'month', month::DOUBLE, y, target FROM d), folds(first, last, test) AS (VALUES {_FOLD_ROWS}), ok AS (SELECT test, last FROM folds JOIN d ON y BETWEEN first AND last GROUP BY 1, 2 HAVING count(*) >= 50 AND count(DISTINCT target) = 2 AND (SELECT count(*) FROM d AS t WHERE t.y = test) >= 20), s0 AS (SELECT name, test, last, 0::DOUBLE AS b0, 0::DOUBLE AS b1 FROM ok, (VALUES ('weekday'), ('month')) v(name))"
    for k in range(steps):
        out += f", s{k + 1} AS MATERIALIZED (SELECT name, test, last, b0 + ({a} * {h[2]} - {b} * {h[1]}) / {det} AS b0, b1 + ({b} * {h[0]} - {a} * {h[1]}) / {det} AS b1 FROM s{k} JOIN e USING (name) WHERE y BETWEEN 1990 AND last GROUP BY name, test, last, s{k}.b0, s{k}.b1)"
    return out + f", pr AS (SELECT name, test AS test_year, target, {q} AS proba FROM s{steps} JOIN e USING (name) WHERE y = test), k AS (SELECT *, {_RANK.format(p='name, test_year', c='proba')} AS r FROM pr)"


@query("m8_logistic_folds", f"WITH {_newton_sql()} SELECT name, test_year, count(*) AS n_test, avg(CAST((proba >= 0.5) = (target = 1) AS INTEGER)) AS accuracy, (sum(r) FILTER (WHERE target = 1) - count(*) FILTER (WHERE target = 1) * (count(*) FILTER (WHERE target = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER (WHERE target = 1) * count(*) FILTER (WHERE target = 0)) AS auc, avg(-ln(CASE WHEN target = 1 THEN proba ELSE 1 - proba END)) AS log_loss FROM k GROUP BY 1, 2", ["accuracy", "auc", "log_loss"])
def m8_logistic(spark, sf):
    panel = _labelled(spark, sf)
    models = K.fit_logistic_folds(panel, {"weekday": ["weekday"], "month": ["month"]}, L.year_folds(1990, _TESTS))
    scored = K.predict_logistic_folds(panel, models, ["target"])
    return K.prediction_metrics(scored).join(K.log_loss(scored), ["name", "test_year"]).drop("precision", "recall")


_SUMMARY = "count(*) AS n_folds, avg(auc) AS auc_mean, avg(accuracy) AS acc_mean, avg(precision) AS prec_mean, avg(recall) AS rec_mean, count(*) FILTER (WHERE auc > 0.53) AS folds_over, count(auc) AS n_aucs"
_MATRIX = " UNION ALL ".join(f"SELECT * FROM (WITH {_fold_sql(key)} SELECT '{key}' AS name, {_SUMMARY} FROM fm)" for key in ("ticker", "weekday", "month"))
_MEANS = ["auc_mean", "acc_mean", "prec_mean", "rec_mean"]


def _matrix(spark, sf):
    return K.summarise_by(K.rate_folds(_labelled(spark, sf), ["ticker", "weekday", "month"], L.year_folds(1990, _TESTS)))


@query("m9_model_matrix", _MATRIX, _MEANS)
def m9(spark, sf):
    return _matrix(spark, sf)


@query("o10_best_model", f"SELECT * FROM ({_MATRIX}) ORDER BY auc_mean DESC, name LIMIT 1", _MEANS)
def o10_best(spark, sf):
    return B.best_model(_matrix(spark, sf))


@query("m11_verdicts", "SELECT n_name AS name, n_nationkey / 25.0::DOUBLE AS precision, (n_nationkey % 7) / 5.0::DOUBLE AS sharpe, n_nationkey * 11 AS trades, n_nationkey % 9 = 0 AS placebo, n_nationkey / 25.0 >= 0.55 AND (n_nationkey % 7) / 5.0 > 0.5 AND n_nationkey * 11 >= 100 AND n_nationkey % 9 <> 0 AS success FROM nation", ["precision", "sharpe"])
def m11(spark, sf):
    k = F.col("n_nationkey")
    return B.verdicts(read(spark, sf, "nation").select(F.col("n_name").alias("name"), (k / 25).alias("precision"), ((k % 7) / 5).alias("sharpe"), (k * 11).alias("trades"), (k % 9 == 0).alias("placebo")))


@query("m12_placebo_global", "WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS a, row_number() OVER (ORDER BY md5('43:' || event_id), event_id) AS b FROM events) SELECT x.event_id, y.value FROM e x JOIN e y ON x.a = y.b", ["value"])
def m12_global(spark, sf):
    return P.permute_all(read(spark, sf, "events").select("event_id", "value"), ["value"], "event_id")


@query("a12_counts_by_period", f"WITH {BARS} SELECT 'year' AS period, year(date)::VARCHAR AS name, count(*) AS n FROM bars GROUP BY ALL UNION ALL SELECT 'quarter', year(date) || 'Q' || quarter(date), count(*) FROM bars GROUP BY ALL UNION ALL SELECT 'month', strftime(date, '%Y-%m'), count(*) FROM bars GROUP BY ALL UNION ALL SELECT 'ticker', ticker, count(*) FROM bars GROUP BY ALL")
def a12_periods(spark, sf):
    return P.rows_by_period(bars(spark, sf))


@query("h5_cap_resumed", f"WITH {MESSAGES}, w AS (SELECT ticker, date, post_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY post_id) AS k FROM msgs WHERE post_id % 2 = 0) WHERE k <= 3), had AS (SELECT ticker, date, count(*) AS c FROM w GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY post_id) AS k FROM (SELECT ticker, date, post_id FROM msgs ANTI JOIN w USING (ticker, date, post_id))) SELECT f.ticker, f.date, post_id FROM f LEFT JOIN had USING (ticker, date) WHERE k + coalesce(c, 0) <= 5")
def h5(spark, sf):
    m = messages(spark, sf).select("ticker", "date", "post_id")
    written = M.cap_per_group(m.where("post_id % 2 = 0"), ["ticker", "date"], ["post_id"], 3)
    return M.cap_resumed(m, written, ["ticker", "date"], ["post_id"], 5)


def _logs(spark, sf):
    k = F.col("o_orderkey")
    order = F.struct(F.col("o_clerk").alias("ticker") if "o_clerk" in read(spark, sf, "orders").columns else F.lit("X").alias("ticker"), F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("CLOSE").alias("action"), F.when(k % 7 == 0, "skipped").otherwise("submitted").alias("status"), F.col("o_totalprice").alias("notional"))
    errors = F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>"))
    docs = read(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("run_id"), (F.col("o_custkey") % 3 != 0).alias("market_open"), F.collect_list(order).alias("orders"), errors.alias("errors"))).alias("doc"))
    return docs.select(F.from_json("doc", live.RUN_LOG).alias("d")).select("d.*")


@query("h9_day_rollup", "WITH o AS (SELECT *, o_orderstatus = 'F' AS buy, o_orderkey % 7 <> 0 AS sent FROM orders) SELECT count(DISTINCT o_custkey) AS n_runs, count(DISTINCT o_custkey) FILTER (WHERE o_custkey % 3 <> 0) AS n_open, count(*) AS n_orders, count(*) FILTER (WHERE buy AND sent) AS n_buys, count(*) FILTER (WHERE NOT buy AND sent) AS n_closes, round(sum(o_totalprice) FILTER (WHERE buy AND sent), 2) AS notional, count(DISTINCT o_custkey) FILTER (WHERE o_custkey % 5 = 0) AS n_errors FROM o")
def h9(spark, sf):
    return live.day_summary(_logs(spark, sf)).withColumn("notional", F.round("notional", 2))


@query("h9_day_orders", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'CLOSE' END AS action, CASE WHEN o_orderkey % 7 = 0 THEN 'skipped' ELSE 'submitted' END AS status, count(*) AS n, round(sum(o_totalprice), 2) AS notional FROM orders GROUP BY 1, 2")
def h9_orders(spark, sf):
    return live.day_orders(_logs(spark, sf)).withColumn("notional", F.round("notional", 2))


def _u(name: str) -> str:
    return f"(('0x' || substr(md5('42:{name}:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("s25_synthetic_posts", f"""WITH r AS (SELECT unnest(range(0, 2000)) AS id), x AS (SELECT id AS post_id, DATE '2024-01-01' + floor({_u('day')} * 30)::INTEGER AS date, ['AAPL', 'TSLA', 'MSFT', 'NVDA', 'AMD', 'GOOG', 'AMZN', 'META'][floor({_u('ticker')} * 8)::INTEGER + 1] AS ticker, CASE WHEN {_u('label')} < 0.45 THEN 'positive' WHEN {_u('label')} < 0.75 THEN 'negative' ELSE 'neutral' END AS label, floor({_u('score')} * 200)::BIGINT AS score FROM r)
 SELECT *, CASE label WHEN 'positive' THEN 'strong beat, bullish on' WHEN 'negative' THEN 'weak quarter, bearish on' ELSE 'watching' END || ' $' || ticker AS text FROM x""")
def s25(spark, sf):
    return synthetic_posts(spark)


@query("p10_unlabelled", f"WITH {MESSAGES}, x AS (SELECT post_id, CASE post_id % 4 WHEN 0 THEN '1.0' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE ' -1 ' END AS raw FROM msgs) SELECT post_id FROM x WHERE try_cast(trim(raw) AS DOUBLE) IS NULL")
def p10(spark, sf):
    k = F.col("post_id")
    raw = F.when(k % 4 == 0, "1.0").when(k % 4 == 1, "n/a").when(k % 4 == 2, F.lit(None)).otherwise(" -1 ")
    return messages(spark, sf).select("post_id", raw.alias("raw")).where(C.without_number(F.col("raw"))).select("post_id")


@query("p22_prefilter", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9])(of|the)($|[^A-Za-z0-9])')")
def p22(spark, sf):
    return read(spark, sf, "documents").where(X.mentions_any(F.col("text"), ["the", "of"])).select("doc_id")


@query("f21_formats", "WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice * 100000 WHEN 1 THEN floor(o_totalprice) * 1000 ELSE o_orderkey END::DOUBLE AS v FROM orders) SELECT o_orderkey, '$' || CASE WHEN v >= 1e9 THEN printf('%.1f', round(v / 1e9, 1)) || 'B' WHEN v >= 1e6 THEN printf('%.1f', round(v / 1e6, 1)) || 'M' WHEN v >= 1e3 THEN printf('%.0f', round(v / 1e3)) || 'K' ELSE printf('%.0f', round(v)) END AS money FROM v")
def f21(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    value = F.when(k % 3 == 0, t * 100_000).when(k % 3 == 1, F.floor(t) * 1000.0).otherwise(k)
    return read(spark, sf, "orders").select("o_orderkey", C.human_money(value.cast("double")).alias("money"))


@query("f25_clock", f"WITH {MESSAGES} SELECT post_id, CASE WHEN post_id % 3 = 0 THEN '-' ELSE strftime(ts, '%H:%M') END AS at, CASE WHEN post_id % 4 = 0 THEN 0 ELSE value / (post_id % 4) - 1 END::DOUBLE AS change FROM msgs", ["change"])
def f25(spark, sf):
    k = F.col("post_id")
    iso = F.when(k % 3 != 0, C.iso_utc(F.col("ts").cast("timestamp")))
    return messages(spark, sf).select("post_id", C.clock_text(iso).alias("at"), C.day_change(F.col("value"), k % 4).alias("change"))


_HEAD = "the was not very the, so of! slightly and?? never of! hardly "
_WEIGHTS = {"the": 1.0, "of": -0.5, "and": 0.25}
_BOOSTS = " + ".join(f"CASE WHEN b{d} IN ({', '.join(repr(w) for w in X.STRONGER)}) THEN {0.293 * near!r} WHEN b{d} IN ({', '.join(repr(w) for w in X.WEAKER)}) THEN -{0.293 * near!r} ELSE 0 END" for d, near in ((1, 1.0), (2, 0.95), (3, 0.9)))
_NOT = " OR ".join(f"coalesce(b{d} IN ({', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in X.NEGATIONS)}), false)" for d in (1, 2, 3))


@query("x3_compound_scores", f"""WITH d AS (SELECT doc_id, '{_HEAD}' || coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(t), '[^a-z'']+'), lambda x: x <> '') AS w FROM d), u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
 b AS (SELECT doc_id, CASE w WHEN 'the' THEN 1.0 WHEN 'of' THEN -0.5 WHEN 'and' THEN 0.25 ELSE 0 END::DOUBLE AS base, lag(w, 1) OVER o AS b1, lag(w, 2) OVER o AS b2, lag(w, 3) OVER o AS b3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 s AS (SELECT doc_id, sum((base + sign(base) * ({_BOOSTS})) * CASE WHEN {_NOT} THEN -0.74::DOUBLE ELSE 1 END) AS x FROM b WHERE base <> 0 GROUP BY 1),
 m AS (SELECT d.doc_id, coalesce(x, 0) AS x, least(length(t) - length(replace(t, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN length(t) - length(replace(t, '?', '')) >= 4 THEN 0.96 WHEN length(t) - length(replace(t, '?', '')) >= 2 THEN (length(t) - length(replace(t, '?', ''))) * 0.18::DOUBLE ELSE 0 END AS loud FROM d LEFT JOIN s USING (doc_id)), y AS (SELECT doc_id, x + sign(x) * loud AS x FROM m)
 SELECT doc_id, x / sqrt(x * x + 15) AS compound FROM y""", ["compound"])
def x3_compound(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit(_HEAD), F.coalesce("text", F.lit(""))).alias("text"))
    return X.compound_scores(d, "text", _WEIGHTS).select("doc_id", "compound")


_RULE_HEAD = "not THE very the, so of! but slightly and?? never of! hardly THE "
_TERMS = "SELECT {key} AS doc_id, w[i:i + k - 1] AS words, i - 1 AS i, k AS size FROM {src}, (SELECT unnest([1, 2, 3]) AS k), unnest(range(1, len(w) + 1)) r(i) WHERE i + k - 1 <= len(w)"
_IN = lambda c, names: f"coalesce({c} IN ({', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in names)}), false)"
_NEAR = " + ".join(f"CASE WHEN {_IN(f'lower(w[i + 1 - {d}])', X.STRONGER)} AND i >= {d} THEN {0.293 * near!r}::DOUBLE WHEN {_IN(f'lower(w[i + 1 - {d}])', X.WEAKER)} AND i >= {d} THEN -{0.293 * near!r}::DOUBLE ELSE 0 END" for d, near in ((1, 1.0), (2, 0.95), (3, 0.9)))
_TURNED = " OR ".join(f"(i >= {d} AND {_IN(f'lower(w[i + 1 - {d}])', X.NEGATIONS)})" for d in (1, 2, 3))


def _learnt_lexicon(spark, sf):
    """Terms of one to three words that five or more labelled texts hold, by the share of good ones among them."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("text", "quality")
    counts = R.term_counts(d, "text", "quality").where("n >= 5")
    return counts.select("hash", F.round(4.0 * F.col("marks") / F.col("n") - 3.0, 4).alias("weight"))


@query("x3_rule_sentiment", f"""WITH d AS (SELECT doc_id, '{_RULE_HEAD}' || coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[^A-Za-z'']+'), lambda x: x <> '') AS w FROM d),
 g AS (SELECT doc_id, quality, list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z'']+'), lambda x: x <> '') AS w FROM documents JOIN labels USING (doc_id)), gt AS (SELECT DISTINCT doc_id, lower(array_to_string(words, ' ')) AS term FROM ({_TERMS.format(key='doc_id', src='g')})),
 lex AS (SELECT term, round(4.0::DOUBLE * sum(quality) / count(*) - 3.0::DOUBLE, 4) AS weight FROM gt JOIN (SELECT doc_id, quality FROM g) USING (doc_id) GROUP BY 1 HAVING count(*) >= 5),
 m AS (SELECT doc_id, i, size, weight, array_to_string(words, ' ') AS written FROM ({_TERMS.format(key='doc_id', src='w')}) JOIN lex ON lex.term = lower(array_to_string(words, ' ')) WHERE weight <> 0),
 kept AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.i < m.i + m.size AND m.i < o.i + o.size AND (o.size > m.size OR (o.size = m.size AND o.i < m.i)))),
 u AS (SELECT doc_id, w, nullif(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) - 1 AS but, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) BETWEEN 1 AND len(w) - 1 AS mixed FROM w),
 v AS (SELECT doc_id, (weight + sign(weight) * ({_NEAR} + CASE WHEN mixed AND upper(written) = written THEN 0.733::DOUBLE ELSE 0 END)) * CASE WHEN {_TURNED} THEN -0.74::DOUBLE ELSE 1 END * CASE WHEN i < but THEN 0.5::DOUBLE WHEN i > but THEN 1.5::DOUBLE ELSE 1 END AS x FROM kept JOIN u USING (doc_id)), s AS (SELECT doc_id, sum(x) AS x FROM v GROUP BY 1),
 p AS (SELECT d.doc_id, coalesce(x, 0) AS x, least(length(t) - length(replace(t, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN length(t) - length(replace(t, '?', '')) >= 4 THEN 0.96 WHEN length(t) - length(replace(t, '?', '')) >= 2 THEN (length(t) - length(replace(t, '?', ''))) * 0.18::DOUBLE ELSE 0 END AS loud FROM d LEFT JOIN s USING (doc_id)), y AS (SELECT doc_id, x + sign(x) * loud AS x FROM p)
 SELECT doc_id, x / sqrt(x * x + 15) AS compound FROM y""", ["compound"])
def x3_rules(spark, sf):
    """Every whole text behind a head that meets each rule, by a lexicon that grows with the labelled texts."""
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit(_RULE_HEAD), F.coalesce("text", F.lit(""))).alias("text"))
    return R.rule_sentiment(d, "doc_id", "text", _learnt_lexicon(spark, sf))
