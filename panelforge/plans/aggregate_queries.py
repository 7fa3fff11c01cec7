"""Queries of joins, aggregates, filters, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import columns as C
from panelforge.functions import stats as T
from panelforge.operators import panel as P
from panelforge.operators import portfolio as B
from panelforge.operators import sentiment as S
from panelforge.plans.fixtures import BARS, DAILY, DAILY_DOUBLES, MESSAGES, ORDER_MENTIONS, bar_dates, bars, messages, order_mentions, read
from panelforge.plans.registry import query

_CAL = "cal AS (SELECT DISTINCT date FROM bars), rolled AS (SELECT om.* REPLACE ((SELECT min(cal.date) FROM cal WHERE cal.date >= om.date) AS date) FROM om)"
_CAL2 = "cal AS (SELECT DISTINCT date FROM bars), days AS (SELECT DISTINCT date AS d FROM om), map AS (SELECT d, c.date AS t FROM days ASOF LEFT JOIN cal c ON days.d <= c.date), rolled AS (SELECT om.* REPLACE (map.t AS date) FROM om JOIN map ON om.date = map.d WHERE map.t IS NOT NULL)"


@query("entry_daily_panel", f"""WITH {BARS}, {ORDER_MENTIONS}, {_CAL2}, agg AS (SELECT ticker, date, {DAILY} FROM rolled GROUP BY 1, 2 HAVING count(post_id) >= 1),
 ind AS (SELECT *, count(close) OVER w AS n20, avg(close) OVER w AS mid, stddev_pop(close) OVER w AS sd, lead(close) OVER (PARTITION BY ticker ORDER BY date) AS next_close FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))
 SELECT agg.*, close, CASE WHEN n20 >= 20 THEN mid + 2 * sd END AS bb_upper, CASE WHEN n20 >= 20 THEN mid END AS bb_middle, CASE WHEN n20 >= 20 THEN mid - 2 * sd END AS bb_lower, next_close, CAST(next_close > close AS INTEGER) AS target FROM agg JOIN ind USING (ticker, date) WHERE next_close IS NOT NULL""",
    [*DAILY_DOUBLES, "close", "bb_upper", "bb_middle", "bb_lower", "next_close"])
def entry_daily_panel(spark, sf):
    price = bars(spark, sf)
    days = bar_dates(spark, sf)
    dates = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    scored = S.on_trading_days(S.mentions(order_mentions(spark, sf)), days, dates=dates).drop("date").withColumnRenamed("trading_date", "date")
    ind = P.with_target(P.bar_features(price)).select("ticker", "date", "close", "bb_upper", "bb_middle", "bb_lower", "next_close", "target")
    return S.daily_sentiment(scored, 1).join(ind, ["ticker", "date"])


@query("a1_daily_sentiment", f"WITH {MESSAGES} SELECT ticker, date, {DAILY}, avg(CASE native_label WHEN 'Bullish' THEN 1.0 WHEN 'Bearish' THEN -1.0 ELSE 0.0 END) AS native_sentiment FROM msgs GROUP BY 1, 2 HAVING count(post_id) >= 5", [*DAILY_DOUBLES, "native_sentiment"])
def a1(spark, sf):
    return S.daily_sentiment(messages(spark, sf), 5)


@query("a2_bull_bear_daily", f"WITH {MESSAGES} SELECT ticker, date, count(*) FILTER (WHERE sentiment > 0) AS bullish_count, count(*) FILTER (WHERE sentiment < 0) AS bearish_count, count(sentiment) AS total_count, count(DISTINCT user_id) AS unique_users, count(*) FILTER (WHERE sentiment > 0) / greatest(count(*) FILTER (WHERE sentiment <> 0), 1)::DOUBLE AS bullish_ratio FROM msgs GROUP BY 1, 2", ["bullish_ratio"])
def a2(spark, sf):
    return S.bull_bear(messages(spark, sf), ["ticker", "date"])


@query("a3_bull_bear_monthly", f"WITH {MESSAGES} SELECT ticker, strftime(date, '%Y-%m') AS month, count(*) FILTER (WHERE sentiment > 0) AS bullish_count, count(*) FILTER (WHERE sentiment < 0) AS bearish_count, count(*) AS total_count, count(DISTINCT user_id) AS unique_users, count(*) FILTER (WHERE sentiment > 0) / greatest(count(*) FILTER (WHERE sentiment <> 0), 1)::DOUBLE AS bullish_ratio FROM msgs GROUP BY 1, 2", ["bullish_ratio"])
def a3(spark, sf):
    return S.bull_bear(messages(spark, sf).withColumn("month", C.month_of(F.col("date"))), ["ticker", "month"], count_nulls=True)


@query("a4_forum_daily", f"WITH {MESSAGES} SELECT ticker, date, count(*) AS mention_count, avg(score::DOUBLE) AS avg_score, sum(num_comments)::BIGINT AS total_comments FROM msgs GROUP BY 1, 2", ["avg_score"])
def a4(spark, sf):
    return S.forum_daily(messages(spark, sf).withColumn("score", C.number(F.col("score"))), ["ticker", "date"])


@query("a5_news_daily", f"WITH {MESSAGES} SELECT ticker, date, count(sentiment) AS news_count, avg(sentiment) AS news_sentiment_mean FROM msgs GROUP BY 1, 2", ["news_sentiment_mean"])
def a5(spark, sf):
    return S.news_daily(messages(spark, sf), ["ticker", "date"])


@query("a6_model_daily_after_dedup", f"WITH {MESSAGES}, once AS (SELECT *, row_number() OVER (PARTITION BY post_id // 2 ORDER BY post_id) AS r FROM msgs) SELECT ticker, date, sum(CAST(prob_positive - prob_negative AS DECIMAL(18,9)))::DOUBLE / count(*) AS net_sentiment_mean, sum(CAST(prob_negative AS DECIMAL(18,9)))::DOUBLE / count(*) AS prob_neg_mean, count(*) AS msg_count FROM once WHERE r = 1 GROUP BY 1, 2")  # exact sums: nothing to round
def a6(spark, sf):
    return S.model_daily(messages(spark, sf).withColumn("message_id", F.floor(F.col("post_id") / 2)), ["ticker", "date"], ["post_id"])


@query("a7_mention_statistics", f"WITH {MESSAGES}, d AS (SELECT ticker, date, count(*) AS n FROM msgs GROUP BY 1, 2) SELECT ticker, count(*) FILTER (WHERE n >= 60) AS days_ge, count(*) AS total_days, min(date) AS date_min, max(date) AS date_max, avg(n) AS avg_mentions, sum(n)::BIGINT AS total_mentions FROM d GROUP BY 1", ["avg_mentions"])
def a7(spark, sf):
    return S.mention_statistics(messages(spark, sf), 60)


@query("a8_distinct_users", f"WITH {MESSAGES} SELECT ticker, date, count(DISTINCT user_id) AS users, count(*) AS n FROM msgs GROUP BY 1, 2")
def a8(spark, sf):
    return messages(spark, sf).groupBy("ticker", "date").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


@query("a11_global_scalars", f"WITH {MESSAGES} SELECT count(DISTINCT ticker) AS tickers, min(date) AS date_min, max(date) AS date_max, avg(CAST(sentiment IS NULL AS INTEGER)) AS null_sentiment, avg(CAST(native_label IS NULL AS INTEGER)) AS null_native FROM msgs", ["null_sentiment", "null_native"])
def a11(spark, sf):
    null = lambda c: F.avg(F.col(c).isNull().cast("int"))
    return messages(spark, sf).agg(F.count_distinct("ticker").alias("tickers"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), null("sentiment").alias("null_sentiment"), null("native_label").alias("null_native"))


@query("a12_volume_bins", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) FILTER (WHERE n < 10) AS low, count(*) FILTER (WHERE n BETWEEN 10 AND 12) AS mid, count(*) FILTER (WHERE n > 12) AS high, quantile_cont(n, 0.5)::DOUBLE AS median, (SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC LIMIT 20))::DOUBLE / sum(n)::DOUBLE AS top_share FROM c", ["median", "top_share"])
def a12(spark, sf):
    c = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.col("n").desc()).limit(20).agg(F.sum("n")).first()[0]
    n = F.col("n")
    return c.agg(F.count_if(n < 10).alias("low"), F.count_if(n.between(10, 12)).alias("mid"), F.count_if(n > 12).alias("high"), F.percentile("n", F.lit(0.5)).alias("median"), (F.lit(top) / F.sum("n")).alias("top_share"))


@query("a13_value_counts_top", f"WITH {MESSAGES} SELECT user_id, count(*) AS n FROM msgs GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def a13(spark, sf):
    return messages(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "user_id").limit(10)


@query("a14_exact_quantiles", "SELECT quantile_cont(o_totalprice, 0.1) AS p10, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.9) AS p90, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders", ["p10", "p50", "p90", "lo", "hi"])
def a14(spark, sf):
    found = T.group_quantiles(read(spark, sf, "orders"), [], "o_totalprice", [0.1, 0.5, 0.9, 0.0, 1.0])
    return found.select(*[F.col(f"q{i}").alias(n) for i, n in enumerate(("p10", "p50", "p90", "lo", "hi"))])


@query("a15_group_medians", f"WITH {BARS} SELECT ticker, quantile_cont(close * volume, 0.5) AS median_dollar_vol, count(*) AS n FROM bars GROUP BY 1", ["median_dollar_vol"])
def a15(spark, sf):
    found = T.group_quantiles(bars(spark, sf).withColumn("dollars", F.col("close") * F.col("volume")), ["ticker"], "dollars", [0.5])
    return found.select("ticker", F.col("q0").alias("median_dollar_vol"), F.col("n_rows").alias("n"))


@query("a17_modal_split", f"WITH {MESSAGES}, c AS (SELECT date, label, count(*) AS n FROM msgs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, label) AS k FROM c) SELECT date, label AS modal_label FROM r WHERE k = 1")
def a17(spark, sf):
    return messages(spark, sf).groupBy("date").agg(F.mode("label", True).alias("modal_label"))


@query("a18_order_summary", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_n, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE AS urgent_notional FROM orders GROUP BY 1", ["urgent_notional"])
def a18(spark, sf):
    s = F.col("o_orderstatus")
    return read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count_if(s == "F").alias("filled"), F.count_if(s == "O").alias("open_n"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice").cast("decimal(18,2)")).otherwise(0)).cast("double").alias("urgent_notional"))


@query("a19_day_summary", f"WITH {MESSAGES} SELECT date, count(*) AS n, count(DISTINCT ticker) AS tickers, round(avg(prob_positive), 4) AS pos, round(avg(prob_negative), 4) AS neg FROM msgs GROUP BY 1", ["pos", "neg"])
def a19(spark, sf):
    return messages(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.round(F.avg("prob_positive"), 4).alias("pos"), F.round(F.avg("prob_negative"), 4).alias("neg"))


@query("a20_b9_price_status", f"WITH {BARS}, u AS (SELECT n_name AS ticker FROM nation), x AS (SELECT ticker, max(date) AS last_date FROM bars GROUP BY 1) SELECT ticker, last_date, last_date IS NOT NULL AS has_price, coalesce(last_date < DATE '2001-10-01', false) AS delisted FROM u LEFT JOIN x USING (ticker)")
def a20(spark, sf):
    last = bars(spark, sf).groupBy("ticker").agg(F.max("date").alias("last_date"))
    return read(spark, sf, "nation").select(F.col("n_name").alias("ticker")).join(last, "ticker", "left").select("ticker", "last_date", F.col("last_date").isNotNull().alias("has_price"), F.coalesce(F.col("last_date") < F.lit("2001-10-01").cast("date"), F.lit(False)).alias("delisted"))


@query("a23_tickers_per_message", f"WITH {ORDER_MENTIONS} SELECT n_tickers, count(*) AS n FROM (SELECT post_id, count(*) AS n_tickers FROM om GROUP BY 1) GROUP BY 1")
def a23(spark, sf):
    return order_mentions(spark, sf).select(F.size("tickers").cast("long").alias("n_tickers")).groupBy("n_tickers").agg(F.count(F.lit(1)).alias("n"))


@query("a25_label_shares", f"WITH {MESSAGES} SELECT count(*) AS total, count(native_label) AS labelled, count(*) FILTER (WHERE native_label = 'Bullish') AS bullish, round(100.0 * count(native_label) / count(*), 2)::DOUBLE AS labelled_pct FROM msgs", ["labelled_pct"])
def a25(spark, sf):
    n = F.col("native_label")
    return messages(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count(n).alias("labelled"), F.count_if(n == "Bullish").alias("bullish"), F.round(100.0 * F.count(n) / F.count(F.lit(1)), 2).alias("labelled_pct"))


@query("g1_explode_mentions", f"WITH {ORDER_MENTIONS} SELECT ticker, count(*) AS n, count(DISTINCT post_id) AS posts FROM om GROUP BY 1")
def g1(spark, sf):
    return S.mentions(order_mentions(spark, sf)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("post_id").alias("posts"))


@query("g3_u6_ticker_union", f"WITH {ORDER_MENTIONS} SELECT list_sort(list(DISTINCT ticker)) AS tickers FROM om")
def g3(spark, sf):
    return S.mentions(order_mentions(spark, sf)).agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))


@query("g5_month_gaps", f"WITH {BARS}, h AS (SELECT DISTINCT ticker, date_trunc('month', date)::DATE AS month FROM bars WHERE month(date) <> 3), s AS (SELECT ticker, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM h GROUP BY ticker) SELECT * FROM s ANTI JOIN h USING (ticker, month)")
def g5(spark, sf):
    return P.month_gaps(bars(spark, sf).where(F.month("date") != 3))


@query("g6_histogram", "WITH x AS (SELECT value AS v FROM events), s AS (SELECT min(v) AS lo, max(v) AS hi FROM x), b AS (SELECT least(20, floor((v - lo) / ((hi - lo) / 20))::INTEGER + 1) AS bin FROM x, s) SELECT r.bin::INTEGER AS bin, count(b.bin) AS n FROM (SELECT unnest(range(1, 21)) AS bin) r LEFT JOIN b ON b.bin = r.bin GROUP BY 1")
def g6(spark, sf):
    return P.histogram(read(spark, sf, "events"), "value")


@query("j3_outer_fold", f"WITH {BARS}, {ORDER_MENTIONS}, a AS (SELECT ticker, date, count(*) AS n_posts FROM om GROUP BY 1, 2), b AS (SELECT ticker, date, avg(score) AS avg_score FROM om WHERE label = 'positive' GROUP BY 1, 2) SELECT ticker, date, close, coalesce(n_posts, 0) AS n_posts, avg_score FROM bars LEFT JOIN a USING (ticker, date) LEFT JOIN b USING (ticker, date)", ["close", "avg_score"])
def j3(spark, sf):
    m = S.mentions(order_mentions(spark, sf))
    a = m.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n_posts"), F.avg(F.when(F.col("label") == "positive", F.col("score"))).alias("avg_score"))
    return P.join_sources(bars(spark, sf), [a], ["ticker", "date"], "close").select("ticker", "date", "close", S.value_or_zero("n_posts").alias("n_posts"), "avg_score")


@query("j6_excess_return", f"WITH {BARS}, r AS (SELECT ticker, date, close, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM bars), b AS (SELECT date, fwd AS bench FROM r WHERE ticker = (SELECT min(n_name) FROM nation)) SELECT ticker, date, fwd, fwd - bench AS excess FROM r LEFT JOIN b USING (date)", ["fwd", "excess"])
def j6(spark, sf):
    from panelforge.functions.series import by, forward_return

    r = bars(spark, sf).withColumn("fwd", forward_return(F.col("close"), by("ticker"), 5))
    first = read(spark, sf, "nation").agg(F.min("n_name").alias("ticker"))
    return P.excess_over(r, r.join(F.broadcast(first), "ticker"), "fwd").select("ticker", "date", "fwd", "excess")  # one row


@query("j9_w11_latest_join", f"WITH {BARS}, {ORDER_MENTIONS}, l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars), s AS (SELECT ticker, avg(prob_positive) AS pos FROM om GROUP BY 1) SELECT ticker, date, close, pos FROM l JOIN s USING (ticker) WHERE r = 1", ["close", "pos"])
def j9(spark, sf):
    s = S.mentions(order_mentions(spark, sf)).groupBy("ticker").agg(F.avg("prob_positive").alias("pos"))
    return S.latest_row(bars(spark, sf), "ticker").join(s, "ticker").select("ticker", "date", "close", "pos")


@query("j10_asof_trading_day", f"WITH {BARS}, c AS (SELECT DISTINCT date FROM bars), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT d.date, c.date AS trading_date FROM d ASOF LEFT JOIN c ON d.date <= c.date")
def j10(spark, sf):
    days = bars(spark, sf).select("date").distinct()
    dates = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return S.trading_calendar(days, dates).join(dates, "date", "left_semi")


@query("j11_unmatched", "SELECT count(*) AS n_unmatched FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j11(spark, sf):
    return P.unmatched(read(spark, sf, "orders").withColumnRenamed("o_orderkey", "k"), read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("j13_id_lookup", "WITH sel AS (SELECT l_orderkey, min(l_linenumber) AS line FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) SELECT o_orderkey, o_orderstatus, line FROM orders JOIN sel ON o_orderkey = l_orderkey")
def j13(spark, sf):
    sel = read(spark, sf, "lineitem").where("l_discount > 0.05").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"))
    return read(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(sel, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("j15_verify_target", f"WITH {BARS}, n AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, lead(close) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM bars) SELECT count(*) AS n, count(*) FILTER (WHERE (a.nx > a.close) IS DISTINCT FROM (b.close > a.close)) AS mismatches FROM n a LEFT JOIN n b ON a.ticker = b.ticker AND b.k = a.k + 1 WHERE a.nx IS NOT NULL")
def j15(spark, sf):
    b = bars(spark, sf)
    return P.verify_targets(P.with_target(b), b)


@query("p5_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'")
def p5(spark, sf):
    return read(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00' AND o_orderdate <= timestamp_ntz'1996-12-31 23:59:59.999999'").select("o_orderkey")


@query("p6_p7_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS pending FROM customer")
def p6(spark, sf):
    c, o = read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("pending", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("pending", F.lit(False)))


@query("p8_p16_normalised", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery')")
def p8(spark, sf):
    return read(spark, sf, "customer").where(F.lower(F.trim("c_mktsegment")).isin("building", "machinery")).select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"))


@query("p11_p12_thresholds", f"WITH {BARS}, x AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_bars, close * volume AS dv FROM bars) SELECT ticker, date, dv FROM x WHERE n_bars >= 26 AND dv BETWEEN 50000 AND 500000 AND close >= 1", ["dv"])
def p11(spark, sf):
    x = bars(spark, sf).withColumn("n_bars", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).withColumn("dv", F.col("close") * F.col("volume"))
    return x.where((F.col("n_bars") >= 26) & F.col("dv").between(50_000, 500_000) & (F.col("close") >= 1)).select("ticker", "date", "dv")


@query("p13_p14_p17_coerce", f"WITH {MESSAGES}, x AS (SELECT post_id, CASE WHEN post_id % 10 = 0 THEN ' n/a ' ELSE ' ' || score || ' ' END AS raw, native_label FROM msgs) SELECT post_id, greatest(coalesce(try_cast(trim(raw) AS DOUBLE), 0), 1) AS weight, CASE native_label WHEN 'Bullish' THEN 1.0 WHEN 'Bearish' THEN -1.0 ELSE 0.0 END::DOUBLE AS native FROM x", ["weight", "native"])
def p13(spark, sf):
    from panelforge.functions.text import native_value

    x = messages(spark, sf).withColumn("raw", F.when(F.col("post_id") % 10 == 0, " n/a ").otherwise(F.concat(F.lit(" "), "score", F.lit(" "))))
    return x.select("post_id", C.at_least(C.number(F.col("raw"), 0.0), 1.0).alias("weight"), native_value(F.col("native_label")).alias("native"))


@query("p10_p18_p20_flags", f"WITH {MESSAGES} SELECT ticker, count(*) FILTER (WHERE sentiment IS NULL) AS unlabelled, count(*) FILTER (WHERE sentiment > 0) AS bull, sum(CAST(coalesce(sentiment >= 0.7, false) AS INTEGER))::BIGINT AS strong FROM msgs GROUP BY 1")
def p18(spark, sf):
    s = F.col("sentiment")
    return messages(spark, sf).groupBy("ticker").agg(F.count_if(s.isNull()).alias("unlabelled"), F.count_if(s > 0).alias("bull"), F.sum(C.flag(s >= 0.7)).alias("strong"))


@query("p23_quality", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 1) AS bad_ratio, count(*) FILTER (WHERE l_shipdate < DATE '1996-01-01' OR l_shipdate > DATE '2000-12-31') AS bad_date, (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def p23(spark, sf):
    l = read(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    again = P.duplicate_rows(l, ["l_orderkey", "l_linenumber"]).first().n_duplicates
    return P.quality_report(l, "l_discount", "day", "1996-01-01", "2000-12-31").withColumn("n_duplicates", F.lit(again))


@query("o2_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50", ["p_retailprice"])
def o2(spark, sf):
    return read(spark, sf, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(50).select("p_partkey", "p_retailprice")


@query("o3_select_buys", "SELECT c_name AS ticker, 1 AS signal, round(c_acctbal / 10000, 3) AS confidence FROM customer WHERE c_acctbal > 0 ORDER BY confidence DESC, ticker LIMIT 20", ["confidence"])
def o3(spark, sf):
    s = read(spark, sf, "customer").select(F.col("c_name").alias("ticker"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("signal"), F.round(F.col("c_acctbal") / 10000, 3).alias("confidence"))
    return B.select_buys(s)


@query("o4_daily_top_decile", "WITH x AS (SELECT event_id, CAST(ts AS DATE) AS date, value, quantile_cont(value, 0.9) OVER (PARTITION BY CAST(ts AS DATE)) AS cut, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM events) SELECT event_id, date, value FROM x WHERE n >= 10 AND value >= cut", ["value"])
def o4(spark, sf):
    x = read(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("date"), "value")
    return B.top_fraction(x, "value")


@query("o6_cap_per_group", f"WITH {MESSAGES}, r AS (SELECT ticker, date, post_id, row_number() OVER (PARTITION BY ticker, date ORDER BY post_id) AS k FROM msgs) SELECT ticker, date, post_id FROM r WHERE k <= 15")
def o6(spark, sf):
    return S.cap_per_group(messages(spark, sf).select("ticker", "date", "post_id"), ["ticker", "date"], ["post_id"], 15)


@query("o10_argmax_label", f"WITH {MESSAGES} SELECT post_id, CASE WHEN prob_positive >= prob_negative AND prob_positive >= prob_neutral THEN 'positive' WHEN prob_negative >= prob_neutral THEN 'negative' ELSE 'neutral' END AS top_label FROM msgs")
def o10(spark, sf):
    from panelforge.functions.text import argmax_label

    return messages(spark, sf).select("post_id", argmax_label(F.col("prob_positive"), F.col("prob_negative"), F.col("prob_neutral")).alias("top_label"))


@query("u1_u2_union_distinct", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)")
def u1(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).unionByName(read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))).distinct()


@query("u3_keep_first", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def u3(spark, sf):
    return S.keep_first(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("u4_ordered_intersect", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n FROM t WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ORDER BY n DESC, o_custkey LIMIT 15")
def u4(spark, sf):
    t = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    u = read(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.join(u, "o_custkey", "left_semi").orderBy(F.col("n").desc(), "o_custkey").limit(15)


@query("u5_b8_portfolio_actions", "WITH p AS (SELECT n_name AS ticker FROM nation WHERE n_nationkey < 12), b AS (SELECT n_name AS ticker FROM nation WHERE n_nationkey BETWEEN 8 AND 20) SELECT coalesce(p.ticker, b.ticker) AS ticker, CASE WHEN b.ticker IS NULL THEN 'CLOSE' WHEN p.ticker IS NULL THEN 'OPEN' ELSE 'MAINTAIN' END AS action FROM p FULL JOIN b ON p.ticker = b.ticker")
def u5(spark, sf):
    n = read(spark, sf, "nation")
    return B.plan_actions(n.where("n_nationkey < 12").select(F.col("n_name").alias("ticker")), n.where("n_nationkey between 8 and 20").select(F.col("n_name").alias("ticker")))


@query("b7_size_orders", "SELECT n_name AS ticker, 'BUY' AS action, least(100000.0 / 13, 50000.0 / 9)::DOUBLE AS notional, 'submitted' AS status FROM nation WHERE n_nationkey BETWEEN 12 AND 20", ["notional"])
def b7(spark, sf):
    return B.size_orders(u5(spark, sf), 100_000.0, 50_000.0, 13)


_H4 = f"""WITH RECURSIVE {ORDER_MENTIONS}, t AS (SELECT n_name AS ticker, row_number() OVER (ORDER BY n_name) AS i FROM nation), p AS (SELECT post_id, date, list_sort(list(t.i)) AS ts FROM om JOIN t USING (ticker) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY post_id) AS k FROM p),
 e AS (SELECT date, 0::BIGINT AS k, NULL::BIGINT AS post_id, list_transform(range(1, 26), lambda i: 0) AS seen, false AS kept FROM (SELECT DISTINCT date FROM o)
  UNION ALL SELECT o.date, o.k, o.post_id, CASE WHEN len(list_filter(o.ts, lambda i: e.seen[i] < 4)) > 0 THEN list_transform(range(1, 26), lambda i: e.seen[i] + CAST(list_contains(o.ts, i) AS INTEGER)) ELSE e.seen END, len(list_filter(o.ts, lambda i: e.seen[i] < 4)) > 0 FROM e JOIN o ON o.date = e.date AND o.k = e.k + 1)
 SELECT post_id, date FROM e WHERE kept"""


@query("h4_greedy_cap", _H4)
def h4(spark, sf):
    return S.greedy_cap(order_mentions(spark, sf).select("post_id", "date", "tickers"), 4).select("post_id", "date")
