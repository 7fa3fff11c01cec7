"""Queries that send tables through the file sources, sinks and streams and back."""

from __future__ import annotations

import json
import os
from datetime import date, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelforge.operators import panel as P
from panelforge.operators import sentiment as M
from panelforge.operators import training as L
from panelforge.plans.fixtures import BARS, bars, messages, read
from panelforge.plans.registry import query
from panelforge.sources import files, quoted_csv, replay
from panelforge.storage import fresh_path
from panelforge.streaming import incremental, live


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return fresh_path(spark, name)


@query("s1_s11_text_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ', \"x\"' AS n_name, '' AS missing FROM nation")
def s1(spark, sf):
    path = scratch(spark, "csv")
    rows = read(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "x"')).alias("n_name"), F.lit(None).cast("string").alias("missing"))
    rows.write.option("escape", '"').csv(path, header=True)
    return files.read_text_csv(spark, path)


@query("s2_s3_s4_typed_csv", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0", ["o_totalprice"])
def s2(spark, sf):
    path = scratch(spark, "typed")
    k = F.col("o_orderkey")
    line = F.when(k % 10 == 0, F.concat(F.lit("bad,"), F.lit("no number,one cell too many"))).otherwise(F.concat_ws(",", k.cast("string"), F.col("o_totalprice").cast("string")))
    read(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return files.read_typed_csv(spark, path, "o_orderkey long, o_totalprice double", header=False)


@query("s1_s3_s4_quoted_newlines", "SELECT doc_id, nullif(text, '') AS text, lang FROM documents")
def s3_quoted(spark, sf):
    """Whole documents as CSV cells with line ends and quotes in them; an empty cell is a missing one."""
    path = scratch(spark, "quoted")
    read(spark, sf, "documents").select("doc_id", "text", "lang").write.option("escape", '"').csv(path, header=True)
    return quoted_csv.read_quoted_csv(spark, path, "doc_id long, text string, lang string")


@query("s5_s7_folder", "SELECT event_type, count(*) AS n, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1")
def s5(spark, sf):
    path = scratch(spark, "folder")
    read(spark, sf, "events").select("event_id", "event_type").write.partitionBy("event_type").parquet(path)
    found = files.read_folder(spark, path, "parquet").withColumn("event_type", F.regexp_extract("file_path", "event_type=([^/]+)/", 1))
    return found.groupBy("event_type").agg(F.count_distinct("event_id").alias("n"), F.count_distinct("event_type").alias("n_types"))


@query("s8_swap_parquet", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 9")
def s8(spark, sf):
    path, n = scratch(spark, "swap"), read(spark, sf, "nation").select("n_nationkey", "n_name")
    files.swap_parquet(n, path)
    files.swap_parquet(n.where("n_nationkey < 9"), path)
    return spark.read.parquet(path)


@query("s9_year_partitions", f"WITH {BARS} SELECT year(date)::INTEGER AS year, count(*) AS n FROM bars GROUP BY 1")
def s9(spark, sf):
    path, b = scratch(spark, "years"), bars(spark, sf)
    files.write_by_year(b, path)
    files.write_by_year(b.where("year(date) = 1996"), path)
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("s10_append_new", "SELECT event_id, event_type FROM events")
def s10(spark, sf):
    path, e = scratch(spark, "append"), read(spark, sf, "events").select("event_id", "event_type")
    files.append_new(e.where("event_id % 3 <> 0"), path, "event_id")
    files.append_new(e, path, "event_id")
    files.append_new(e, path, "event_id")
    return spark.read.parquet(path)


@query("s12_day_documents", "SELECT n_nationkey AS n, n_name AS name, DATE '2024-01-05' AS day FROM nation WHERE n_nationkey % 2 = 0")
def s12(spark, sf):
    root = scratch(spark, "days")
    for r in read(spark, sf, "nation").select("n_nationkey", "n_name").collect():  # 25 small documents
        files.write_json_document(spark, f"{root}/2024-01-0{5 if r.n_nationkey % 2 == 0 else 3}/{r.n_nationkey}.json", {"n": r.n_nationkey, "name": r.n_name})
    return files.read_day_documents(spark, root, date(2024, 1, 7), "n long, name string").select("n", "name", "day")


@query("s19_factors", f"WITH {BARS} SELECT date_trunc('month', date)::DATE AS month, round(avg(close) / 1000, 4) / 100 AS mkt_rf, 0.01::DOUBLE AS smb, NULL::DOUBLE AS hml FROM bars GROUP BY 1", ["mkt_rf", "smb", "hml"])
def s19(spark, sf):
    path = scratch(spark, "factors")
    monthly = bars(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.round(F.avg("close") / 1000, 4).alias("mkt_rf"))
    monthly.select("month", "mkt_rf", F.lit(1.0).alias("smb"), F.lit("n/a").alias("hml")).write.csv(path, header=True)
    return files.read_factors(spark, path)


@query("s20_inventory", "SELECT 'json' AS suffix, count(*) AS n_files, sum(length('{\n  \"n\": ' || n_nationkey || '\n}'))::BIGINT AS n_bytes FROM nation")
def s20(spark, sf):
    root = scratch(spark, "inventory")
    for r in read(spark, sf, "nation").select("n_nationkey").collect():  # 25 small documents
        files.write_json_document(spark, f"{root}/{r.n_nationkey % 3}/{r.n_nationkey}.json", {"n": r.n_nationkey})
    return files.folder_inventory(spark, root).where("suffix = 'json'").select("suffix", "n_files", "n_bytes")


@query("s21_read_any", "SELECT c_custkey, c_mktsegment FROM customer")
def s21(spark, sf):
    path = scratch(spark, "any") + ".jsonl"
    read(spark, sf, "customer").select("c_custkey", "c_mktsegment").write.json(path)
    return files.read_any(spark, path).select("c_custkey", "c_mktsegment")


@query("s22_coverage", f"WITH {BARS}, u AS (SELECT n_name AS ticker FROM nation UNION ALL SELECT 'NO_PRICE'), b AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1) SELECT min(lo) AS date_min, max(hi) AS date_max, count(lo)::DOUBLE / count(*) AS share FROM u LEFT JOIN b USING (ticker)", ["share"])
def s22(spark, sf):
    universe = read(spark, sf, "nation").select(F.col("n_name").alias("ticker")).unionByName(spark.range(1).select(F.lit("NO_PRICE").alias("ticker")))
    return files.coverage(bars(spark, sf), universe)


_STREAMED = "event_id long, ts timestamp, event_type string"


def _stream(spark, sf):
    path = scratch(spark, "stream-in")
    read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").repartition(3).write.parquet(path)
    return incremental.file_stream(spark, path, _STREAMED, max_files=1)


@query("h2_incremental_append", "SELECT event_id, upper(event_type) AS event_type FROM events")
def h2(spark, sf):
    out = scratch(spark, "stream-out")
    for _ in range(2):  # the second pass starts without a checkpoint and adds nothing
        incremental.append_incremental(_stream(spark, sf), out, "event_id", scratch(spark, "checkpoint"), lambda df: df.select("event_id", F.upper("event_type").alias("event_type")))
    return spark.read.parquet(out)


def _arrivals(rows, path: str, ts: str, n: int = 3) -> None:
    """Rows as n files, each written after the one before, in order of time."""
    lo, hi = rows.agg(F.min(F.unix_date(F.to_date(ts))), F.max(F.unix_date(F.to_date(ts)))).first()
    part = F.floor((F.unix_date(F.to_date(ts)) - F.lit(lo)) * n / F.lit(hi - lo + 1))
    for i in range(n):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(path)


@query("h3_h7_daily_stream", "WITH e AS (SELECT CAST(ts AS DATE) AS date, event_type FROM events), c AS (SELECT DISTINCT date FROM e WHERE isodow(date) < 6), r AS (SELECT e.event_type, (SELECT min(c.date) FROM c WHERE c.date >= e.date) AS trading_date FROM e WHERE date + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)) SELECT event_type, trading_date, count(*) AS n FROM r WHERE trading_date IS NOT NULL GROUP BY 1, 2")
def h3(spark, sf):
    """Days that are final: their end lies a day or more before the last event."""
    dates = messages(spark, sf).select("date").distinct()
    calendar = M.trading_calendar(dates.where(F.weekday("date") < 5), dates)
    path = scratch(spark, "days-in")
    _arrivals(read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), path, "ts")
    days = incremental.daily_stream(incremental.file_stream(spark, path, _STREAMED, max_files=1), "ts", ["event_type"], [F.count(F.lit(1)).alias("n")])
    store = incremental.drain_days(days, scratch(spark, "days-out"), scratch(spark, "checkpoint"))
    return incremental.on_trading_dates(store, calendar, ["event_type"], ["n"])


_TWO = "p AS (SELECT event_id AS post_id, ts, CAST(ts AS DATE) AS date, [event_type, 'U' || user_id % 7] AS tickers FROM events)"


@query("h4_h5_capped_stream", f"WITH {_TWO}, k AS (SELECT post_id, row_number() OVER (PARTITION BY date, t ORDER BY ts, post_id) AS r FROM (SELECT post_id, ts, date, unnest(tickers) AS t FROM p)) SELECT DISTINCT post_id FROM k WHERE r <= 9")
def h5_stream(spark, sf):
    """The greedy cap as state over arriving files, stopped after each and started again from its checkpoint."""
    path, out, checkpoint = (scratch(spark, x) for x in ("cap-in", "cap-out", "cap-checkpoint"))
    e = read(spark, sf, "events").select(F.col("event_id").alias("post_id"), F.col("ts").cast("timestamp").alias("ts"), F.array("event_type", F.concat(F.lit("U"), F.col("user_id") % 7)).alias("tickers"))
    _arrivals(e, path, "ts")
    stores = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(stores)
    spark.conf.set(stores, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        kept = incremental.drain_to_parquet(incremental.capped_stream(incremental.file_stream(spark, path, e.schema, max_files=1), 9, "ts"), out, checkpoint)
    finally:
        spark.conf.set(stores, before)
    return kept.select("post_id")


@query("h8_prediction_log", "SELECT run, count(*) AS n FROM nation, (VALUES ('20240102_100000'), ('20240102_110000')) r(run) GROUP BY 1")
def h8(spark, sf):
    path, rows = scratch(spark, "predictions"), read(spark, sf, "nation").select(F.col("n_name").alias("ticker"), (F.col("n_nationkey") / 25).alias("proba"))
    for hour in (10, 10, 11):  # a run that is repeated replaces itself
        live.log_predictions(rows, path, datetime(2024, 1, 2, hour))
    return spark.read.schema("ticker string, proba double, run string").parquet(path).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _write_json(path: str, value) -> None:
    """A fixture file on this machine, as a replayed feed reads it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f)


def _here(spark: SparkSession, name: str) -> str:
    return scratch(spark, name).removeprefix("file://")


@query("s14_paged_feed", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) SELECT event_type AS symbol, event_id AS id, event_type || ' ' || event_id AS body, CASE WHEN event_id % 2 = 0 THEN 'Bullish' END AS sentiment FROM r WHERE k <= 60")
def s14(spark, sf):
    root = _here(spark, "feed")
    e = read(spark, sf, "events").select("event_id", "event_type")
    newest = M.cap_per_group(e, ["event_type"], [F.col("event_id").desc()], 90).collect()  # three pages for each of a few event types
    for kind in sorted({r.event_type for r in newest}):
        ids = sorted((r.event_id for r in newest if r.event_type == kind), reverse=True)
        for k in range(0, len(ids), 30):
            page = [{"id": i, "body": f"{kind} {i}", "entities": {"sentiment": {"basic": "Bullish"} if i % 2 == 0 else None}} for i in ids[k : k + 30]]
            _write_json(f"{root}/symbol={kind}/page-{k // 30}.json", page)
    spark.dataSource.register(replay.PagedReplay)
    return spark.read.format("paged_replay").option("path", root).option("max_pages", "2").load().select("symbol", "id", "body", "sentiment")


@query("s15_forum_feeds", "SELECT CAST(n_nationkey AS VARCHAR) AS post_id, CASE WHEN n_nationkey % 3 = 0 THEN 'hot' ELSE 'new' END AS feed, CASE WHEN n_nationkey % 3 = 0 THEN 7 ELSE n_nationkey END::BIGINT AS score FROM nation")
def s15(spark, sf):
    root, keys = scratch(spark, "forum"), [r.n_nationkey for r in read(spark, sf, "nation").select("n_nationkey").collect()]
    lines = lambda rows: "\n".join(json.dumps(r) for r in rows) + "\n{broken\n"
    files.write_text(spark, f"{root}/new.json", lines({"post_id": str(k), "score": k} for k in keys))
    files.write_text(spark, f"{root}/hot.json", lines({"post_id": str(k), "score": 7} for k in keys if k % 3 == 0))
    return replay.read_forum(spark, root).select("post_id", "feed", "score")


_MONTH_ENDS = "me AS (SELECT ticker, arg_max(date, date) AS date, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY ticker, date_trunc('month', date))"


@query("s16_s17_bar_feed", f"WITH {BARS}, {_MONTH_ENDS}, n AS (SELECT n_name, n_nationkey AS k FROM nation) SELECT ticker, CAST(date AS VARCHAR) AS date, close, volume, CASE WHEN k < 15 THEN 'live' ELSE 'spare' END AS source FROM me JOIN n ON ticker = n_name WHERE k >= 15 OR date >= DATE '1998-01-01' - INTERVAL 60 DAY", ["close", "volume"])
def s16(spark, sf):
    root = _here(spark, "bars")
    last = bars(spark, sf).groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.max_by(F.struct(F.col("date").cast("string").alias("date"), "close", "volume"), "date").alias("b")).select("ticker", "b.*")
    live_names = [r.n_name for r in read(spark, sf, "nation").where("n_nationkey < 15").select("n_name").collect()]
    rows = last.where(F.col("ticker").isin(live_names)).collect()  # a row for each of 15 tickers and month
    for name in live_names:
        _write_json(f"{root}/{name}.json", sorted([r.date, r.close, r.volume] for r in rows if r.ticker == name))
    spark.dataSource.register(replay.BarReplay)
    feed = spark.read.format("bar_replay").option("path", root).option("chunk", "4").option("start", "1998-01-01").load()
    return replay.prices_with_fallback(feed, last)


@query("m5_importance")
def m5(spark, sf):
    p = P.bar_features(bars(spark, sf)).withColumn("target", (F.col("return_5d_forward") > 0).cast("int")).where("return_5d_forward is not null")
    features = ["bb_width", "bb_pct", "volatility_20d", "volume_ratio"]
    path = scratch(spark, "model")
    L.save_model(L.train_trees(p, features, rounds=5, depth=3), path, features, {"rows": "all"})
    model, names, _ = L.load_model(spark, path)
    return spark.createDataFrame(L.importance(model, names), "feature string, gain double, weight long, cover double, gain_normalized double")
