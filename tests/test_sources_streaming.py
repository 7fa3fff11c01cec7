import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import sentiment as S
from panelforge.sources import files, quoted_csv
from panelforge.sources.broker import Account, FractionRefused, orders, submit
from panelforge.sources.replay import BarReplay, FetchError, PagedReplay, RateLimit, prices_with_fallback, read_forum, trending, with_retry, write_by_ticker
from panelforge.streaming import incremental as I
from panelforge.streaming import live


def test_csv_json_and_dump(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2.5\nbad,y,z,w\n3,\n")
    assert sorted(r.id for r in files.read_typed_csv(spark, str(tmp_path / "a.csv"), "id int, x double").collect()) == [1, 3]
    assert files.read_any(spark, str(tmp_path / "a.csv")).where("id = '3'").first().x == ""
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text(json.dumps({"date": "d", "n": 1}))
    (tmp_path / "j" / "2.json").write_text("{broken")
    assert files.read_documents(spark, str(tmp_path / "j"), "date string, n int").collect() == [("d", 1)]
    (tmp_path / "d.sql").write_text("-- x\nINSERT INTO `t` VALUES (1,'a\\'b, (c)',NULL),(2,'line\\nx',3);\n")
    got = [tuple(r) for r in files.read_dump(spark, str(tmp_path / "d.sql"), "t", {"a": 0, "b": 1, "c": 2}).collect()]
    assert got == [("1", "a'b, (c)", None), ("2", "linenx", "3")]


def test_year_partitions_do_not_double(spark, tmp_path):
    df = spark.createDataFrame([("a", "2020-01-02"), ("b", "2021-01-02")], "ticker string, d string").withColumn("date", F.to_date("d"))
    for _ in range(2):
        files.write_by_year(df, str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).count() == 2
    files.swap_parquet(df, str(tmp_path / "s"))
    files.swap_parquet(df.limit(1), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_replay_sources(spark, tmp_path):
    spark.dataSource.register(PagedReplay)
    spark.dataSource.register(BarReplay)
    pages = {"AAPL": [[{"id": 3, "body": "x", "entities": {"sentiment": {"basic": "Bullish"}}}, {"id": 2}], [{"id": 2}, {"id": 1}]], "TSLA": [[{"id": 9}]]}
    for symbol, all_pages in pages.items():
        folder = tmp_path / "feed" / f"symbol={symbol}"
        folder.mkdir(parents=True)
        for k, page in enumerate(all_pages):
            (folder / f"page-{k}.json").write_text(json.dumps(page))
    (tmp_path / "feed" / "symbol=BAD").mkdir()
    (tmp_path / "feed" / "symbol=BAD" / "page-0.json").write_text("{broken")
    feed = spark.read.format("paged_replay").option("path", str(tmp_path / "feed")).option("page_size", "2").load()
    assert sorted(r.id for r in feed.collect()) == [2, 3, 9] and {r.sentiment for r in feed.collect()} == {"Bullish", None}
    assert [r.symbol for r in trending(feed, 1).collect()] == ["AAPL"]
    bars = tmp_path / "bars"
    bars.mkdir()
    (bars / "A.json").write_text(json.dumps([["2023-01-02", 1, 2], ["2023-12-20", 1, 2], ["2024-01-02", 1, 2]]))
    (bars / "B.json").write_text(json.dumps([["2024-01-02", 3, 4]]))
    reader = spark.read.format("bar_replay").option("path", str(bars))
    assert reader.option("symbols", "A,BTC/USD").load().count() == 3
    warm = reader.option("symbols", "A").option("start", "2024-01-02").load()
    assert [r.date for r in warm.collect()] == ["2023-12-20", "2024-01-02"]  # 60 days ahead
    both = prices_with_fallback(warm, spark.createDataFrame([("A", "2020-01-02", 9.0, 1.0), ("C", "2020-01-02", 9.0, 1.0)], "ticker string, date string, close double, volume double"))
    assert sorted((r.ticker, r.source) for r in both.collect()) == [("A", "live"), ("A", "live"), ("C", "spare")]
    for _ in range(2):
        write_by_ticker(both, str(tmp_path / "by_ticker"))
    assert spark.read.parquet(str(tmp_path / "by_ticker")).count() == 3
    forum = tmp_path / "forum"
    forum.mkdir()
    (forum / "new.json").write_text('{"post_id": "a", "score": 5}\n{"post_id": "b"}\n{broken\n')
    (forum / "hot.json").write_text('{"post_id": "a", "score": 1}\n')
    assert sorted((r.post_id, r.feed) for r in read_forum(spark, str(forum)).collect()) == [("a", "hot"), ("b", "new")]


def test_retry_and_rate_limit():
    waits, left = [], [FetchError("x"), FetchError("y", wait=7.0), "done"]

    def call():
        x = left.pop(0)
        if isinstance(x, FetchError):
            raise x
        return x

    assert with_retry(call, sleep=waits.append) == "done" and waits == [1.0, 7.0]
    left[:] = [FetchError("x")] * 3
    assert with_retry(call, sleep=waits.append, default=[]) == []
    now = [0.0]

    def sleep(s):
        now[0] += s

    limit = RateLimit(2, 10.0, lambda: now[0], sleep)
    for _ in range(5):
        limit.wait()
    assert now[0] == 20.0


class _Desk:
    """A broker that keeps what it is told."""

    def __init__(self):
        self.sent = []

    def account(self):
        return Account(1000.0, 300.0)

    def positions(self):
        return ["OLD", "KEEP"]

    def price(self, ticker):
        return 40.0

    def close(self, ticker):
        self.sent.append(("close", ticker))
        return "filled"

    def buy_notional(self, ticker, notional):
        if ticker == "WHOLE":
            raise FractionRefused(ticker)
        if ticker == "DOWN":
            raise OSError("no answer")
        self.sent.append(("buy", ticker, notional))
        return "filled"

    def buy_shares(self, ticker, shares):
        self.sent.append(("shares", ticker, shares))
        return "filled"


def test_orders_go_out_behind_the_interface(spark):
    desk = _Desk()
    buys = spark.createDataFrame([("KEEP",), ("NEW",), ("WHOLE",), ("DOWN",)], "ticker string")
    got = {r["ticker"]: r["status"] for r in submit(orders(spark, desk, buys), desk)}
    assert got == {"OLD": "filled", "NEW": "filled", "WHOLE": "filled", "DOWN": "failed"}
    assert desk.sent == [("close", "OLD"), ("buy", "NEW", 100.0), ("shares", "WHOLE", 2)]


def test_documents_inventory_reports(spark, tmp_path):
    from datetime import date

    for day, name, body in (("2024-01-03", "a.json", {"n": 1}), ("2024-01-05", "b.json", {"n": 2}), ("2024-01-05", "c.json", {"n": 3})):
        (tmp_path / "docs" / day).mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / day / name).write_text(json.dumps(body))
    (tmp_path / "docs" / "2024-01-05" / "d.json").write_text("{broken")
    read = lambda day: [r.n for r in files.read_day_documents(spark, str(tmp_path / "docs"), day, "n int").collect()]
    assert read(date(2024, 1, 6)) == [3, 2] and read(date(2024, 1, 4)) == [1] and read(date(2024, 3, 1)) == []
    found = {r.suffix: (r.n_files, r.n_bytes) for r in files.folder_inventory(spark, str(tmp_path / "docs")).collect()}
    assert found == {"json": (4, 31)}
    assert files.is_fresh(spark, str(tmp_path / "docs" / "2024-01-05"), 1) and not files.is_fresh(spark, str(tmp_path / "none"), 1)
    files.write_json_document(spark, str(tmp_path / "r" / "report.json"), {"day": date(2024, 1, 5), "n": 2})
    assert json.loads((tmp_path / "r" / "report.json").read_text()) == {"day": "2024-01-05", "n": 2}
    assert files.markdown_table([{"a": 1.5, "b": None}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 1.5000 | - |"
    (tmp_path / "f.csv").write_text("month,mkt_rf,smb,hml\n201407,-2.04,1.0,x\n2014-08,4.24,0,-0.5\n,1,1,1\n")
    got = [(str(r.month), r.mkt_rf, r.hml) for r in files.read_factors(spark, str(tmp_path / "f.csv")).orderBy("month").collect()]
    assert got[0][0] == "2014-07-01" and abs(got[0][1] + 0.0204) < 1e-12 and got[0][2] is None and len(got) == 2
    bars = spark.createDataFrame([("A", date(2020, 1, 1)), ("A", date(2021, 1, 1))], "ticker string, date date")
    cover = files.coverage(bars, spark.createDataFrame([("A",), ("B",)], "ticker string"))
    assert cover.first().share == 0.5 and files.covers(cover, date(2020, 6, 1), date(2020, 7, 1), 0.5) and not files.covers(cover, date(2020, 6, 1), date(2020, 7, 1))
    files.write_plain(bars, str(tmp_path / "plain"), "csv")
    assert files.read_text_csv(spark, str(tmp_path / "plain")).count() == 2
    (tmp_path / "enc.csv").write_bytes(b"id,x\n1,caf\xe9\n2,ok\n")
    assert files.read_typed_csv(spark, str(tmp_path / "enc.csv"), "id int, x string").count() == 2


def test_live_steps(spark, tmp_path):
    from datetime import datetime

    rows = spark.createDataFrame([("A", 0.6)], "ticker string, proba double")
    for at in (datetime(2024, 1, 2, 10), datetime(2024, 1, 2, 10), datetime(2024, 1, 2, 11)):
        live.log_predictions(rows, str(tmp_path / "log"), at)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert live.run_if_open(False, lambda: rows) is None and live.run_if_open(True, lambda: rows) is rows
    marks, ran, now = live.Markers(spark, str(tmp_path / "marks"), lambda: now[0]), [], [0.0]

    def step(name):
        def body():
            ran.append(name)
            now[0] += 10
        return body

    steps = {k: step(k) for k in "abc"}
    assert marks.run(steps, seconds=15) == ["a", "b"] and marks.run(steps) == ["c"] and marks.run(steps) == [] and ran == ["a", "b", "c"]
    assert marks.lock("me") and marks.lock("me") and not marks.lock("you")
    marks.release()
    assert marks.lock("you")


def test_late_rows_of_days(spark, tmp_path):
    """Rows inside the mark count, later ones do not, open days are not out yet; a replay changes nothing."""
    at = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    files_ = [[(at(1, 1), "a"), (at(2, 1), "a")], [(at(3, 2), "b"), (at(2, 5), "a")], [(at(2, 9), "a"), (at(5, 3), "a")], [(at(1, 9), "late"), (at(8, 0), "b")]]
    for rows in files_:
        spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("ts"), "k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = I.file_stream(spark, str(tmp_path / "in"), "ts timestamp, k string", max_files=1)
    for checkpoint in ("one", "two"):
        out = I.drain_days(I.daily_stream(stream, "ts", ["k"], [F.count("*").alias("n")], "1 day"), str(tmp_path / "out"), str(tmp_path / checkpoint))
        assert sorted((str(r.date), r.k, r.n) for r in out.collect()) == [("2024-01-01", "a", 1), ("2024-01-02", "a", 3), ("2024-01-03", "b", 1), ("2024-01-05", "a", 1)]
    calendar = spark.createDataFrame([("2024-01-01", "2024-01-02"), ("2024-01-02", "2024-01-02"), ("2024-01-03", "2024-01-03"), ("2024-01-05", None)], "a string, b string").select(F.to_date("a").alias("date"), F.to_date("b").alias("trading_date"))
    rolled = I.on_trading_dates(out, calendar, ["k"], ["n"])
    assert sorted((r.k, str(r.trading_date), r.n) for r in rolled.collect()) == [("a", "2024-01-02", 4), ("b", "2024-01-03", 1)]


def capped_by_hand(rows, cap):
    """Message by message, as they come; the ids that are kept."""
    taken, kept = {}, []
    for post, ts, tickers in rows:
        if any(taken.get((ts[:10], t), 0) < cap for t in tickers):
            kept.append(post)
            for t in tickers:
                taken[ts[:10], t] = taken.get((ts[:10], t), 0) + 1
    return kept


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def message_rows(n=300):
    rng = random.Random(4)
    return [(i, f"2024-01-{1 + i // 60:02d} {i % 60 // 3:02d}:00:00", rng.sample("ABCDE", rng.randint(1, 3))) for i in range(n)]


_MESSAGE = "post_id long, t string, tickers array<string>"


def test_capped_stream_equals_batch_over_restarts(spark, tmp_path, rocks):
    """Counters come back from the state store after each stop; copies of a message count once."""
    rows = message_rows()
    df = spark.createDataFrame(rows, _MESSAGE).withColumn("ts", F.to_timestamp("t")).drop("t")
    for lo, hi in ((0, 70), (70, 170), (170, 300)):
        part = df.where(F.col("post_id").between(lo, hi - 1))
        part.unionByName(part.limit(9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = I.file_stream(spark, str(tmp_path / "in"), df.schema, max_files=1)
        got = I.drain_to_parquet(I.capped_stream(stream, 7, "ts"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = capped_by_hand(rows, 7)
    assert sorted(r.post_id for r in got.collect()) == want
    batch = S.greedy_cap(df.withColumn("date", F.to_date("ts")), 7)
    assert sorted(r.post_id for r in batch.collect()) == want


def test_capped_stream_starts_from_what_was_written(spark, tmp_path, rocks):
    """Without a checkpoint the counters start at the rows written before."""
    rows = message_rows(120)
    df = spark.createDataFrame(rows, _MESSAGE).withColumn("ts", F.to_timestamp("t")).drop("t")
    kept = capped_by_hand(rows[:80], 5)
    written = df.where(F.col("post_id").isin(kept)).select(F.to_date("ts").alias("date"), F.explode("tickers").alias("ticker"))
    df.where("post_id >= 80").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = I.file_stream(spark, str(tmp_path / "in"), df.schema)
    got = I.drain_to_parquet(I.capped_stream(stream, 5, "ts", written=written), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(r.post_id for r in got.collect()) == [k for k in capped_by_hand(rows, 5) if k >= 80]


def csv_folder(path, n=300):
    """Files with line ends, separators and quotes in quoted cells, stray quotes and bad lines; the rows that are whole."""
    rng, want = random.Random(6), []
    path.mkdir()
    for f in range(3):
        buf = io.StringIO(newline="")
        out = csv.writer(buf, lineterminator="\n", quoting=csv.QUOTE_NONNUMERIC)
        out.writerow(["id", "t", "x"])
        for i in range(n):
            row = (f * 1000 + i, "".join(rng.choice(["a", "b ", '"', ",", "\n", "\r\n", "é", '""']) for _ in range(rng.choice([0, 1, 5, 60]))), i / 4)
            out.writerow(row)
            want.append((row[0], row[1] or None, row[2]))
            if i % 50 == 0:
                buf.write("bad,line\n")
            if i % 70 == 0:
                buf.write(f'{f * 1000 + 500 + i},un"quoted,1.5\n')
                want.append((f * 1000 + 500 + i, 'un"quoted', 1.5))
        (path / f"{f}.csv").write_text(buf.getvalue(), newline="")
    return sorted(want, key=repr)


@pytest.mark.parametrize("split", ["700", "5000", "128m"])
def test_quoted_csv_in_splits(spark, tmp_path, split):
    """The same rows from splits of any size; Spark's whole-file reader agrees."""
    want, schema = csv_folder(tmp_path / "in"), "id long, t string, x double"
    names = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        got = sorted(map(tuple, quoted_csv.read_quoted_csv(spark, str(tmp_path / "in"), schema).collect()), key=repr)
        texts = quoted_csv.read_quoted_csv(spark, str(tmp_path / "in"))
        assert texts.columns == ["id", "t", "x"] and texts.where("t = 'un\"quoted'").count() == 15
        if split == "700":
            assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    whole = spark.read.schema(f"{schema}, _bad string").csv(str(tmp_path / "in"), header=True, multiLine=True, escape='"', columnNameOfCorruptRecord="_bad")
    assert sorted(map(tuple, whole.cache().where("_bad is null").select("id", "t", "x").collect()), key=repr) == want


def test_quoted_csv_with_an_unclosed_quote(spark, tmp_path, monkeypatch):
    """What an unclosed quote swallows is one malformed record; other files are whole, bytes that are no text are replaced."""
    monkeypatch.setattr(quoted_csv, "MOST_CHARS", 1000)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('id,t\n1,x\n2,"open\n' + "3,y\n" * 2000)
    (tmp_path / "in/b.csv").write_bytes(b'id,t\n4,z\xff\n\n5,"q"\n')
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path / "in"), "id int, t string")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (4, "z\ufffd"), (5, "q")]


def test_incremental_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "post_id int, t string")
    df.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        I.append_incremental(I.file_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), "post_id", str(tmp_path / f"cp{k}"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
