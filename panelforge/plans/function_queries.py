"""Queries of scalar, text, parsing and source functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import columns as C
from panelforge.functions import text as T
from panelforge.operators.text_model import fit_text_model, labelled_texts
from panelforge.plans.fixtures import MESSAGES, messages, read
from panelforge.plans.registry import query
from panelforge.sources.files import dump_rows, html_universe

_UNIVERSE = ["AAPL", "TSLA", "MSFT", "NVDA", "BRK-B", "AMD", "IT", "SO", "A", "GS"]
_POST = "'check $TSLA and $BRK.B vs AAPL! IT is SO good ' || CASE WHEN {k} % 3 = 0 THEN 'MSFT' ELSE 'msft' END || ' $A $' || CASE WHEN {k} % 2 = 0 THEN 'NVDA' ELSE 'GME' END"


def _posts(spark, sf):
    """A planted head and the whole text of each document."""
    k = F.col("doc_id")
    return read(spark, sf, "documents").select("doc_id", F.concat(F.lit("check $TSLA and $BRK.B vs AAPL! IT is SO good "), F.when(k % 3 == 0, "MSFT").otherwise("msft"), F.lit(" $A $"), F.when(k % 2 == 0, "NVDA").otherwise("GME"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("post"))


@query("f1_f2_symbols", "SELECT c_custkey, replace(upper(trim(lower(' ' || c_mktsegment || '.b '))), '.', '-') AS norm, replace(replace(upper(c_mktsegment) || '-B', '-', '/'), '/', '-') AS there_and_back FROM customer")
def f1(spark, sf):
    c = F.col("c_mktsegment")
    return read(spark, sf, "customer").select("c_custkey", C.normalise_ticker(F.lower(F.concat(F.lit(" "), c, F.lit(".b ")))).alias("norm"), C.from_slash(C.to_slash(F.concat(F.upper(c), F.lit("-B")))).alias("there_and_back"))


@query("f3_clean_symbols", "SELECT n_nationkey, list_sort(list_distinct(list_filter([upper(ltrim(trim(' $' || n_name || ' '), '$')), 'ABC', '9X'], lambda s: regexp_matches(s, '^[A-Z][A-Z0-9-]*$')))) AS symbols FROM nation")
def f3(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", C.clean_symbols(F.array(F.concat(F.lit(" $"), "n_name", F.lit(" ")), F.lit("ABC"), F.lit("9X"))).alias("symbols"))


@query("f4_p16_input_text", "WITH d AS (SELECT doc_id, trim(coalesce(source, '')) AS title, unnest(['text', '[removed]', '  ', 'nan']) AS variant, coalesce(text, '') AS text FROM documents), b AS (SELECT doc_id, variant, title, trim(CASE variant WHEN 'text' THEN text ELSE variant END) AS body FROM d), m AS (SELECT doc_id, variant, title, CASE WHEN body IN ('[removed]', '[deleted]', 'nan') THEN '' ELSE body END AS body FROM b) SELECT doc_id, variant, CASE WHEN body <> '' AND title <> '' THEN title || '. ' || body WHEN title <> '' THEN title ELSE body END AS input FROM m")
def f4(spark, sf):
    """Every whole text as the body, and beside it a removed, a blank and a missing one."""
    variant = F.explode(F.array(*[F.lit(v) for v in ("text", "[removed]", "  ", "nan")]))
    d = read(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), variant.alias("variant"))
    body = F.when(F.col("variant") == "text", F.col("text")).otherwise(F.col("variant"))
    return d.select("doc_id", "variant", T.input_text(F.col("source"), T.drop_markers(body)).alias("input"))


_CLEAN = "text"
for _p, _to in ((r"(?m)^>+\s?", " "), (r"(?m)^[-*_]{3,}\s*$", " "), (r"(?i)/[ur]/\w+", " "), (r"(?i)https?://\S+|www\.\S+", " "), (r"\*{1,2}|_{1,2}|~~|>!|!<", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_to}', 'g')"
_CLEAN = f"lower(regexp_replace(regexp_replace({_CLEAN}, '\\$([A-Z]{{1,5}}(?:[.\\-][A-Z]{{1,2}})?)\\b', '\\1', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'))"
_CLEAN = f"regexp_replace({_CLEAN}, '{'|'.join(T.BOILERPLATE)}', ' ', 'g')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '[^a-z0-9 .,''!\\?%\\(\\)\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("f5_x1_clean_text", f"WITH d AS (SELECT doc_id, '> quoted\n***\n' || 'see https://x.y/z /r/wsb **bold** $TSLA rocket not financial advice unfair & ' || text AS text FROM documents) SELECT doc_id, {_CLEAN} AS clean_text FROM d")
def f5(spark, sf):
    head = "> quoted\n***\nsee https://x.y/z /r/wsb **bold** $TSLA \U0001F680rocket not financial advice unfair &amp; "
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit(head), F.col("text")).alias("text"))
    return T.clean_text(d, "text").select("doc_id", "clean_text")


@query("f6_f7_f8_detect", f"WITH p AS (SELECT doc_id, {_POST.format(k='doc_id')} AS post FROM documents) SELECT doc_id, list_sort(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(post, '\\$([A-Z]{{1,5}}(?:[.\\-][A-Z]{{1,2}})?)\\b', 1), lambda s: replace(s, '.', '-')), lambda s: list_contains({_UNIVERSE!r}, s)), list_filter(regexp_extract_all(post, '(?:^|[^$A-Za-z0-9_])([A-Z]{{2,5}})\\b', 1), lambda s: list_contains(['AAPL', 'TSLA', 'MSFT', 'NVDA', 'AMD'], s))))) AS tickers FROM p")
def f6(spark, sf):
    return _posts(spark, sf).select("doc_id", T.detect_tickers(F.col("post"), F.array(*[F.lit(u) for u in _UNIVERSE])).alias("tickers"))


@query("f9_title_cashtags", f"WITH p AS (SELECT doc_id, {_POST.format(k='doc_id')} AS post FROM documents) SELECT doc_id, list_sort(list_distinct(regexp_extract_all(upper(post), '\\$([A-Z]{{1,5}})', 1))) AS tickers FROM p")
def f9(spark, sf):
    return _posts(spark, sf).select("doc_id", T.title_cashtags(F.col("post")).alias("tickers"))


@query("f10_f11_symbol_cells", "SELECT n_nationkey, [n_name, 'X'] AS symbols FROM nation")
def f10(spark, sf):
    k, n = F.col("n_nationkey"), F.col("n_name")
    both = F.array(n, F.lit("X"))
    cell = F.when(k % 4 == 0, F.to_json(F.transform(both, lambda s: F.struct(s.alias("symbol"))))).when(k % 4 == 1, F.to_json(both)).when(k % 4 == 2, F.replace(F.to_json(both), F.lit('"'), F.lit("'"))).otherwise(F.concat_ws("; ", n, F.lit("X")))
    return read(spark, sf, "nation").select("n_nationkey", T.symbols_cell(cell).alias("symbols"))


@query("f12_f13_f14_json", "SELECT event_id, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'Bullish' END AS native, (event_id % 9)::INTEGER AS likes, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'is None, or True, it is' AS body, true AS ok FROM events")
def f12(spark, sf):
    e = F.col("event_id")
    cell = F.concat(F.lit("{'symbols': [{'symbol': '"), "event_type", F.lit("'}], 'entities': {'sentiment': "), F.when(e % 2 == 0, "{'basic': 'Bullish'}").otherwise("None"), F.lit("}, 'likes': {'total': "), (e % 9).cast("string"), F.lit("}, 'body': 'is None, or True, it is', 'ok': True}"))
    parsed = F.from_json(T.python_literal(cell), "symbols array<struct<symbol:string>>, entities struct<sentiment:struct<basic:string>>, likes struct<total:int>, body string, ok boolean")
    rows = read(spark, sf, "events").select("event_id", parsed.alias("m"), F.from_json("props", "k int").alias("p"))
    return rows.select("event_id", F.get("m.symbols", F.lit(0))["symbol"].alias("symbol"), F.col("m.entities.sentiment.basic").alias("native"), F.col("m.likes.total").alias("likes"), F.col("p.k").alias("k"), F.col("m.body").alias("body"), F.col("m.ok").alias("ok"))


@query("f15_native_label", f"WITH {MESSAGES} SELECT post_id, CASE post_id % 4 WHEN 0 THEN 'Bullish' WHEN 1 THEN 'Bearish' WHEN 2 THEN 'Bullish' END AS label FROM msgs")
def f15(spark, sf):
    k = F.col("post_id")
    raw = F.when(k % 4 == 0, " bull ").when(k % 4 == 1, "-1").when(k % 4 == 2, "Positive").otherwise("meh")
    return messages(spark, sf).select("post_id", T.native_label(raw).alias("label"))


@query("f16_f17_dates", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(ts, '%Y-%m') AS month, year(ts)::INTEGER AS y, strftime(CAST(ts AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS next_month FROM events")
def f16(spark, sf):
    ts = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 2 == 0, F.unix_timestamp(ts).cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return read(spark, sf, "events").select("event_id", C.iso_utc(C.parse_time(raw)).alias("iso"), C.month_of(F.col("ts").cast("date")).alias("month"), F.year("ts").alias("y"), C.month_of(F.add_months(F.col("ts").cast("date"), 1)).alias("next_month"))


@query("f18_f20_f25_math", f"WITH {MESSAGES} SELECT post_id, prob_positive - prob_negative AS net, value * num_comments AS dollar_volume, CASE WHEN post_id % 3 = 0 THEN 'never' WHEN post_id % 200 <= 35 THEN 'fresh' WHEN post_id % 200 <= 120 THEN 'late' ELSE 'stale' END AS band FROM msgs", ["net", "dollar_volume"])
def f18(spark, sf):
    age = F.when(F.col("post_id") % 3 != 0, F.col("post_id") % 200)
    return messages(spark, sf).select("post_id", (F.col("prob_positive") - F.col("prob_negative")).alias("net"), (F.col("value") * F.col("num_comments")).alias("dollar_volume"), C.staleness_band(age).alias("band"))


@query("f22_f23_text_stats", "WITH d AS (SELECT text AS t FROM documents UNION ALL SELECT CASE WHEN doc_id % 20 = 0 THEN ' ' ELSE ' NaN ' END FROM documents WHERE doc_id % 10 = 0), e AS (SELECT t, t IS NULL OR trim(t) = '' OR lower(trim(t)) = 'nan' AS blank FROM d) SELECT count(*) FILTER (WHERE blank) AS n_empty, avg(CASE WHEN blank THEN 0 ELSE length(t) END) AS mean_length FROM e", ["mean_length"])
def f22(spark, sf):
    """All texts, and blank rows beside them."""
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    k = F.col("doc_id")
    d = d.select("t").unionAll(d.where(k % 10 == 0).select(F.when(k % 20 == 0, " ").otherwise(" NaN ").alias("t")))
    return d.agg(F.count_if(C.is_blank(F.col("t"))).alias("n_empty"), F.avg(F.when(C.is_blank(F.col("t")), 0).otherwise(F.length("t"))).alias("mean_length"))


@query("f24_suffix_class", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'crypto' ELSE 'equity' END AS kind FROM nation")
def f24(spark, sf):
    s = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "-X").otherwise(""))
    return read(spark, sf, "nation").select("n_nationkey", F.when(s.endswith("-X"), "crypto").otherwise("equity").alias("kind"))


_LEX = "(VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in (("the", 1.0), ("of", -0.5), ("and", 0.25))) + ")"


@query("x3_lexicon_scores", f"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z'']+')) AS word FROM documents), s AS (SELECT doc_id, sum(x.weight) AS x FROM w JOIN {_LEX} x(word, weight) ON w.word = x.word GROUP BY 1) SELECT doc_id, coalesce(x, 0) / sqrt(coalesce(x, 0) * coalesce(x, 0) + 15) AS compound FROM documents LEFT JOIN s USING (doc_id)", ["compound"])
def x3(spark, sf):
    lexicon = spark.createDataFrame([("the", 1.0), ("of", -0.5), ("and", 0.25)], "word string, weight double")
    return T.lexicon_scores(read(spark, sf, "documents"), "doc_id", "text", lexicon)


_LABELLED = "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END"
_ODDS = "ln((p + 0.5::DOUBLE) / (np - p + 0.5::DOUBLE)) - ln((q + 0.5::DOUBLE) / (m - np - q + 0.5::DOUBLE))"
_BUCKETS = "list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: trim(w, '.,!?')), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 4))::INTEGER))"


@query("x2_f19_batched_scorer", f"""WITH d AS (SELECT doc_id, 'text' AS variant, text FROM documents UNION ALL SELECT doc_id, 'blank', '  ' FROM documents), b AS (SELECT doc_id, variant, unnest({_BUCKETS}) AS bucket FROM d),
 l AS (SELECT doc_id, {_LABELLED} AS label FROM labels JOIN documents USING (doc_id)), k AS (SELECT unnest(['positive', 'negative', 'neutral']) AS label), n AS (SELECT k.label, count(l.label) AS np, (SELECT count(*) FROM l) AS m FROM k LEFT JOIN l USING (label) GROUP BY 1),
 c AS (SELECT bucket, label, count(*) AS p FROM b JOIN l USING (doc_id) WHERE variant = 'text' GROUP BY 1, 2), t AS (SELECT bucket, sum(p) AS t FROM c GROUP BY 1),
 o AS (SELECT t.bucket, n.label, coalesce(p, 0) AS p, t - coalesce(p, 0) AS q, np, m FROM t CROSS JOIN n LEFT JOIN c ON c.bucket = t.bucket AND c.label = n.label), z AS (SELECT bucket, label, {_ODDS} AS odds, ({_ODDS}) ** 2 / (1 / (p + 0.5::DOUBLE) + 1 / (q + 0.5::DOUBLE)) AS z2 FROM o),
 s AS (SELECT doc_id, variant, label, sum(odds * z2 * z2 / (z2 * z2 + 900)) AS x FROM b JOIN z USING (bucket) GROUP BY 1, 2, 3),
 g AS (SELECT doc_id, variant, n.label, ln((np + 0.5::DOUBLE) / (m + 1.5::DOUBLE)) + coalesce(x, 0) AS x FROM d CROSS JOIN n LEFT JOIN s USING (doc_id, variant, label)), w AS (SELECT doc_id, variant, max(x) FILTER (WHERE label = 'positive') AS a, max(x) FILTER (WHERE label = 'negative') AS b, max(x) FILTER (WHERE label = 'neutral') AS c FROM g GROUP BY 1, 2),
 e AS (SELECT doc_id, variant, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM w), f AS (SELECT e.*, regexp_full_match(coalesce(d.text, ''), '\\s*') AS blank FROM e JOIN d USING (doc_id, variant))
 SELECT doc_id, variant, CASE WHEN blank THEN 0 ELSE a / (a + b + c) END AS pos, CASE WHEN blank THEN 0 ELSE b / (a + b + c) END AS neg, CASE WHEN blank THEN 1 ELSE c / (a + b + c) END AS neu FROM f""", ["pos", "neg", "neu"])
def x2(spark, sf):
    """A model fitted to the labelled documents scores every whole text, and a blank one beside each."""
    documents = read(spark, sf, "documents").select("doc_id", "text")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    model = fit_text_model(labelled_texts(documents, read(spark, sf, "labels").select("doc_id", label.alias("label")), "doc_id"))
    d = documents.withColumn("variant", F.explode(F.array(F.lit("text"), F.lit("blank")))).withColumn("text", F.when(F.col("variant") == "text", F.col("text")).otherwise("  "))
    scored = d.withColumn("s", T.scorer_udf(model.loader(d))(F.col("text")))
    return scored.select("doc_id", "variant", F.col("s.prob_positive").alias("pos"), F.col("s.prob_negative").alias("neg"), F.col("s.prob_neutral").alias("neu"))


@query("s6_x6_dump_rows", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name || ' it''s, (ok)' AS name, NULL::VARCHAR AS missing FROM nation")
def s6(spark, sf):
    tup = F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(",'"), "n_name", F.lit(" it\\'s, (ok)',NULL)"))
    lines = read(spark, sf, "nation").groupBy((F.col("n_nationkey") % 4).alias("g")).agg(F.concat(F.lit("INSERT INTO `t` VALUES "), F.array_join(F.collect_list(tup), ","), F.lit(";")).alias("value"))
    return dump_rows(lines, "value", {"key": 0, "name": 1, "missing": 2})


@query("s18_html_universe", "SELECT replace(n_name, '.', '-') AS ticker FROM nation")
def s18(spark, sf):
    rows = F.concat(F.lit("<tr><td><a href='x'>"), "n_name", F.lit("</a></td><td>y</td></tr>"))
    page = read(spark, sf, "nation").agg(F.concat(F.lit('<html><table id="constituents"><tr><th>Symbol</th></tr>'), F.array_join(F.collect_list(rows), ""), F.lit("</table></html>")).alias("html"))
    return html_universe(page)


@query("g2_s12_run_logs", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'CLOSE' END AS action, o_totalprice AS notional FROM orders", ["notional"])
def g2(spark, sf):
    order = F.struct("o_orderkey", F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("CLOSE").alias("action"), F.col("o_totalprice").alias("notional"))
    logs = read(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(order).alias("orders"))).alias("doc"))
    parsed = logs.select(F.from_json("doc", "orders array<struct<o_orderkey:bigint, action:string, notional:double>>").alias("d"))
    return parsed.select(F.explode("d.orders").alias("o")).select("o.*")
