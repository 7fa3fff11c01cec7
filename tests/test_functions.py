import html
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import columns as C
from panelforge.functions import series, stats
from panelforge.functions import text as T
from panelforge.operators import sentiment as S

UNIVERSE = ["AAPL", "TSLA", "NVDA", "AMD", "MSFT", "IT", "SO", "ON", "BRK-B", "A"]
DEMOS = [
    ("$TSLA to the moon \U0001F680 also buying some $AAPL calls", ["AAPL", "TSLA"]), ("NVDA earnings tomorrow, loading up on GME too", ["NVDA"]),
    ("IT is what it is, SO tired of losing money ON options", []), ("BRK.B looking strong, added to my position", []),
    ("what do you think about A stock? it is really good", []), ("YOLO all in on AMD and MSFT calls expiring Friday", ["AMD", "MSFT"]),
]


def test_detect_demos(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DEMOS)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.detect_tickers(F.col("t"), F.array(*[F.lit(u) for u in UNIVERSE])).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(DEMOS)}


def test_clean_text_properties(spark):
    df = spark.createDataFrame([(1, "> q\n**Bold** &amp; https://a.b/c $TSLA \U0001F680 Not financial advice! unfair"), (2, None)], "i int, t string")
    got = {r.i: r.clean_text for r in T.clean_text(df, "t").collect()}
    assert got[2] == "" and "http" not in got[1] and "**" not in got[1] and "advice" not in got[1] and "tsla" in got[1] and "  " not in got[1] and got[1].isascii()
    assert "u ir" in got[1]  # nfa has no word boundaries


def pandas_momentum(x):
    step = x.diff().fillna(0)
    up, down = step.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-step.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    rsi = (100 - 100 / (1 + up / down)).where(down > 0, 100.0)
    line = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    signal = line[25:].ewm(span=9, adjust=False).mean()
    out = pd.DataFrame({"rsi": rsi, "macd": line, "macd_signal": signal, "macd_hist": line - signal})
    for name, warm in (("rsi", 13), ("macd", 25), ("macd_signal", 33), ("macd_hist", 33)):
        out.loc[out.index < warm, name] = np.nan
    return out if len(x) >= 26 else out * np.nan


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_momentum_in_blocks_against_pandas(spark, size):
    """Series of several lengths, one with gaps, one constant, one far from zero: blocks of any size give what pandas gives."""
    rng = np.random.default_rng(1)
    walks = {"long": rng.normal(0, 1, 1500).cumsum() + 500, "flat": np.full(60, 5.0), "far": rng.normal(0, 1, 300).cumsum() + 1e9, "short": rng.normal(0, 1, 25) + 9, "ready": rng.normal(0, 1, 34) + 9}
    rows = [(t, i * 3, float(v)) for t, x in walks.items() for i, v in enumerate(x)] + [("long", 1, None), ("flat", 2, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "ticker string, date int, close double")
    got = series.with_momentum(df, block=F.floor(F.col("date") / size)).toPandas().sort_values("date")
    assert len(got) == len(rows) and got[got.close.isna()].iloc[:, 3:].isna().all(axis=None)
    for t, x in walks.items():
        own = got[(got.ticker == t) & got.close.notna()]
        want = pandas_momentum(pd.Series(x))
        for name in want:
            assert np.allclose(own[name], want[name], rtol=1e-6, atol=1e-6 if t != "far" else 1e-3, equal_nan=True), (t, name)


def test_momentum_is_spread_and_native(spark):
    """No Python worker, and no exchange of rows by ticker alone."""
    df = spark.range(1000).select(F.lit("a").alias("ticker"), F.col("id").alias("date"), F.rand(1).alias("close"))
    plan = series.with_momentum(df, block=F.floor(F.col("date") / 50))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning(ticker" in plan
    assert "date" not in " ".join(line for line in plan.split("\n") if "Window" in line and "es_block" not in line and "es_end" not in line)


def test_no_look_ahead(spark):
    rows = [("a", i, float(50 + (i * 7) % 11)) for i in range(60)]
    full = spark.createDataFrame(rows, "ticker string, date int, close double")
    cut = full.where("date < 40")
    block = F.floor(F.col("date") / 16)
    a = {r.date: r for r in series.with_momentum(full, block=block).where("date < 40").collect()}
    b = {r.date: r for r in series.with_momentum(cut, block=block).collect()}
    assert all(x == y or (x is None) == (y is None) for d in b for x, y in zip(a[d], b[d], strict=True))


def test_p_values():
    assert stats.t_upper(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert stats.t_upper(-1.0, 5) == pytest.approx(1 - 0.181609, abs=1e-6)
    assert stats.wilcoxon_upper(15, 5, 0, True) == pytest.approx(1 / 32)


def test_paired_test(spark):
    df = spark.createDataFrame([(0.1 * i + 0.05, 0.1 * i) for i in range(1, 9)] + [(1.0, 1.01)], "a double, b double")
    out = stats.paired_test(df, "a", "b")
    assert out["n_paired_obs"] == 9 and out["significant_005"] and out["p_value_wilcoxon"] < 0.05


def test_greedy_cap(spark):
    rows = [(1, "d", ["A", "B"]), (2, "d", ["A"]), (3, "d", ["A", "C"]), (4, "d", ["B"]), (4, "d", ["B"]), (5, "d", [])]
    got = sorted(r.post_id for r in S.greedy_cap(spark.createDataFrame(rows, "post_id int, date string, tickers array<string>"), 1).collect())
    assert got == [1, 3]


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "x")], "id int, message string")
    assert C.resolve_aliases(df, {"post_id": ["id"], "body": ["body", "message"], "score": ["score"]}, ("score",)).columns == ["post_id", "body"]
    with pytest.raises(ValueError):
        C.require_columns(df, {"missing"})
    assert C.detect_format(["id", "body", "symbols"]) == "stocktwits" and C.detect_format(["id", "title"]) == "reddit"


def test_hac_matches_plain_mean():
    y = np.array([0.1, -0.2, 0.3, 0.05] * 6)
    alpha, t = stats.ols_hac(y, np.zeros((24, 0)), lags=0)
    assert alpha == pytest.approx(y.mean()) and t == pytest.approx(y.mean() / np.sqrt(((y - y.mean()) ** 2).sum()) * 24)
    assert stats.ols_hac(y[:5], np.zeros((5, 0))) == (None, None)


def test_detection_reads_whole_texts(spark, tmp_path):
    from panelforge.plans import registry

    rows = [(1, "word " * 2000 + "then $AMD and $ZZZ"), (2, None), (3, "plain words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    f6, f9 = ({r.doc_id: set(r.tickers) for r in registry.queries()[n](spark, str(tmp_path)).collect()} for n in ("f6_f7_f8_detect", "f9_title_cashtags"))
    assert "AMD" in f6[1] and "ZZZ" not in f6[1] and all("AMD" not in f6[i] and "TSLA" in f6[i] for i in (2, 3))
    assert {"AMD", "ZZZ"} <= f9[1] and not {"AMD", "ZZZ"} & (f9[2] | f9[3])


@pytest.mark.parametrize("few", [0, 5, 4096])
def test_group_quantiles_against_numpy(spark, few):
    """Groups of one value, of ties, of many magnitudes and both signs; a null key is a group, nulls and NaN do not count."""
    rng = np.random.default_rng(2)
    groups = {"one": [3.0], "ties": [2.0] * 50 + [5.0], "wide": (rng.standard_normal(300) * 10.0 ** rng.integers(-200, 200, 300)).tolist(), "near": (1e9 + rng.random(300)).tolist(), "zero": [0.0, -0.0, 1e-300, -1e-300], None: [1.0, 4.0]}
    rows = [(k, v) for k, x in groups.items() for v in x] + [("one", None), ("one", float("nan")), ("gone", None)]
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: (r.n_rows, [r[f"q{i}"] for i in range(len(probs))]) for r in stats.group_quantiles(df, ["k"], "x", probs, bins=16, few=few).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k][0] == len(x) and np.allclose(got[k][1], np.quantile(x, probs), rtol=1e-12), k
    whole = [v for x in groups.values() for v in x]
    assert np.allclose(stats.exact_quantiles(df, "x", probs), np.quantile(whole, probs), rtol=1e-12)
    assert stats.exact_quantiles(df.where("x is null"), "x", [0.5]) == [None]


def test_entities_without_texts_in_python(spark):
    """Entities equal those of html.unescape, and only they are given to Python."""
    texts = ["", "no", "&", "&&amp;&", "a &amp; b &lt;&gt;&#65;&#x41;&#X41 &notit; &amp &ampx; &bogus; &#0; &#1114112; end&", "&quot;é\n&hearts;&hearts;&nbsp", "&" + "x" * 40 + ";", "&amp;amp;", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = df.select("i", T.unescaped(F.col("t")).alias("u"))
    assert {r.i: r.u for r in found.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    plan = T.clean_text(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "unescape(regexp_extract_all(" in plan and "Union" not in plan
