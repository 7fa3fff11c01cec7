"""Models, folds, caps and rank statistics against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import stats as T
from panelforge.functions import text as X
from panelforge.operators import panel as P
from panelforge.operators import sentiment as S
from panelforge.operators import training as L


def test_value_ranks_and_quantiles(spark):
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate((rng.normal(0, 1, 3000), np.full(3000, 0.5))), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = {r.value: (r.before, r.n) for r in T.value_ranks(df, "x", bins=16).collect()}
    assert got == {v: (int((x < v).sum()), int((x == v).sum())) for v in set(x.tolist())}
    assert T.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.93, 1.0]) == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.93, 1.0]).tolist())
    assert T.exact_quantiles(df.limit(0), "x", [0.5]) == [None]
    pairs = pd.DataFrame({"x": x, "y": np.round(x + rng.normal(0, 1, len(x)), 1)})
    rho = T.spearman(spark.createDataFrame(pairs), [("x", "y")]).first().rho
    assert rho == pytest.approx(pairs.x.rank().corr(pairs.y.rank()))
    y = (rng.uniform(size=len(x)) < 0.4).astype(int)
    auc = T.auc(spark.createDataFrame(pd.DataFrame({"s": x, "y": y})), "s", "y").first().auc
    r = pd.Series(x).rank().to_numpy()
    assert auc == pytest.approx((r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum())))
    constant = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert T.spearman(constant, [("x", "y")]).first().rho is None


def test_alpha_on_three_factors(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(0, 0.03, (60, 3))
    y = 0.01 + f @ [0.5, -0.2, 0.1] + rng.normal(0, 0.01, 60)
    months = pd.date_range("2015-01-01", periods=60, freq="MS")
    factors = pd.DataFrame(f, columns=["mkt_rf", "smb", "hml"]).assign(month=months)
    got = T.alpha(spark.createDataFrame(pd.DataFrame({"month": months, "ret": y})), spark.createDataFrame(factors)).first()
    x = np.column_stack([np.ones(60), f])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    u = (y - x @ beta)[:, None] * x
    s = u.T @ u + sum((1 - k / 4) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in (1, 2, 3))
    inv = np.linalg.inv(x.T @ x)
    assert (got.alpha, got.t, got.n) == (pytest.approx(beta[0]), pytest.approx(beta[0] / np.sqrt((inv @ s @ inv)[0, 0])), 60)
    short = T.alpha(spark.createDataFrame(pd.DataFrame({"month": months[:8], "ret": y[:8]})), spark.createDataFrame(factors)).first()
    assert short.alpha is None


def plain_cap(rows, cap):
    seen, bucket, kept = set(), {}, []
    for k, (pid, date, tickers) in enumerate(rows):
        if pid in seen or not any(bucket.get((t, date), 0) < cap for t in tickers):
            continue
        seen.add(pid)
        for t in tickers:
            bucket[t, date] = bucket.get((t, date), 0) + 1
        kept.append(k)
    return kept


def test_greedy_cap_in_order_of_arrival(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(150), f"d{rng.randrange(6)}", rng.sample("ABCDE", rng.choice([0, 1, 2, 3]))) for _ in range(400)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, post_id int, date string, tickers array<string>")
    got = sorted(r.k for r in S.greedy_cap(df, 8, order=["k"]).collect())
    assert got == plain_cap(rows, 8)


def test_cap_resumed_equals_one_run(spark):
    df = spark.createDataFrame([(f"t{i % 3}", i) for i in range(60)], "ticker string, post_id int")
    first = S.cap_per_group(df.where("post_id < 20"), ["ticker"], ["post_id"], 10)
    more = S.cap_resumed(df, first, ["ticker"], ["post_id"], 10)
    once = S.cap_per_group(df, ["ticker"], ["post_id"], 10)
    assert sorted(map(tuple, first.union(more).collect())) == sorted(map(tuple, once.collect()))


def test_compound_scores(spark):
    lexicon = {"good": 2.0, "bad": -2.0}
    texts = ["good", "not good", "very good", "slightly good", "very, very bad!!", "good??", "good????", "nothing here", "", None, "GOOD!!!!!!"]
    got = [r.compound for r in X.compound_scores(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", lexicon).orderBy("i").collect()]
    def norm(x):
        return x / (x * x + 15) ** 0.5
    want = [2, -2 * 0.74, 2.293, 2 - 0.293, -(2 + 0.293 * 1.95) - 2 * 0.292, 2.36, 2.96, 0, 0, 0, 2 + 4 * 0.292]
    assert got == pytest.approx([norm(x) for x in want])


def test_permute_all_is_a_permutation(spark):
    df = spark.range(500).select("id", (F.col("id") * 3).alias("x"))
    got = P.permute_all(df, ["x"], "id").collect()
    assert sorted(r.x for r in got) == [3 * i for i in range(500)] and sum(r.x == 3 * r.id for r in got) < 10


def _panel(spark, n=900):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=n), rng.normal(size=n)
    rows = pd.DataFrame({"ticker": "T", "date": pd.date_range("2015-01-01", periods=n), "a": a, "b": np.where(rng.uniform(size=n) < 0.3, np.nan, b), "target": (a + rng.normal(0, 0.3, n) > 0).astype(int)})
    rows["date"] = rows["date"].dt.date
    return spark.createDataFrame(rows)


def test_trees_folds_importance_persistence(spark, tmp_path):
    panel = _panel(spark)
    out = L.walk_forward(panel, ["a", "b"], rounds=5, depth=2)
    right = out.agg(F.avg((F.col("pred") == F.col("target")).cast("int"))).first()[0]
    assert out.count() == 450 and right > 0.8
    folds = L.usable_folds(panel, L.year_folds(2015, [2017, 2018, 2030]))
    assert [f["test"] for f in folds] == [2017]  # 2018 has no rows, 2030 neither
    assert folds[0]["use_val"]
    pred = L.evaluate_folds(panel, folds, L.boosted(["a", "b"], rounds=5, depth=2))
    m = L.fold_metrics(pred).first()
    assert m.auc > 0.85 and L.summarise(L.fold_metrics(pred)).first().folds_over == 1
    one_class = panel.withColumn("target", F.lit(1))
    assert L.usable_folds(one_class, L.year_folds(2015, [2017])) == []
    model = L.train_trees(panel, ["a", "b"], rounds=3, depth=2)
    report = L.importance(model, ["a", "b"])
    assert report[0]["feature"] == "a" and sum(r["gain_normalized"] for r in report) == pytest.approx(1) and report[0]["weight"] >= 3
    L.save_model(model, str(tmp_path / "m"), ["a", "b"], {"train": 10})
    again, features, split = L.load_model(spark, str(tmp_path / "m"))
    same = [[r.proba for r in L.predict(x, panel, features).orderBy("date").collect()] for x in (model, again)]
    assert same[0] == same[1] and split == {"train": 10}
    assert L.feature_sets({"x": ["a"], "y": ["b"]}, ["x"]) == {"x": ["a"], "y": ["b"], "all": ["a", "b"], "all_but_x": ["b"]}


def test_average_ranks_in_parts(spark):
    """Ranks of values meet the rows in a join: no window holds a part, nulls stand last, null parts count."""
    rng = np.random.default_rng(6)
    x = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000, p=[0.9, 0.09, 0.01]), "x": np.round(rng.normal(0, 2, 3000), 1)})
    x.loc[::97, "x"], x.loc[::101, "g"] = np.nan, None
    rows = [(i, None if g is None or g != g else g, None if v != v else float(v)) for i, (g, v) in enumerate(zip(x.g, x.x, strict=True))]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    found = T.average_ranks(df, "x", ["g"], "r")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    want = x.groupby(x.g.fillna("none")).x.rank(na_option="bottom")
    assert {r.i: r.r for r in found.collect()} == want.to_dict()
    whole = spark.createDataFrame([(1, 2**62), (2, 2**62 + 1), (3, 2**62 + 1)], "i int, x long")
    assert {r.i: r.r for r in T.average_ranks(whole, "x", [], "r").collect()} == {1: 1.0, 2: 2.5, 3: 2.5}
