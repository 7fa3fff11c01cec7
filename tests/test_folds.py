"""Folds in one pass against separate fits and plain loops."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import folds as K
from panelforge.operators import training as L


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    n = 1800
    d = pd.DataFrame({"ticker": rng.choice(["A", "B", "C", None], n), "date": [datetime.date(2010, 1, 1) + datetime.timedelta(days=int(i)) for i in rng.integers(0, 365 * 6, n)], "a": rng.normal(size=n), "b": rng.normal(size=n)})
    d["target"] = (d.a - 0.5 * d.b + 0.4 * (d.ticker == "A") + rng.normal(0, 1, n) > 0).astype(int)
    return d


def _newton(x, y, penalty=0.0, steps=60):
    beta, ridge = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, penalty)]
    for _ in range(steps):
        q = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.pinv((x.T * (q * (1 - q))) @ x + np.diag(ridge)) @ (x.T @ (y - q) - ridge * beta)
    return beta


def test_rates_equal_separate_fits(spark, rows):
    panel, folds = spark.createDataFrame(rows), L.year_folds(2010, [2012, 2013, 2015, 2020])
    panel = panel.withColumn("late", F.when(F.year("date") >= 2013, F.lit("x")).otherwise("y"))
    got = {(r.name, r.test_year): r for r in K.rate_folds(panel, ["ticker", "late"], folds).collect()}
    assert {t for _, t in got} == {2012, 2013, 2015}
    for key in ("ticker", "late"):
        for r in L.fold_metrics(L.evaluate_folds(panel, folds, L.group_rates(key))).collect():
            one = got[key, r.test_year]
            assert one.n_test == r.n_test and [one.accuracy, one.precision, one.recall, one.auc] == pytest.approx([r.accuracy, r.precision, r.recall, r.auc])


def test_rates_read_the_panel_once(spark, rows, tmp_path):
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "p"))
    panel = spark.read.parquet(str(tmp_path / "p")).withColumn("month", F.month("date"))
    counts = K.rate_folds(panel, ["ticker", "month"], L.year_folds(2010, [2012, 2013, 2014, 2015]))
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") - final.count("ReusedExchange") <= 1


def test_rates_edges(spark):
    schema = "ticker string, date date, target int"
    folds = L.year_folds(2010, [2012])
    assert K.rate_folds(spark.createDataFrame([], schema), ["ticker"], folds).collect() == []
    day = lambda y: datetime.date(y, 5, 1)
    mixed = [(None, day(2010), i % 2) for i in range(60)] + [("A", day(2010), 1)] * 5 + [("A", day(2012), 1)] * 10 + [(None, day(2012), 0)] * 10 + [("new", day(2012), None)] * 9 + [("A", None, 1)]
    r = K.rate_folds(spark.createDataFrame(mixed, schema), ["ticker"], folds).first()
    assert (r.n_test, r.accuracy, r.auc) == (20, 0.5, 1.0)  # the null group scores 0.5, which calls class 1
    one_class = [("A", day(2010), 1)] * 60 + [("A", day(2012), 1)] * 30
    assert K.rate_folds(spark.createDataFrame(one_class, schema), ["ticker"], folds).collect() == []
    with pytest.raises(ValueError):
        K.rate_folds(spark.createDataFrame(mixed, schema), ["ticker"], [])


@pytest.mark.parametrize("penalty", [0.0, 3.0])
def test_logistic_equals_separate_newton(spark, rows, penalty):
    d = rows.assign(same=2.0)
    folds = L.year_folds(2010, [2013, 2015])
    variants = {"one": ["a"], "both": ["b", "a"], "flat": ["a", "same"]}
    models = K.fit_logistic_folds(spark.createDataFrame(d), variants, folds, penalty=penalty)
    assert len(models) == 6
    year = pd.to_datetime(d.date).dt.year
    scored = {}
    for m in models:
        train = d[(year >= m.fold["first"]) & (year <= m.fold["last"])]
        names = [c for c in m.weights if c]
        x = np.c_[np.ones(len(train)), train[names].to_numpy()]
        want = _newton(x, train.target.to_numpy(), penalty)
        assert 1 / (1 + np.exp(-x @ np.array([m.weights[c] for c in ["", *names]]))) == pytest.approx(1 / (1 + np.exp(-x @ want)), abs=1e-7)
        test = d[year == m.fold["test"]]
        scored[m.name, m.fold["test"]] = np.sort(1 / (1 + np.exp(-np.c_[np.ones(len(test)), test[names].to_numpy()] @ want)))
    out = K.predict_logistic_folds(spark.createDataFrame(d), models, ["target", "date"]).toPandas()
    for key, want in scored.items():
        assert np.sort(out[(out.name == key[0]) & (out.test_year == key[1])].proba) == pytest.approx(want, abs=1e-7)


def test_logistic_odd_features(spark, rows):
    """Null and non-finite features count as 0, rows without label or date take no part, column names may clash."""
    d = rows.assign(x=rows.a.where(rows.index % 7 > 0), m=rows.b.where(rows.index % 11 > 0, np.inf))
    odd = spark.createDataFrame(d[["date", "target", "x", "m"]]).unionByName(spark.createDataFrame([(None, 1, 1.0, 1.0), (datetime.date(2011, 1, 1), None, 9.0, 9.0)], "date date, target int, x double, m double"))
    clean = spark.createDataFrame(d.assign(x=d.x.fillna(0.0), m=d.m.replace(np.inf, 0.0))[["date", "target", "x", "m"]])
    folds, variants = L.year_folds(2010, [2014]), {"v": ["x", "m"]}
    one, two = (K.fit_logistic_folds(t, variants, folds) for t in (odd, clean))
    assert list(one[0].weights.values()) == pytest.approx(list(two[0].weights.values()), abs=1e-7)
    assert K.predict_logistic_folds(odd, one, ["x", "m"]).columns == ["name", "test_year", "x", "m", "proba"]
    assert K.fit_logistic_folds(odd.where("1 = 0"), variants, folds) == []


def test_logistic_leaves_nothing_behind(spark, rows):
    from panelforge.storage import shared_dir

    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    count = lambda: len([f for f in fs.listStatus(folder) if "fold-design" in f.getPath().getName()])
    before = count()
    K.fit_logistic_folds(spark.createDataFrame(rows), {"v": ["a"]}, L.year_folds(2010, [2014]))
    assert count() == before
