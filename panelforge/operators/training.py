"""Models over time: boosted trees, walk-forward and yearly folds, importance, feature sets, persistence."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import stats as T
from panelforge.operators import boosting
from panelforge.operators.boosting import Params, Trees
from panelforge.operators.portfolio import temporal_split

#: fit(train, validation) gives a function that adds proba.
Fit = Callable[[DataFrame, DataFrame | None], Callable[[DataFrame], DataFrame]]


def train_trees(train: DataFrame, features: list[str], label: str = "target", rounds: int = 500, depth: int = 6, seed: int = 42, validation: str | None = None, step: float = 0.05, **more) -> Trees:
    """Boosted trees on nullable features; with a validation column (true: not trained on) rounds stop when it gets no better."""
    return boosting.train(train, features, label, validation, Params(rounds=rounds, depth=depth, seed=seed, step=step, **more))


def predict(model: Trees, rows: DataFrame, features: list[str]) -> DataFrame:
    scored = boosting.predict(model, rows)
    return scored.select(*[c for c in rows.columns if c not in features], "proba")


def boosted(features: list[str], label: str = "target", **params) -> Fit:
    """A fit of train_trees that stops early on the validation rows, where there are enough of both classes."""

    def fit(train: DataFrame, validation: DataFrame | None):
        if validation is None:
            model = train_trees(train, features, label, **params)
        else:
            both = train.withColumn("is_validation", F.lit(False)).unionByName(validation.withColumn("is_validation", F.lit(True)))
            model = train_trees(both, features, label, validation="is_validation", **params)
        return lambda rows: predict(model, rows, features)

    return fit


def group_rates(key: str, label: str = "target", default: float = 0.5) -> Fit:
    """The plainest model: a group's share of label 1 in the training rows. Serves as the floor that others must beat."""

    def fit(train: DataFrame, validation: DataFrame | None):
        rates = train.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("gr_rate"))
        return lambda rows: rows.join(rates, key, "left").withColumn("proba", F.coalesce("gr_rate", F.lit(default))).drop("gr_rate")

    return fit


def walk_forward(panel: DataFrame, features: list[str], label: str = "target", first: float = 0.5, fit: Fit | None = None, **params) -> DataFrame:
    """Train once on the first share of dates, predict every later row: (ticker, date, label, proba, pred)."""
    split = temporal_split(panel, test=1 - first, validation=0.0)
    score = (fit or boosted(features, label, **params))(split.where("split <> 'test'"), None)
    scored = score(split.where("split = 'test'"))
    return scored.select("ticker", "date", label, "proba", (F.col("proba") >= 0.5).cast("int").alias("pred"))


def year_folds(first: int, test_years: list[int]) -> list[dict]:
    """Expanding folds: train from the first year to t - 2, validate on t - 1, test on t."""
    return [{"first": first, "last": t - 2, "val": t - 1, "test": t} for t in test_years]


def usable_folds(panel: DataFrame, folds: list[dict], label: str = "target", date: str = "date", least_train: int = 50, least_test: int = 20) -> list[dict]:
    """Folds with enough training and test rows and both classes to train on; use_val: enough of both classes to validate on.

    One aggregate gives a row for each year; the rest is arithmetic on those.
    """
    years = {r.year: (r.n, r.pos) for r in panel.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos")).collect()}
    out = []
    for fold in folds:
        train = [v for y, v in years.items() if fold["first"] <= y <= fold["last"]]
        n, pos = sum(v[0] for v in train), sum(v[1] for v in train)
        val_n, val_pos = years.get(fold["val"], (0, 0))
        if n >= least_train and 0 < pos < n and years.get(fold["test"], (0, 0))[0] >= least_test:
            out.append(fold | {"use_val": val_n >= least_test and 0 < val_pos < val_n})
    return out


def evaluate_folds(panel: DataFrame, folds: list[dict], fit: Fit, label: str = "target", date: str = "date") -> DataFrame:
    """(test_year, ticker, date, label, proba) of all usable folds; a loop over a handful of years."""
    year = F.year(date)
    out = None
    for fold in usable_folds(panel, folds, label, date):
        train = panel.where(year.between(fold["first"], fold["last"]))
        score = fit(train, panel.where(year == fold["val"]) if fold["use_val"] else None)
        one = score(panel.where(year == fold["test"])).select(F.lit(fold["test"]).alias("test_year"), "ticker", date, label, "proba")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no fold has enough rows of both classes")
    return out


def fold_metrics(predictions: DataFrame, label: str = "target") -> DataFrame:
    """Per test year: rows, AUC (null with one class), accuracy, precision and recall of class 1 (0 where undefined)."""
    pred = F.col("proba") >= 0.5
    hit = (F.col(label) == 1) & pred
    share = lambda a, b: F.coalesce(F.try_divide(F.count_if(a).cast("double"), F.count_if(b)), F.lit(0.0))
    base = predictions.groupBy("test_year").agg(F.count(F.lit(1)).alias("n_test"), F.avg((pred == (F.col(label) == 1)).cast("double")).alias("accuracy"), share(hit, pred).alias("precision"), share(hit, F.col(label) == 1).alias("recall"))
    return base.join(T.auc(predictions, "proba", label, ["test_year"]).select("test_year", "auc"), "test_year", "left")


def summarise(metrics: DataFrame, over: float = 0.53) -> DataFrame:
    """One row: means over folds, and how many folds have an AUC over the mark."""
    return metrics.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("auc").alias("auc_mean"), F.avg("accuracy").alias("acc_mean"), F.avg("precision").alias("prec_mean"), F.avg("recall").alias("rec_mean"), F.count_if(F.col("auc") > over).alias("folds_over"), F.count("auc").alias("n_aucs"))


def feature_sets(groups: dict[str, list[str]], all_but: list[str] | None = None) -> dict[str, list[str]]:
    """Named model variants: each group alone, all together, and all without each group of all_but."""
    out = dict(groups)
    out["all"] = [c for columns in groups.values() for c in columns]
    for name in all_but or []:
        out[f"all_but_{name}"] = [c for g, columns in groups.items() if g != name for c in columns]
    return out


def compare_models(panel: DataFrame, variants: dict[str, Fit], folds: list[dict], label: str = "target") -> DataFrame:
    """(name, n_folds, auc_mean, ...): the fold summary of every variant."""
    out = None
    for name, fit in variants.items():
        one = summarise(fold_metrics(evaluate_folds(panel, folds, fit, label), label)).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def importance(model: Trees, features: list[str]) -> list[dict]:
    """Per feature, strongest first: mean gain and mean cover of its splits, their number, and gain by the sum of gains."""
    return [r for r in boosting.importance(model) if r["feature"] in features]


def save_model(model: Trees, path: str, features: list[str], split: dict) -> None:
    """The model, its feature names and split as JSON, and its importance as CSV, under one folder that Spark can write."""
    spark = SparkSession.active()
    for name, text in (("model", model.to_json()), ("metadata", json.dumps({"features": features, "split": split}))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    rows = spark.createDataFrame(importance(model, features), "feature string, gain double, weight long, cover double, gain_normalized double")
    rows.coalesce(1).orderBy(F.col("gain").desc(), "feature").write.mode("overwrite").csv(f"{path}/importance", header=True)


def load_model(spark: SparkSession, path: str):
    """(model, features, split)."""
    about = json.loads(spark.read.text(f"{path}/metadata").first().value)
    return Trees.from_json(spark.read.text(f"{path}/model").first().value), about["features"], about["split"]
