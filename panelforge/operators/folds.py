"""Many models over yearly folds at once: every row is tagged with the folds it serves, so a step scans the panel once, whatever the number of variants and folds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.training import usable_folds
from panelforge.storage import discard, stored


def _literal(folds: list[dict]) -> Column:
    return F.array(*[F.struct(F.lit(f["test"]).alias("test_year"), F.lit(f["first"]).alias("first"), F.lit(f["last"]).alias("last")) for f in folds])


def counted_metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per group of (by, proba, n, pos): rows, accuracy, precision, recall of class 1 (0 where undefined) and exact AUC (null with one class).

    Rows with equal scores were added up before, so the window sees one row for each distinct score of a group.
    """
    hit, n, pos = F.col("proba") >= 0.5, F.col("n"), F.col("pos")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("proba").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_pos, n_neg = F.sum(pos), F.sum(n - pos)
    hits, called = F.sum(F.when(hit, pos).otherwise(0)), F.sum(F.when(hit, n).otherwise(0))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    above = F.sum(pos * (F.col("before") + (n + 1) / 2.0))
    return counts.where(n > 0).withColumn("before", before).groupBy(*by).agg(
        F.sum(n).alias("n_test"), share(F.sum(F.when(hit, pos).otherwise(n - pos)), F.sum(n)).alias("accuracy"), share(hits, called).alias("precision"), share(hits, n_pos).alias("recall"),
        F.try_divide(above - n_pos * (n_pos + 1) / 2.0, (n_pos * n_neg).cast("double")).alias("auc"),
    )


def prediction_metrics(predictions: DataFrame, label: str = "target", by: tuple[str, ...] = ("name", "test_year")) -> DataFrame:
    """counted_metrics of single predictions; those without a label or a score take no part."""
    known = predictions.where(F.col(label).isNotNull() & F.col("proba").isNotNull())
    return counted_metrics(known.groupBy(*by, "proba").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")), list(by))


def log_loss(predictions: DataFrame, label: str = "target", by: tuple[str, ...] = ("name", "test_year")) -> DataFrame:
    right = F.when(F.col(label) == 1, F.col("proba")).otherwise(1 - F.col("proba"))
    return predictions.where(F.col(label).isNotNull()).groupBy(*by).agg(F.avg(-F.log(right)).alias("log_loss"))


def rate_folds(panel: DataFrame, keys: list[str], folds: list[dict], label: str = "target", date: str = "date", default: float = 0.5, least_train: int = 50, least_test: int = 20) -> DataFrame:
    """(name, test_year, n_test, accuracy, precision, recall, auc) of the share of label 1 in each group of each key, over all usable folds.

    The panel is read once and only its counts by (key, group, year) are shuffled: fit, scores and metrics follow from those.
    Rows without a label or date take no part; a null group, and one without training rows, scores the default.
    Folds of too few rows, or with one class to train on, give no row.
    """
    if not folds:
        raise ValueError("no folds")
    groups = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias("group")) for k in keys])
    rows = panel.where(F.col(label).isNotNull() & F.col(date).isNotNull()).select(F.year(date).alias("year"), F.col(label).cast("long").alias("y"), F.explode(groups).alias("g"))
    counts = rows.groupBy("g.name", "g.group", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    trains = F.col("year").between(F.col("f.first"), F.col("f.last"))
    tests = F.col("year") == F.col("f.test_year")
    serves = F.filter(_literal(folds), lambda f: (F.col("year") == f.test_year) | F.col("year").between(f["first"], f["last"]))
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    per = counts.withColumn("f", F.explode(serves)).groupBy("name", "f.test_year", "group").agg(total("n", trains).alias("tn"), total("pos", trains).alias("tp"), total("n", tests).alias("n"), total("pos", tests).alias("pos"))
    rate = F.when(F.col("group").isNotNull(), F.try_divide(F.col("tp").cast("double"), F.col("tn")))
    scored = per.withColumn("proba", F.coalesce(rate, F.lit(default)))
    usable = scored.groupBy("name", "test_year").agg(F.sum("tn").alias("tn"), F.sum("tp").alias("tp"), F.sum("n").alias("n")).where((F.col("tn") >= least_train) & (F.col("tp") > 0) & (F.col("tp") < F.col("tn")) & (F.col("n") >= least_test)).select("name", "test_year")
    by_score = scored.groupBy("name", "test_year", "proba").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return counted_metrics(by_score, ["name", "test_year"]).join(usable, ["name", "test_year"])


@dataclass(frozen=True)
class FoldModel:
    """A logistic model of one variant and fold: weights by feature, the constant under the name of ''."""

    name: str
    fold: dict
    weights: dict[str, float]
    steps: int
    loss: float


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(F.abs(v) < float("inf"), v).otherwise(0.0)


def _logit(m: Column, p: int) -> Column:
    return reduce(add, [m["beta"][j] * F.col("x")[j] for j in range(p)])


def _models(betas: dict[int, tuple[dict, np.ndarray]]) -> Column:
    one = lambda i, f, b: F.struct(F.lit(i).alias("i"), F.lit(f["first"]).alias("first"), F.lit(f["last"]).alias("last"), F.lit(f["test"]).alias("test_year"), F.array(*[F.lit(float(v)) for v in b]).alias("beta"))
    return F.array(*[one(i, f, b) for i, (f, b) in betas.items()])


def fit_logistic_folds(panel: DataFrame, variants: dict[str, list[str]], folds: list[dict], label: str = "target", date: str = "date", steps: int = 25, near: float = 1e-9, penalty: float = 0.0) -> list[FoldModel]:
    """Logistic models of all variants and usable folds by Newton's method.

    Each step is one aggregate over a stored design (year, label, features): gradients and curvatures of all models that still move.
    What reaches the driver is bounded by models x features squared. A step that raises the loss is halved; a singular
    curvature (a constant or repeated feature) takes the step of least norm. Where classes can be told apart without error the
    weights grow until the steps end, unless there is a penalty (L2, not on the constant).
    Null and non-finite features count as 0; rows without a label or date take no part. Years of validation are not used.
    """
    features = sorted({c for columns in variants.values() for c in columns})
    p = len(features) + 1
    known = panel.where(F.col(label).isNotNull() & F.col(date).isNotNull())
    rows = stored(known.select(F.year(date).alias("year"), F.col(label).cast("double").alias("y"), F.array(F.lit(1.0), *[_finite(c) for c in features]).alias("x")), "fold-design")
    usable = usable_folds(rows.select(F.make_date("year", F.lit(1), F.lit(1)).alias("date"), F.col("y").cast("long").alias("target")), folds)
    plan = [(name, fold, [0] + [1 + features.index(c) for c in dict.fromkeys(columns)]) for name, columns in variants.items() for fold in usable]
    beta = {i: np.zeros(p) for i in range(len(plan))}
    last, loss, taken = {}, {}, dict.fromkeys(beta, 0)
    moving = set(beta)
    for _ in range(steps):
        if not moving:
            break
        got = _sums(rows, _models({i: (plan[i][1], beta[i]) for i in sorted(moving)}), p)
        for i, (n, total, gradient, curvature) in got.items():
            at = plan[i][2]
            ridge = np.r_[0.0, np.full(len(at) - 1, penalty)]
            total += float(ridge @ beta[i][at] ** 2) / 2
            if i in last and total > loss[i] + 1e-12 * abs(loss[i]):
                beta[i] = (beta[i] + last[i]) / 2
                continue
            last[i], loss[i] = beta[i], total
            move = np.zeros(p)
            move[at] = np.linalg.lstsq(curvature[np.ix_(at, at)] + np.diag(ridge), gradient[at] - ridge * beta[i][at], rcond=1e-12)[0]
            taken[i] += 1
            beta[i] = beta[i] + move
            if np.abs(move).max() <= near * max(1.0, np.abs(beta[i]).max()):
                moving.discard(i)
    discard(rows)
    return [FoldModel(name, fold, {("" if j == 0 else features[j - 1]): float(beta[i][j]) for j in at}, taken[i], loss.get(i, float("nan"))) for i, (name, fold, at) in enumerate(plan)]


def _sums(rows: DataFrame, models: Column, p: int) -> dict[int, tuple[int, float, np.ndarray, np.ndarray]]:
    """Per model: rows, loss, gradient and curvature over its training years."""
    tagged = rows.select("y", "x", F.explode(F.filter(models, lambda m: F.col("year").between(m["first"], m["last"]))).alias("m"))
    z = tagged.select("m.i", "y", "x", _logit(F.col("m"), p).alias("z")).withColumn("q", 1 / (1 + F.exp(-F.col("z"))))
    x, q = F.col("x"), F.col("q")
    upper = [(j, k) for j in range(p) for k in range(j, p)]
    loss = F.log1p(F.exp(-F.abs("z"))) + F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z")
    out = {}
    for r in z.groupBy("i").agg(F.count(F.lit(1)), F.sum(loss), F.array(*[F.sum(x[j] * (F.col("y") - q)) for j in range(p)]), F.array(*[F.sum(x[j] * x[k] * q * (1 - q)) for j, k in upper])).collect():
        curvature = np.zeros((p, p))
        for (j, k), v in zip(upper, r[4], strict=True):
            curvature[j, k] = curvature[k, j] = v
        out[r[0]] = (r[1], r[2], np.array(r[3]), curvature)
    return out


def predict_logistic_folds(panel: DataFrame, models: list[FoldModel], keep: list[str], date: str = "date") -> DataFrame:
    """(name, test_year, keep, proba): each row under every model that is tested on its year, in one scan."""
    if not models:
        raise ValueError("no fold has enough rows of both classes")
    features = sorted({c for m in models for c in m.weights if c})
    betas = {i: (m.fold, np.array([m.weights.get(c, 0.0) for c in ["", *features]])) for i, m in enumerate(models)}
    names = F.array(*[F.lit(m.name) for m in models])
    kept = [F.col(c).alias(f"pf_{i}") for i, c in enumerate(keep)]
    rows = panel.select(*kept, F.year(date).alias("pf_year"), F.array(F.lit(1.0), *[_finite(c) for c in features]).alias("x"))
    tagged = rows.withColumn("m", F.explode(F.filter(_models(betas), lambda m: F.col("pf_year") == m["test_year"])))
    proba = 1 / (1 + F.exp(-_logit(F.col("m"), len(features) + 1)))
    return tagged.select(names[F.col("m.i")].alias("name"), F.col("m.test_year"), *[F.col(f"pf_{i}").alias(c) for i, c in enumerate(keep)], proba.alias("proba"))


def summarise_by(metrics: DataFrame, over: float = 0.53) -> DataFrame:
    """Per variant: means over folds, and how many folds have an AUC over the mark."""
    return metrics.groupBy("name").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("auc").alias("auc_mean"), F.avg("accuracy").alias("acc_mean"), F.avg("precision").alias("prec_mean"), F.avg("recall").alias("rec_mean"), F.count_if(F.col("auc") > over).alias("folds_over"), F.count("auc").alias("n_aucs"))
