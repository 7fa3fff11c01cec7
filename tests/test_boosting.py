"""Boosted trees against a plain version over single rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting
from panelforge.operators.boosting import Params

FEATURES = ["a", "b", "c"]


def table(n=400, seed=7):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(-3, 4, n), rng.integers(0, 2, n)]).astype(float)
    y = (x[:, 0] + 2 * x[:, 1] + rng.normal(0, 3, n) > 6).astype(float)
    x[rng.random(n) < 0.15, 0] = np.nan
    x[(rng.random(n) < 0.3) & (y == 1), 1] = np.nan
    return x, y


def frame(spark, x, y, held=None):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r], int(t), bool(held[i]) if held is not None else False) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, target int, held boolean")


def plain_boosting(x, y, p):
    """Margins of each round, by trying every cut of every node row by row."""

    def soft(g):
        return math.copysign(max(abs(g) - p.l1, 0), g)

    def grow(rows, g, h, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        for f in range(x.shape[1]) if depth else ():
            v = x[rows, f]
            for cut in sorted(set(v[~np.isnan(v)])):
                for missing_left in (False, True):
                    left = np.where(np.isnan(v), missing_left, v <= cut)
                    sides = [rows[left], rows[~left]]
                    if min((h[s].sum() for s in sides)) < p.least_weight:
                        continue
                    gain = 0.5 * (sum(soft(g[s].sum()) ** 2 / (h[s].sum() + p.l2) for s in sides) - soft(gs) ** 2 / (hs + p.l2))
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, sides)
        if best is None:
            return [(rows, -soft(gs) / (hs + p.l2) * p.step)]
        return [leaf for side in best[1] for leaf in grow(side, g, h, depth - 1)]

    margin = np.zeros(len(y))
    for _ in range(p.rounds):
        proba = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, p.pos_weight, 1)
        for rows, value in grow(np.arange(len(y)), w * (proba - y), w * proba * (1 - proba), p.depth):
            margin[rows] += value
    return margin


@pytest.mark.parametrize("p", [Params(rounds=10, depth=3, step=0.3, rows=1.0, columns=1.0, least_weight=3.0), Params(rounds=3, depth=2, step=0.5, rows=1.0, columns=1.0, l1=2.0, l2=5.0, pos_weight=3.0)])
def test_rounds_equal_a_plain_version(spark, p):
    x, y = table()
    df = frame(spark, x, y)
    cuts = [sorted(set(c[~np.isnan(c)].tolist()))[:-1] for c in x.T]
    model = boosting.train(df, FEATURES, params=p, cuts=cuts, cut_every=4)
    got = np.array([r.proba for r in boosting.predict(model, df).orderBy("id").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-plain_boosting(x, y, p))), atol=1e-9)


def test_early_stop_sampling_and_persistence(spark):
    x, y = table(300)
    held = np.arange(300) % 3 == 0
    noise = np.where(held, np.random.default_rng(1).integers(0, 2, 300), y)
    p = Params(rounds=40, depth=2, step=1.0, patience=3, least_weight=1.0)
    model = boosting.train(frame(spark, x, noise, held), FEATURES, validation="held", params=p)
    assert len(model.losses) < 40 and len(model.trees) == int(np.argmin(model.losses)) + 1
    again = boosting.Trees.from_json(model.to_json())
    df = frame(spark, x, y)
    assert [r.proba for r in boosting.predict(again, df).orderBy("id").collect()] == [r.proba for r in boosting.predict(model, df).orderBy("id").collect()]
    assert again.trees == boosting.train(frame(spark, x, noise, held), FEATURES, validation="held", params=p).trees
    used = [r for r in boosting.importance(model) if r["weight"]]
    assert used and sum(r["gain_normalized"] for r in used) == pytest.approx(1)


def test_odd_rows(spark):
    """A feature that is always missing, one value only, no labels at all."""
    df = spark.createDataFrame([(None, 1.0, float("nan"), 1), (None, 1.0, 2.0, 0), (None, 1.0, 3.0, None)], "a double, b double, c double, target int")
    model = boosting.train(df, FEATURES, params=Params(rounds=2, depth=2))
    assert all(0 < r.proba < 1 for r in boosting.predict(model, df.withColumn("node", F.lit(1))).collect())
    none = boosting.train(df.where("target is null"), FEATURES, params=Params(rounds=1, depth=1))
    assert [r.proba for r in boosting.predict(none, df).collect()] == [0.5] * 3
