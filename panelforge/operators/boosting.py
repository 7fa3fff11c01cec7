"""Second-order boosted trees on histograms of gradients.

Values are binned once by approximate quantiles. Each level of a tree takes one
aggregate: gradients and hessians summed by (node, feature, bin), combined before the
shuffle, so what reaches the driver is bounded by nodes x features x bins whatever the
number of rows. Splits are chosen from these sums, with a learnt side for missing
values, and are applied as column expressions; no row leaves the executors.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelforge.storage import discard, stored


@dataclass
class Params:
    rounds: int = 500
    depth: int = 6
    step: float = 0.05
    #: Shares of rows and of features that a tree sees.
    rows: float = 0.8
    columns: float = 0.8
    #: The least sum of hessians of a child, and the penalties on leaf values.
    least_weight: float = 5.0
    l1: float = 0.1
    l2: float = 1.0
    pos_weight: float = 1.0
    #: Rounds without a better validation loss before it ends.
    patience: int = 50
    bins: int = 64
    seed: int = 42


@dataclass
class Trees:
    """Trees as lists of nodes; a node has a split (feature, bin, threshold, missing_left, left, right, gain) or a leaf value, and its cover."""

    features: list[str]
    params: Params
    trees: list[list[dict]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "params": asdict(self.params), "trees": self.trees, "losses": self.losses})

    @staticmethod
    def from_json(text: str) -> Trees:
        d = json.loads(text)
        return Trees(d["features"], Params(**d["params"]), d["trees"], d["losses"])


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Per feature the values at or under which a split may go; a row of the driver for each feature."""
    grid = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(_value(c), grid, 10_000).alias(f"c{i}") for i, c in enumerate(features)], *[F.max(_value(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return [sorted({x for x in found[f"c{i}"] or [] if x < found[f"m{i}"]}) for i in range(len(features))]


def _value(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _bin(c: str, cuts: list[float]) -> Column:
    """How many cuts lie under the value; -1 for a missing one."""
    edges = F.array(*[F.lit(x) for x in cuts]).cast("array<double>")
    return F.when(_value(c).isNull(), -1).otherwise(F.size(F.filter(edges, lambda e: e < _value(c))))


def _walk(tree: list[dict], at: int, leaf) -> Column:
    """A column over ``bins``: leaf(number, node) of the node that a row comes to."""
    node = tree[at]
    if "left" not in node:
        return leaf(at, node)
    b = F.element_at("bins", node["feature"] + 1)
    left = (b <= node["bin"]) & ((b >= 0) | F.lit(node["missing_left"]))
    return F.when(left, _walk(tree, node["left"], leaf)).otherwise(_walk(tree, node["right"], leaf))


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf_value(g: float, h: float, p: Params) -> float:
    return float(-_shrunk(g, p.l1) / (h + p.l2))


def best_split(sums: dict[int, dict[int, tuple[float, float]]], cuts: list[list[float]], g: float, h: float, p: Params) -> dict | None:
    """The split with the largest gain of a node; sums: feature -> bin -> (gradients, hessians). Ties go to the first feature, the lowest bin, missing right."""
    score = lambda a, b: _shrunk(a, p.l1) ** 2 / (b + p.l2)
    best, whole = None, score(g, h)
    for f in sorted(sums):
        per = np.zeros((len(cuts[f]) + 1, 2))
        for b, pair in sums[f].items():
            if b >= 0:
                per[b] = pair
        missing = np.array(sums[f].get(-1, (0.0, 0.0)))
        under = np.cumsum(per, 0)
        # the last bin has no cut: all that is there against what is missing
        for missing_left in (False, True):
            left = under + missing * missing_left
            right = np.array([g, h]) - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = 0.5 * (score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1]) - whole)
            gains[(left[:, 1] < p.least_weight) | (right[:, 1] < p.least_weight)] = -math.inf
            if missing_left or not missing[1]:
                gains[-1] = -math.inf
            for b in np.flatnonzero(gains > 1e-9):
                if best is None or gains[b] > best["gain"] * (1 + 1e-9):
                    best = {"feature": f, "bin": int(b), "threshold": cuts[f][b] if b < len(cuts[f]) else math.inf, "missing_left": missing_left, "gain": float(gains[b]), "sides": (tuple(left[b]), tuple(right[b]))}
    return best


def _grow(state: DataFrame, chosen: list[int], cuts: list[list[float]], p: Params) -> list[dict]:
    """One tree on rows with bins, g and h: an aggregate a level, all its open nodes at once."""
    tree: list[dict] = [{}]
    open_ = {0}
    for depth in range(p.depth + 1):
        cells = F.array(*[F.struct(F.lit(f).alias("f"), F.element_at("bins", f + 1).alias("b")) for f in chosen])
        at = _walk(tree, 0, lambda i, node: F.lit(i))
        met = state.select(at.alias("node"), "g", "h", F.explode(cells).alias("cell")).where(F.col("node").isin(sorted(open_)))
        found: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in met.groupBy("node", "cell.f", "cell.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            found.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
        level = len(tree)
        for i in sorted(open_):
            sums = found.get(i, {})
            g, h = np.sum([list(v) for v in next(iter(sums.values())).values()], 0) if sums else (0.0, 0.0)
            split = best_split(sums, cuts, g, h, p) if depth < p.depth and sums else None
            tree[i] = {"cover": float(h)}
            if split is None:
                tree[i]["leaf"] = p.step * leaf_value(g, h, p)
                continue
            sides = split.pop("sides")
            tree[i] |= split | {"left": len(tree), "right": len(tree) + 1}
            # at the last level the sums of a split are those of its leaves
            tree += [{"cover": float(s[1]), "leaf": p.step * leaf_value(*s, p)} for s in sides]
        open_ = set(range(level, len(tree)))
        if not open_ or depth + 1 == p.depth:
            return tree
    return tree


def train(rows: DataFrame, features: list[str], label: str = "target", validation: str | None = None, params: Params | None = None, cuts: list[list[float]] | None = None, cut_every: int = 5) -> Trees:
    """Boosted trees for label 1; features may be null or NaN, rows without a label do not count.

    validation: a boolean column; its rows are not trained on, and rounds end when their
    log loss has not become better for ``patience`` rounds; trees behind the best round
    are dropped. Binned rows are written once, and again every cut_every rounds.
    """
    p = params or Params()
    known = rows.where(F.col(label).isNotNull())
    cuts = cuts or cut_points(known, features, p.bins)
    held = F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    y = F.col(label).cast("double")
    binned = known.select(F.array(*[_bin(c, cuts[i]) for i, c in enumerate(features)]).alias("bins"), y.alias("y"), F.when(y == 1, p.pos_weight).otherwise(1.0).alias("w"), held.alias("held"), F.monotonically_increasing_id().alias("row"), F.lit(0.0).alias("margin"))
    state = stored(binned, "boosting")
    written, out, best = [state], Trees(list(features), p), (math.inf, 0)
    rng = np.random.default_rng(p.seed)
    for turn in range(p.rounds):
        chosen = sorted(rng.choice(len(features), max(1, int(p.columns * len(features))), replace=False).tolist())
        proba = 1 / (1 + F.exp(-F.col("margin")))
        drawn = F.pmod(F.xxhash64("row", F.lit(turn), F.lit(p.seed)), F.lit(1_000_000)) < int(p.rows * 1_000_000)
        tree = _grow(state.where(~F.col("held") & drawn).select("bins", (F.col("w") * (proba - F.col("y"))).alias("g"), (F.col("w") * proba * (1 - proba)).alias("h")), chosen, cuts, p)
        out.trees.append(tree)
        state = state.withColumn("margin", F.col("margin") + _walk(tree, 0, lambda i, node: F.lit(node["leaf"])))
        if (turn + 1) % cut_every == 0 and turn + 1 < p.rounds:
            state = stored(state, "boosting")
            discard(written.pop())
            written.append(state)
        if validation:
            sure = F.least(F.greatest(proba, F.lit(1e-15)), F.lit(1 - 1e-15))
            loss = state.where("held").agg(F.avg(-F.col("w") * (F.col("y") * F.log(sure) + (1 - F.col("y")) * F.log(1 - sure)))).first()[0]
            out.losses.append(loss if loss is not None else math.nan)
            if loss is not None and loss < best[0]:
                best = (loss, turn + 1)
            if loss is not None and turn + 1 - best[1] >= p.patience:
                break
    if validation and best[1]:
        out.trees = out.trees[: best[1]]
    discard(*written)
    return out


def _margins(model: Trees, values: np.ndarray) -> np.ndarray:
    """Sums of leaf values, tree by tree over all rows of a batch."""
    total = np.zeros(len(values))
    for tree in model.trees:
        at = np.zeros(len(values), np.int64)
        for _ in range(model.params.depth):
            for i in np.unique(at):
                node = tree[i]
                if "left" in node:
                    here = at == i
                    v = values[here, node["feature"]]
                    at[here] = np.where(np.where(np.isnan(v), node["missing_left"], v <= node["threshold"]), node["left"], node["right"])
        total += np.array([n.get("leaf", 0.0) for n in tree])[at]
    return total


def predict(model: Trees, rows: DataFrame) -> DataFrame:
    """rows with proba, the probability of label 1; in Arrow batches, since many trees do not fit a generated expression."""

    @F.pandas_udf(DoubleType())
    def proba(values: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-_margins(model, values.to_numpy(float)))))

    return rows.withColumn("proba", proba(F.struct(*[_value(c).alias(f"f{i}") for i, c in enumerate(model.features)])))


def importance(model: Trees) -> list[dict]:
    """Per feature, strongest first: mean gain and mean cover of its splits, their number, and gain by the sum of gains."""
    found = {f: [0, 0.0, 0.0] for f in model.features}
    for node in (n for tree in model.trees for n in tree if "left" in n):
        one = found[model.features[node["feature"]]]
        one[0] += 1
        one[1] += node["gain"]
        one[2] += node["cover"]
    rows = [{"feature": f, "gain": g / n if n else 0.0, "weight": n, "cover": c / n if n else 0.0} for f, (n, g, c) in found.items()]
    total = sum(r["gain"] for r in rows)
    return sorted([r | {"gain_normalized": r["gain"] / total if total else 0.0} for r in rows], key=lambda r: (-r["gain"], r["feature"]))
