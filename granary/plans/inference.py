"""Scoring with exported tree ensembles as Column expressions: no Python on the executors, each tree is a nested case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf_of(nodes: Sequence[Mapping], features: Sequence[Column], at: int = 0) -> Column:
    """The value of the leaf that a row reaches: at most the threshold goes left, a missing or NaN feature where the node
    says."""
    node = nodes[at]
    if node["is_leaf"]:
        return F.lit(float(node["value"]))
    x = features[node["feature_idx"]]
    left, right = leaf_of(nodes, features, node["left"]), leaf_of(nodes, features, node["right"])
    missing = x.isNull() | F.isnan(x)
    return F.when(missing, left if node.get("missing_go_to_left") else right).when(x <= node["threshold"], left).otherwise(right)


def interpolated(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear through the points, constant beyond them."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        out = F.when(x <= xs[i], ys[i - 1] + (x - xs[i - 1]) / (xs[i] - xs[i - 1]) * (ys[i] - ys[i - 1])).otherwise(out)
    return F.when(x <= xs[0], float(ys[0])).otherwise(out)


def predicted(model: Mapping, features: Mapping[str, Column]) -> dict[str, Column]:
    """p_fail, raw_p_fail and score (100 for sure survival) of an exported model with names of inputs, trees,
    learning_rate, baseline and an optional calibration (x, y)."""
    inputs = [features[n].cast("double") for n in model["inputs"]]
    margin = F.lit(float(model["baseline"]))
    for nodes in model["trees"]:
        margin = margin + model["learning_rate"] * leaf_of(nodes, inputs)
    raw = 1 / (1 + F.exp(-margin))
    c = model.get("calibration")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), interpolated(raw, c["x"], c["y"]) if c else raw))
    return {"p_fail": p, "raw_p_fail": raw, "score": F.floor((1 - p) * 100 + 0.5)}
