"""Shapley attributions of fitted Spark tree ensembles, by the cover of their paths.

The driver reads the leaves of a model once (a model's size does not grow with the data): the value of each, and per
feature on its path the range that leads there and the share of training rows that passes. A leaf gives a feature
its value times the feature's exact Shapley weight, where a feature outside a coalition passes with its share. Tasks add
up the leaves over Arrow batches of rows. Base and attributions sum to the margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _value(node) -> float:
    """A regression node's mean, or a classification node's share of class 1."""
    stats = node.impurityStats()
    kind = stats.getClass().getSimpleName()
    if kind in ("GiniCalculator", "EntropyCalculator"):
        counts = list(stats.stats())
        return counts[1] / sum(counts)
    return node.prediction()


def leaves(model) -> list[tuple[float, dict[int, tuple[float, list]]]]:
    """(value, {feature: (share, conditions)}) of every leaf; a condition is ('in', low, high] or a set of categories."""
    jvm = model._java_obj
    trees = list(jvm.trees()) if hasattr(model, "treeWeights") else [jvm]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    out = []

    def walk(node, weight: float, path: dict) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            out.append((weight * _value(node), path))
            return
        split, n = node.split(), node.impurityStats().count()
        f = split.featureIndex()
        if split.getClass().getSimpleName() == "ContinuousSplit":
            sides = (("range", -math.inf, split.threshold()), ("range", split.threshold(), math.inf))
        else:
            sides = (("among", tuple(split.leftCategories()), None), ("among", tuple(split.rightCategories()), None))
        for child, condition in zip((node.leftChild(), node.rightChild()), sides, strict=True):
            share, conditions = path.get(f, (1.0, []))
            walk(child, weight, path | {f: (share * child.impurityStats().count() / n, [*conditions, condition])})

    for tree, weight in zip(trees, weights, strict=True):
        walk(tree.rootNode(), weight, {})
    return out


def base_value(found: list) -> float:
    """The mean of the leaves by cover."""
    return sum(v * math.prod(share for share, _ in path.values()) for v, path in found)


def shapley(x: np.ndarray, found: list) -> np.ndarray:
    """Attributions of the rows of x to its columns."""
    out = np.zeros_like(x, dtype=float)
    for value, path in found:
        d = len(path)
        passes = {}
        for f, (_, conditions) in path.items():
            ok = np.ones(len(x), bool)
            for kind, a, b in conditions:
                ok &= (x[:, f] > a) & (x[:, f] <= b) if kind == "range" else np.isin(x[:, f], a)
            passes[f] = ok.astype(float)
        for f in path:
            # coefficients by the size of the coalition of the other features
            poly = [np.ones(len(x))]
            for g in path:
                if g != f:
                    share = path[g][0]
                    poly = [(share * poly[k] if k < len(poly) else 0.0) + (passes[g] * poly[k - 1] if k else 0.0) for k in range(len(poly) + 1)]
            weight = sum(math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) * c for k, c in enumerate(poly))
            out[:, f] += value * (passes[f] - path[f][0]) * weight
    return out


def tree_attributions(df: DataFrame, model, features: list[str], name: str = "attributions") -> DataFrame:
    """df with name: struct(base, by_feature: array of (feature, attribution), largest first, ties by name).

    model is a fitted Spark regressor or binary classifier of trees, boosted trees or a forest over the features in this order, none of them null;
    base and attributions sum to its margin (boosted classifiers), share of class 1 (other classifiers) or prediction.
    """
    found = leaves(model)
    base = base_value(found)
    shared = df.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("array<double>")
    def attributed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array(s.tolist(), float).reshape(len(s), len(features))
            yield pd.Series(list(shapley(x, shared.value)))

    values = attributed(F.array(*[F.col(f"`{c}`").cast("double") for c in features]))
    d = df.withColumn("_a", values)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("_a")[i].alias("attribution")) for i, c in enumerate(features)])
    by = F.array_sort(pairs, lambda a, b: F.when(F.abs(a["attribution"]) > F.abs(b["attribution"]), -1).when(F.abs(a["attribution"]) < F.abs(b["attribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return d.withColumn(name, F.struct(F.lit(base).alias("base"), by.alias("by_feature"))).drop("_a")
