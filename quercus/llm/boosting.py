"""Gradient-boosted trees: fitted with Spark ML, then read out as arrays that a task can apply to a batch.

A model holds at most ``rounds`` trees of ``2 ** (depth + 1)`` nodes, whatever it was fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F


@dataclass
class Trees:
    """Node arrays of every tree; a leaf has itself as both children."""

    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray  # one per tree
    depth: int
    constant: float | None = None  # the answer where there was nothing to learn

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.weight)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                low = x[rows, self.feature[t, at]] <= self.threshold[t, at]
                at = np.where(low, self.left[t, at], self.right[t, at])
            margin += self.weight[t] * self.value[t, at]
        return 1 / (1 + np.exp(-2 * np.clip(margin, -300, 300)))


def _nodes(root) -> list[tuple[int, float, int, int, float]]:
    out: list[tuple[int, float, int, int, float]] = []

    def add(node) -> int:
        place = len(out)
        out.append((0, 0.0, place, place, float(node.prediction())))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            out[place] = (split.featureIndex(), float(split.threshold()), left, right, 0.0)
        return place

    add(root)
    return out


def fit_trees(
    rows: DataFrame, features: str = "features", label: str = "label", rounds: int = 20, depth: int = 4
) -> Trees:
    """Trees from rows of (array of doubles, 0 or 1); one class alone gives its share as a constant."""
    empty = np.zeros((0, 0))
    seen = {int(r[0]): r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    if len(seen) < 2:
        share = float(max(seen, default=0))
        return Trees(empty, empty, empty, empty, empty, np.zeros(0), depth, share)
    data = rows.select(array_to_vector(features).alias("x"), F.col(label).cast("double").alias("y"))
    model = GBTClassifier(
        featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=64, seed=7
    ).fit(data)
    trees = [_nodes(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]
    wide = max(map(len, trees))
    table = np.zeros((len(trees), wide, 5))
    for i, nodes in enumerate(trees):
        table[i, : len(nodes)] = nodes
    return Trees(
        table[:, :, 0].astype(np.int64), table[:, :, 1], table[:, :, 2].astype(np.int64),
        table[:, :, 3].astype(np.int64), table[:, :, 4], np.array(model.treeWeights), depth,
    )


@dataclass
class Calibration:
    boundaries: np.ndarray
    values: np.ndarray

    def __call__(self, p: np.ndarray) -> np.ndarray:
        """The calibrated share, with a thousandth of the raw score so that its order stays."""
        return np.clip(0.999 * np.interp(p, self.boundaries, self.values) + 0.001 * p, 0.0, 1.0)


def fit_isotonic(rows: DataFrame, raw: str = "raw", label: str = "label") -> Calibration:
    """A non-decreasing map from raw score to share of ones; no rows: the identity."""
    if rows.isEmpty():
        return Calibration(np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    data = rows.select(F.col(raw).alias("features"), F.col(label).cast("double").alias("label"))
    model = IsotonicRegression().fit(data)
    return Calibration(np.array(model.boundaries.toArray()), np.array(model.predictions.toArray()))
