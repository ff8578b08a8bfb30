"""Fitted models as data: tables of tree nodes or coefficients, in place of model objects.

A tree model is a table of nodes, one row each: model, tree, output, node, feature, cut, value, gain, cover. Nodes are numbered
as in a heap (1 is the root, 2i and 2i+1 are the children of i); ``feature`` is a position in the feature list and -1
in a leaf. A row goes left where its value is at most the cut or missing. Several models stand in one table; a row may
name the model that scores it in a column.

To score, the nodes are packed into a few arrays, whose size follows from the number of trees and their depth, never from
the data, and handed to an Arrow function that walks all rows of a batch at once; only the feature columns pass
through it. (Walking the arrays by higher-order functions in the JVM took about a microsecond a step, and the packed
model was copied next to every row.)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "model int, tree int, output int, node int, feature int, cut double, value double, gain double, cover double"


#: Nodes that a packed model may have; beyond it the model is to be scored in parts.
MOST_NODES = 1 << 23


@dataclass(frozen=True)
class Packed:
    """Nodes of all trees end to end. ``left`` is the place of the left child, the right one follows it; a leaf leads to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    #: places of the roots by (model, output)
    roots: dict[tuple[int, int], np.ndarray]

    def total(self, x: np.ndarray, model: int, output: int) -> np.ndarray:
        """Sum of the leaf values of each row of ``x`` (rows, features); NaN goes left."""
        out = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots.get((model, output), ()):
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[every, np.maximum(f, 0)] > self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            out += self.value[node]
        return out


def packed(nodes: DataFrame) -> Packed:
    rows = nodes.select("model", "output", "tree", "node", "feature", "cut", "value").orderBy("model", "output", "tree", "node").limit(MOST_NODES + 1).toArrow()
    if len(rows) > MOST_NODES:
        raise ValueError(f"a model of over {MOST_NODES} nodes: score its trees in parts")
    model, output, tree, node, feature, cut, value = (rows.column(k).to_numpy() for k in range(7))
    root = np.flatnonzero(node == 1)
    which = np.cumsum(node == 1) - 1  # the tree of each node; a tree's nodes ascend
    # children are found by (tree, heap number)
    key = which * (1 << 32) + node
    inner = feature >= 0
    left = np.arange(len(node))
    left[inner] = np.searchsorted(key, which[inner] * (1 << 32) + 2 * node[inner].astype(np.int64))
    places: dict[tuple[int, int], list[int]] = {}
    for r in root:
        places.setdefault((int(model[r]), int(output[r])), []).append(int(r))
    return Packed(feature.astype(np.int32), cut, left, value, {k: np.array(v) for k, v in places.items()})


def _scored(df: DataFrame, features: Sequence[str], model: str | int, name: str, of, kind: str) -> DataFrame:
    """Adds a column computed from the feature matrix of each Arrow batch by ``of(x, model)``, for each model among its rows."""

    @F.arrow_udf(kind)
    def score(which: pa.Array, *columns: pa.Array) -> pa.Array:
        models = which.to_numpy(zero_copy_only=False)
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], 1)
        out = None
        for m in np.unique(models):
            at = np.flatnonzero(models == m)
            got = of(x[at], int(m))
            if out is None:
                out = np.zeros((len(x), *got.shape[1:]))
            out[at] = got
        if out is None:
            return pa.array([], pa.float64() if kind == "double" else pa.list_(pa.float64()))
        return pa.array(out) if out.ndim == 1 else pa.array(list(out), pa.list_(pa.float64()))

    which = F.lit(model) if isinstance(model, int) else F.col(model)
    return df.withColumn(name, score(which.cast("int"), *[F.col(f).cast("double") for f in features]))


@dataclass
class TreeModel:
    """Node rows, a start value per model and output (model, output, base), and how sums become predictions.

    ``kind``: logistic (probability of class 1), softmax (probability of each class), squared (the sum itself) or mean
    (mean over the trees, whose leaves hold shares of class 1).
    """

    kind: str
    features: list[str]
    nodes: DataFrame
    bases: DataFrame
    depth: int
    outputs: int = 1

    def predict(self, df: DataFrame, model: str | int = 0, name: str = "score") -> DataFrame:
        """The input columns and ``name``: a probability, an array of them (softmax), or a predicted value."""
        nodes, kind, outputs = packed(self.nodes), self.kind, self.outputs
        bases = {(r["model"], r["output"]): r["base"] for r in self.bases.collect()}

        def of(x: np.ndarray, m: int) -> np.ndarray:
            sums = np.stack([bases[m, k] + nodes.total(x, m, k) for k in range(outputs)], 1)
            if kind == "logistic":
                return 1.0 / (1.0 + np.exp(-sums[:, 0]))
            if kind == "mean":
                return sums[:, 0] / max(1, len(nodes.roots.get((m, 0), ())))
            if kind == "softmax":
                e = np.exp(sums - sums.max(1, keepdims=True))
                return e / e.sum(1, keepdims=True)
            return sums[:, 0]

        return _scored(df, self.features, model, name, of, "array<double>" if kind == "softmax" else "double")

    def importances(self, model: int = 0) -> DataFrame:
        """(feature, importance): share of all gains of the model's splits, features without a split too."""
        gains = self.nodes.where((F.col("model") == model) & (F.col("feature") >= 0)).groupBy("feature").agg(F.sum("gain").alias("_gain"))
        names = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in self.features]).alias("name"), F.sequence(F.lit(0), F.lit(len(self.features) - 1)).alias("at")))
        every = df_of_one(self.nodes).select(names.alias("f")).select(F.col("f.name").alias("name"), F.col("f.at").alias("at"))
        met = every.join(gains, F.col("at") == F.col("feature"), "left").select(F.col("name").alias("feature"), F.coalesce("_gain", F.lit(0.0)).alias("_gain"))
        whole = gains.select(F.sum("_gain").alias("s")).scalar()
        return met.select("feature", F.coalesce(F.try_divide("_gain", whole), F.lit(0.0)).alias("importance"))


@dataclass
class LinearModel:
    """Coefficient rows: model, intercept, weights (array in the order of the features)."""

    features: list[str]
    coefficients: DataFrame

    def predict(self, df: DataFrame, model: str | int = 0, name: str = "score") -> DataFrame:
        """Probability of class 1; a missing value counts as 0."""
        rows = {r["model"]: (r["intercept"], np.array(r["weights"])) for r in self.coefficients.collect()}

        def of(x: np.ndarray, m: int) -> np.ndarray:
            b, w = rows[m]
            return 1.0 / (1.0 + np.exp(-(np.where(np.isnan(x), 0.0, x) @ w + b)))

        return _scored(df, self.features, model, name, of, "double")


def df_of_one(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1)
