"""Exact Shapley values of tree ensembles, by their leaves instead of by coalitions.

A leaf is reached by a mixture of a row and a background row if each feature on
its path comes from one of the two that the path admits. Features that only the
explained row satisfies must come from it, those that only the background row satisfies
must not; with u and v of these, the leaf's value adds (u-1)! v! / (u+v)! of itself to
each of the former and takes u! (v-1)! / (u+v)! from each of the latter.
Which features of its path a row satisfies is a pattern of as many bits, so the
background is a count per leaf and pattern, whatever its size, and a row's values
are one look-up per leaf, added up where the row is. No coalition is formed.
"""

import uuid
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.checks import require_columns
from probity.session import ensure_checkpoint_dir

#: Longest path (in different features) whose patterns are tabulated; the patterns of longer ones are worked out as they occur.
TABULATED = 8
#: Rows that are explained at once.
ROWS = 4096


@dataclass(frozen=True)
class Leaf:
    """A value and, per feature on the path, the half-open interval (low, high] that leads there."""

    value: float
    features: tuple
    low: tuple
    high: tuple


@dataclass(frozen=True)
class TreeEnsemble:
    """The sum of all trees' leaves; ``link`` leads from the sum to the probability of class 1.

    "identity": the sum is the probability (a forest's mean of class shares).
    "double_logit": 1 / (1 + exp(-2 sum)) (boosted trees).
    """

    features: tuple
    leaves: tuple
    link: str = "identity"

    @classmethod
    def of_nodes(cls, features, trees, link="identity"):
        """From {node: (value, feature, threshold, left, right)} per tree, node 0 its root; a feature below 0 marks a leaf."""
        leaves = []
        for nodes in trees:
            todo = [(0, {})]
            while todo:
                at, path = todo.pop()
                value, feature, threshold, left, right = nodes[at]
                if feature < 0:
                    leaves.append(Leaf(float(value), tuple(path), tuple(low for low, _ in path.values()), tuple(high for _, high in path.values())))
                    continue
                low, high = path.get(feature, (-np.inf, np.inf))
                if threshold > low:  # else nothing reaches the left
                    todo.append((left, path | {feature: (low, min(high, threshold))}))
                if threshold < high:
                    todo.append((right, path | {feature: (max(low, threshold), high)}))
        return cls(tuple(features), tuple(leaves), link)

    @classmethod
    def of_model(cls, model, features, spark):
        """From a fitted forest, boosted trees or a single tree of Spark ML: the nodes are read from the model as Spark writes it.

        ``features`` are the columns of the assembled vector, in order. Categorical splits are not supported.
        """
        path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data")
        rows = rows if "nodeData" in rows.columns else rows.select(F.lit(0).alias("treeID"), F.struct(*rows.columns).alias("nodeData"))
        boosted = hasattr(model, "treeWeights") and "GBT" in type(model).__name__
        weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
        trees = [{} for _ in weights]
        for r in rows.select("treeID", "nodeData.*").collect():  # as many rows as the model has nodes
            if r["leftChild"] >= 0 and r["split"]["numCategories"] >= 0:
                raise ValueError("splits on categories are not supported")
            stats = r["impurityStats"]
            value = r["prediction"] * weights[r["treeID"]] if boosted else stats[1] / sum(stats) / len(weights)
            split = r["split"] if r["leftChild"] >= 0 else None
            trees[r["treeID"]][r["id"]] = (
                value, split["featureIndex"] if split else -1, split["leftCategoriesOrThreshold"][0] if split else 0.0, r["leftChild"], r["rightChild"])
        return cls.of_nodes(features, trees, "double_logit" if boosted else "identity")

    def score(self, columns=None):
        """The sum of the reached leaves as a Column; meant for small ensembles."""
        columns = columns or {f: F.col(f) for f in self.features}
        total = F.lit(0.0)
        for leaf in self.leaves:
            inside = F.lit(True)
            for j, low, high in zip(leaf.features, leaf.low, leaf.high, strict=True):
                x = columns[self.features[j]]
                # A missing value goes right, as if it were larger than all thresholds.
                inside = inside & (F.lit(True) if low == -np.inf else F.coalesce(x > low, F.lit(True))) & (
                    F.lit(True) if high == np.inf else F.coalesce(x <= high, F.lit(False)))
            total = total + F.when(inside, leaf.value).otherwise(0.0)
        return total

    def explainer(self, background):
        return _Explainer(self, np.asarray(background, np.float64).reshape(-1, len(self.features)))


def _shares(size):
    """[u, v]: what a leaf's value gives to each of u features and takes from each of v, as factors."""
    gain, loss = np.zeros((size + 1, size + 1)), np.zeros((size + 1, size + 1))
    for u in range(size + 1):
        for v in range(size + 1 - u):
            if u:
                gain[u, v] = factorial(u - 1) * factorial(v) / factorial(u + v)
            if v:
                loss[u, v] = factorial(u) * factorial(v - 1) / factorial(u + v)
    return gain, loss


class _Explainer:
    """Per leaf: the background's counts by pattern, and the values of each pattern a row can have."""

    def __init__(self, ensemble, background):
        self.ensemble, self.rows = ensemble, max(1, len(background))
        self.leaves = []
        self.base = 0.0
        for leaf in ensemble.leaves:
            k = len(leaf.features)
            patterns, counts = np.unique(self.inside(leaf, background), axis=0, return_counts=True)
            self.base += leaf.value * counts[patterns.all(axis=1)].sum() / self.rows
            table = None
            if k <= TABULATED:
                every = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1 == 1
                table = self.values(leaf.value, every, patterns, counts)
            self.leaves.append((leaf, patterns, counts, table))

    @staticmethod
    def inside(leaf, rows):
        out = np.ones((len(rows), len(leaf.features)), bool)
        for i, (j, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high, strict=True)):
            x = rows[:, j]
            out[:, i] = ~(x <= low)
            if high < np.inf:
                out[:, i] &= x <= high
        return out

    def values(self, value, own, patterns, counts):
        """Contributions of a leaf (rows of ``own`` patterns x features of the path)."""
        gain, loss = _shares(own.shape[1])
        out = np.zeros(own.shape)
        for other, n in zip(patterns, counts, strict=True):
            must, must_not = own & ~other, ~own & other
            open_ = (own | other).all(axis=1)
            u, v = must.sum(axis=1), must_not.sum(axis=1)
            factor = open_ * (value * n / self.rows)
            out += must * (factor * gain[u, v])[:, None] - must_not * (factor * loss[u, v])[:, None]
        return out

    def __call__(self, rows):
        """(values, score) of every row."""
        phi, score = np.zeros((len(rows), len(self.ensemble.features))), np.zeros(len(rows))
        for leaf, patterns, counts, table in self.leaves:
            own = self.inside(leaf, rows)
            score += leaf.value * own.all(axis=1)
            if table is None:
                different, which = np.unique(own, axis=0, return_inverse=True)
                part = self.values(leaf.value, different, patterns, counts)[which.ravel()]
            else:
                part = table[(own << np.arange(own.shape[1])).sum(axis=1)] if own.shape[1] else np.zeros((len(rows), 0))
            for i, j in enumerate(leaf.features):
                phi[:, j] += part[:, i]
        return phi, score


def tree_shap(df, id_column, ensemble, sample, threshold=0.5, keep=None) -> DataFrame:
    """Shapley values of a tree ensemble against a background sample, exact, one row per row of ``df``.

    Columns: id, base_value, score, phi_ per feature (these add up to the score), prediction
    (1 where the probability reaches ``threshold``) and probability. ``sample``
    is small (see ``explain.background``); it and the ensemble go to every task, and nothing is
    shuffled. ``keep`` is {column: name} of further columns to carry along. Missing values are larger than every threshold, as in Spark's trees.
    """
    features = list(ensemble.features)
    require_columns(df, [id_column, *features])
    columns = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    rows = sample.select(*columns).collect()
    explain = ensemble.explainer([[np.nan if x is None else x for x in r] for r in rows])
    kept = [F.col(f"`{id_column}`"), *[F.col(f"`{c}`").alias(n) for c, n in (keep or {}).items()]]
    source, width = df.select(*kept, *columns), len(kept)
    names = [*source.columns[:width], "base_value", "score", *[f"phi_{f}" for f in features], "prediction", "probability"]

    def work(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns[width:]])
                phi, score = explain(values)
                probability = score if ensemble.link == "identity" else 1 / (1 + np.exp(-2 * score))
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:width], pa.array(np.full(len(score), explain.base)), pa.array(score), *[pa.array(np.ascontiguousarray(p)) for p in phi.T],
                    pa.array((probability >= threshold).astype(np.int32)), pa.array(probability)], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:width]]
    fields += [f"`{n}` {'int' if n == 'prediction' else 'double'}" for n in names[width:]]
    return source.mapInArrow(work, ", ".join(fields))
