"""Local surrogates: a small weighted linear model around every row.

Features are cut at their quartiles. Perturbed rows draw a bin per feature by
its share of the training rows and a value from a normal distribution cut off
at the bin's bounds; the surrogate sees only whether a feature stayed in the
explained row's bin. The draws don't depend on the row that is explained, so one set
is drawn and scored for all rows, and rows with the same bins share the sums
over it. Per batch these sums are a few matrix products and all small systems
are solved at once; nothing is shuffled but the training rows' counts.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.checks import require_columns
from probity.functions.ordering import order_statistics
from probity.operators.noise import uniform_of
from probity.operators.profile import number_counts

QUARTILES = (0.25, 0.5, 0.75)
PERTURBATIONS = 5000
NUM_FEATURES = 10
#: Draws for one value; should all of them fall outside the bin, its middle is taken.
ATTEMPTS = 16
#: Widths of the kernel per square root of the number of features.
KERNEL_WIDTH = 0.75
#: Most features that "auto" selects one after another; more are taken by their weight in a fit of all.
MOST_FORWARD = 6
RIDGE, ALL_RIDGE = 1.0, 0.01
#: Cells of the arrays that are worked on at once.
CELLS = 1 << 22


def feature_cuts(training, features) -> DataFrame:
    """(column, cuts): the exact quartiles of every feature."""
    values = training.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    return order_statistics(number_counts(values, features), QUARTILES).groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("fraction", "value"))), lambda x: x["value"]).alias("cuts"))


def _bin(value, cuts):
    """How many cuts lie below the value."""
    return sum((F.coalesce((cuts[i] < value).cast("int"), F.lit(0)) for i in range(len(QUARTILES))), F.lit(0))


def feature_bins(training, features, cuts) -> DataFrame:
    """(column, bin, size, low, high, mean, std) of the bins that training rows fall into."""
    pairs = F.array(*[F.struct(F.lit(f).alias("column"), F.col(f"`{f}`").cast("double").alias("value")) for f in features])
    placed = training.select(F.inline(pairs)).where(F.col("value").isNotNull()).join(F.broadcast(cuts), "column")  # one row per feature
    own = placed.withColumn("bin", _bin(F.col("value"), F.col("cuts"))).groupBy("column", "bin").agg(
        F.count(F.lit(1)).alias("size"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.first("cuts").alias("cuts"))
    last = len(QUARTILES)
    return own.select(
        "column", "bin", "size", F.when(F.col("bin") == 0, F.col("least")).otherwise(F.get("cuts", F.col("bin") - 1)).alias("low"),
        F.when(F.col("bin") == last, F.col("most")).otherwise(F.get("cuts", F.least(F.col("bin"), F.lit(last - 1)))).alias("high"), "mean", "std")


def draws(spark, bins, features, scorer, perturbations=PERTURBATIONS, seed=42) -> DataFrame:
    """(n, bins, score): the perturbed rows, the bins they were drawn from and the model's score; one set for all rows."""
    upto = Window.partitionBy("column").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # At most four bins per feature.
    listed = bins.withColumn("upto", F.sum("size").over(upto)).groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("bin", "upto", "low", "high", "mean", "std"))).alias("listed"), F.sum("size").alias("total"))
    key = F.concat_ws(":", F.col("n").cast("string"), "column")
    asked = spark.range(1, perturbations + 1).select(F.col("id").alias("n"), F.explode(F.array(*[F.lit(f) for f in features])).alias("column"))
    chosen = asked.join(F.broadcast(listed), "column").withColumn("u", uniform_of(F.concat(key, F.lit(f":bin:{seed}"))) * F.col("total"))
    chosen = chosen.withColumn("b", F.element_at(F.filter("listed", lambda x: x["upto"] > F.col("u")), 1))

    def normal(k):
        u, v = (uniform_of(F.concat(key, F.lit(":"), k.cast("string"), F.lit(f":{name}:{seed}"))) for name in ("u", "v"))
        return F.col("b.mean") + F.col("b.std") * (F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v))

    tried = F.filter(F.transform(F.sequence(F.lit(1), F.lit(ATTEMPTS)), normal), lambda x: (x >= F.col("b.low")) & (x <= F.col("b.high")))
    drawn = chosen.select("n", "column", "b.bin", F.coalesce(F.get(tried, F.lit(0)), (F.col("b.low") + F.col("b.high")) / 2).alias("value"))
    wide = drawn.groupBy("n").agg(
        *[F.max(F.when(F.col("column") == f, F.col("value"))).alias(f) for f in features],
        F.array(*[F.max(F.when(F.col("column") == f, F.col("bin"))) for f in features]).alias("_bins"))
    return scorer(wide).select("n", F.col("_bins").alias("bins"), "score")


@dataclass(frozen=True)
class Neighbourhood:
    """Perturbed rows by their bins and scores: as many as were asked for, whatever the size of the data."""

    features: tuple
    bins: np.ndarray
    scores: np.ndarray

    @classmethod
    def drawn(cls, frame, features):
        rows = frame.orderBy("n").collect()
        return cls(tuple(features), np.array([r["bins"] for r in rows], np.int8).reshape(len(rows), len(features)),
                   np.array([r["score"] for r in rows], np.float64))

    def sums(self, cells):
        """Per cell (bins of a row): weighted sums of 1, z, zz', y, zy and yy over the draws; z is 1 where a bin is the cell's."""
        d, step = len(self.features), max(1, CELLS // max(1, self.bins.size))
        out = [[] for _ in range(6)]
        y = self.scores
        for first in range(0, len(cells), step):
            z = (self.bins[None] == cells[first:first + step, None, :]).astype(np.float64)
            w = np.exp(-(d - z.sum(axis=2)) / (2 * KERNEL_WIDTH ** 2 * d))
            wz = z * w[:, :, None]
            for part, value in zip(out, (w.sum(axis=1), wz.sum(axis=1), wz.transpose(0, 2, 1) @ z, w @ y,
                                         np.einsum("cnd,n->cd", wz, y), w @ (y * y)), strict=True):
                part.append(value)
        return [np.concatenate(part) for part in out]


def forward_selected(gram, count):
    """Per system the features that raise the fit most, one after another: Gram matrices (features and target, centred) are swept."""
    gram = gram.copy()
    rows, width = np.arange(len(gram)), gram.shape[1] - 1
    free = np.ones((len(gram), width), bool)
    floor = 1e-12 * np.maximum(np.diagonal(gram, axis1=1, axis2=2)[:, :width].max(axis=1, initial=0), 1e-300)
    chosen = []
    for _ in range(min(count, width)):
        pivots = np.diagonal(gram, axis1=1, axis2=2)[:, :width]
        usable = free & (pivots > floor[:, None])
        gain = np.where(usable, gram[:, :width, width] ** 2 / np.where(usable, pivots, 1), np.where(free, 0.0, -1.0))
        best = gain.argmax(axis=1)
        chosen.append(best)
        # Sweep the chosen feature out of all others; one without a pivot has nothing to give.
        pivot = np.where(usable[rows, best], pivots[rows, best], np.inf)
        column = gram[rows, :, best]
        gram -= column[:, :, None] * column[:, None, :] / pivot[:, None, None]
        free[rows, best] = False
    return np.stack(chosen, axis=1) if chosen else np.zeros((len(gram), 0), np.int64)


def fitted(sums, own, count=NUM_FEATURES, selection="auto", ridge=RIDGE):
    """Surrogates of many rows from their cells' sums; each row is itself one more sample of weight 1 with every feature unchanged.

    Returns (selected, weights, intercept, prediction, r2), arrays over rows.
    """
    s0, s1, s2, t0, t1, tt = sums
    s0, s1, s2 = s0 + 1, s1 + 1, s2 + 1
    t0, t1, tt = t0 + own, t1 + own[:, None], tt + own * own
    d = s1.shape[1]
    a = s2 - s1[:, :, None] * s1[:, None, :] / s0[:, None, None]
    b = t1 - s1 * (t0 / s0)[:, None]
    spread = tt - t0 * t0 / s0
    if selection == "auto":
        selection = "forward" if count <= MOST_FORWARD else "weights"
    if selection == "forward":
        selected = forward_selected(np.block([[a, b[:, :, None]], [b[:, None, :], spread[:, None, None]]]), count)
    else:
        every = np.linalg.solve(a + ALL_RIDGE * np.eye(d), b[:, :, None])[:, :, 0]
        selected = np.argsort(-np.abs(every), axis=1, kind="stable")[:, :count]
    rows = np.arange(len(own))[:, None]
    k = selected.shape[1]
    part, target = a[rows[:, :, None], selected[:, :, None], selected[:, None, :]], b[rows, selected]
    weights = np.linalg.solve(part + ridge * np.eye(k), target[:, :, None])[:, :, 0]
    intercept = (t0 - (weights * s1[rows, selected]).sum(axis=1)) / s0
    error = spread - 2 * (weights * target).sum(axis=1) + np.einsum("ri,rij,rj->r", weights, part, weights)
    r2 = 1 - error / np.where(spread > 1e-300, spread, 1)
    return selected, weights, intercept, intercept + weights.sum(axis=1), np.where(spread > 1e-300, r2, 0.0)


def local_surrogates(df, id_column, features, training, scorer, perturbations=PERTURBATIONS, num_features=NUM_FEATURES,
                     seed=42, selection="auto", ridge=RIDGE) -> DataFrame:
    """One row per row of ``df`` and selected feature, strongest first.

    Columns: id, label (1 if the score is at least 0.5), score and surrogate
    (the model's and the surrogate's probability of that label), intercept, r2,
    rank, feature, bin (how many quartiles lie below the value) and weight.
    ``training`` are the rows whose quartiles and shares the perturbations
    follow. Rows without a score are left out; a missing value is in no bin, so no
    perturbation keeps it. The perturbed rows, a fixed number, are scored once
    when this is called; everything else runs where the rows are.
    """
    features = list(features)
    require_columns(df, [id_column, *features])
    cuts = feature_cuts(training, features)
    bins = feature_bins(training, features, cuts)
    near = Neighbourhood.drawn(draws(df.sparkSession, bins, features, scorer, perturbations, seed), features)
    cut = {f: cuts.where(F.col("column") == f).select("cuts").scalar() for f in features}
    typed = df.withColumns({f: F.col(f"`{f}`").cast("double") for f in features})
    placed = typed.withColumn("_bins", F.array(*[
        F.when(F.col(f"`{f}`").isNull(), -1).otherwise(_bin(F.col(f"`{f}`"), cut[f])) for f in features]))
    rows = scorer(placed).where(F.col("score").isNotNull()).select(id_column, F.col("score").cast("double").alias("score"), "_bins")
    names = pa.array(features, pa.string())
    id_type = df.schema[id_column].dataType.simpleString()

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = batch.column(1).to_numpy(zero_copy_only=False)
            own = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
            cells, which = np.unique(own, axis=0, return_inverse=True)
            sums = [part[which.ravel()] for part in near.sums(cells)]
            selected, weights, intercept, surrogate, r2 = fitted(sums, score, num_features, selection, ridge)
            order = np.argsort(-np.abs(weights), axis=1, kind="stable")
            selected, weights = np.take_along_axis(selected, order, 1), np.take_along_axis(weights, order, 1)
            k = selected.shape[1]
            label = (score >= 0.5).astype(np.int32)
            sign, shift = np.where(label == 1, 1.0, -1.0), np.where(label == 1, 0.0, 1.0)
            many = lambda x: np.repeat(x, k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(many(np.arange(len(score))))), pa.array(many(label)), pa.array(many(shift + sign * score)),
                pa.array(many(shift + sign * surrogate)), pa.array(many(shift + sign * intercept)), pa.array(many(r2)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(score))), names.take(pa.array(selected.ravel())),
                pa.array(np.take_along_axis(own, selected, 1).ravel().astype(np.int32)), pa.array((sign[:, None] * weights).ravel())],
                [id_column, "label", "score", "surrogate", "intercept", "r2", "rank", "feature", "bin", "weight"])

    return rows.mapInArrow(solve, f"`{id_column}` {id_type}, label int, score double, surrogate double, intercept double, r2 double, "
                           "rank int, feature string, bin int, weight double")


def fidelity(surrogates) -> DataFrame:
    """1 - mean distance of model and surrogate, within [0, 1]; 0 when there is nothing to compare."""
    distance = F.avg(F.abs(F.col("score") - F.col("surrogate")))
    # least and greatest skip nulls, so the distance must be filled in first.
    return surrogates.where("rank = 1").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(distance, F.lit(1.0)))).alias("fidelity"))
