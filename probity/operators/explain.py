"""Explanations of predictions: Shapley values, model cards and the transparency report."""

from itertools import combinations
from math import comb, factorial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.checks import require_columns
from probity.functions.partitioning import dealt_out
from probity.operators.prep import sample_rows
from probity.operators.scoring import evaluation, sigmoid
from probity.operators.surrogates import local_surrogates

BACKGROUND_ROWS = 100
ZERO = 1e-12
ZERO_WARNING = "All contributions are zero — model may be constant or feature mismatch detected"
MIN_DOCUMENTED = 5


def background(df, id_column, features, rows=BACKGROUND_ROWS, seed=42) -> DataFrame:
    """A small repeatable sample that stands for the data a model was trained on."""
    return sample_rows(df, id_column, rows, seed).select(*features)


# --- Shapley values ---------------------------------------------------------------

def linear_shap(df, model, means, keep=()) -> DataFrame:
    """Exact values of a linear score for every row: weight times distance from the mean.

    ``means`` has one row with the background mean of each feature. The
    predicted class and the probability of class 1 stand beside the score.
    """
    centre = means.select(F.struct(*model.features)).scalar()
    return df.select(
        *keep, model.score().alias("score"), (model.score() >= 0).cast("int").alias("prediction"), sigmoid(model.score()).alias("probability"),
        model.score({f: centre[f] for f in model.features}).alias("base_value"),
        *[(F.lit(float(w)) * (F.col(f) - centre[f])).alias(f"phi_{f}") for f, w in zip(model.features, model.weights)])


def feature_means(rows, features) -> DataFrame:
    return rows.agg(*[F.avg(f).alias(f) for f in features])


def coalitions(count, samples=None, seed=42):
    """(masks, coefficients): the value of feature j is the sum over masks of coefficient[mask, j] * v(mask).

    Without ``samples`` every mask is used with its Shapley weight, 2 ** count
    of them. With it so many masks are sampled, and the coefficients solve the
    weighted least squares that keeps the values adding up to f(x) - base.
    """
    if samples is None:
        masks = [[s in chosen for s in range(count)]
                 for size in range(count + 1) for chosen in map(set, combinations(range(count), size))]
        total = factorial(count)
        rows = []
        for mask in masks:
            size = sum(mask)
            gain = factorial(size - 1) * factorial(count - size) / total if size else 0.0
            loss = factorial(size) * factorial(count - size - 1) / total if size < count else 0.0
            rows.append([gain if inside else -loss for inside in mask])
        return masks, rows
    return _sampled_coalitions(count, samples, seed)


def _sampled_coalitions(count, samples, seed):
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, count)
    # The kernel weight of a size is spread over its masks, so sizes are drawn by
    # it and every drawn mask weighs the same.
    odds = np.array([(count - 1) / (comb(count, int(s)) * s * (count - s)) * comb(count, int(s)) for s in sizes])
    odds /= odds.sum()
    chosen = {}
    while len(chosen) < samples and len(chosen) < 2 ** count - 2:
        size = int(rng.choice(sizes, p=odds))
        members = frozenset(rng.choice(count, size, replace=False).tolist())
        for m in (members, frozenset(range(count)) - members):
            chosen[m] = chosen.get(m, 0) + 1
        if sum(chosen.values()) > 20 * samples:
            break
    masks = [[j in m for j in range(count)] for m in chosen]
    z = np.array(masks, dtype=float)
    w = np.array(list(chosen.values()), dtype=float)
    # The last value is what the others leave of f(x) - base.
    x = z[:, :-1] - z[:, -1:]
    solve = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-9 * np.eye(count - 1), (x * w[:, None]).T)
    on_mask = solve
    on_full = -(solve @ z[:, -1])
    on_empty = -(solve @ (1 - z[:, -1]))
    block = np.zeros((len(masks) + 2, count))
    block[:-2, :-1] = on_mask.T
    block[-2, :-1], block[-1, :-1] = on_empty, on_full
    block[:-2, -1] = -on_mask.T.sum(axis=1)
    block[-2, -1] = -1 - on_empty.sum()
    block[-1, -1] = 1 - on_full.sum()
    return masks + [[False] * count, [True] * count], block.tolist()


def shapley_values(df, id_column, features, sample, scorer, samples=None, seed=42, threshold=0.5) -> DataFrame:
    """Shapley values of any model, one row per input row.

    ``scorer`` adds a ``score`` column to a DataFrame with the features (a Column
    expression, a Spark ML model or ``score_with``): the probability of class 1, which is
    predicted from ``threshold`` on. Rows are dealt out to all tasks, and every row is expanded with
    the coalitions and the background sample inside its task, and all of it is
    added up before the shuffle, so only one row per input row is sent. The empty
    coalition is the same for all rows and the full one needs no background. Values
    are exact unless ``samples`` asks for so many coalitions; ``method`` says which.
    ``trees.tree_shap`` does the same for tree ensembles without coalitions.
    """
    features = list(features)
    require_columns(df, [id_column, *features])
    spark = df.sparkSession
    every, coefficients = coalitions(len(features), samples, seed)
    of_empty = [sum(x) for x in zip(*[w for m, w in zip(every, coefficients) if not any(m)])]
    of_full = [sum(x) for x in zip(*[w for m, w in zip(every, coefficients) if all(m)])]
    mixed_ones = [(m, w) for m, w in zip(every, coefficients) if any(m) and not all(m)]
    # Rows carry the number of their coalition, the full one last; what is in it is looked up where it is needed.
    plan = spark.createDataFrame(
        [([list(m) for m, _ in mixed_ones] + [[True] * len(features)], [[float(x) for x in w] for _, w in mixed_ones] + [[float(x) for x in of_full]])],
        "inside array<array<boolean>>, weight array<array<double>>")
    inside, weight = (plan.select(c).scalar() for c in plan.columns)
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    sample_list = sample.agg(F.collect_list(F.struct(*doubles))).scalar()
    base = scorer(sample.select(*doubles)).agg(F.avg("score")).scalar()
    count = F.size(sample_list)
    own = dealt_out(df.select(id_column, *[F.col(f).cast("double").alias(f"_x_{f}") for f in features]))
    expanded = own.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(mixed_ones)) * count)).alias("_i")
    ).withColumns({"_c": F.floor(F.col("_i") / count).cast("int"), "_b": sample_list[F.col("_i") % count]})
    mixed = expanded.select(id_column, "_c", *[
        F.when(inside[F.col("_c")][j], F.col(f"_x_{f}")).otherwise(F.col("_b")[f]).alias(f) for j, f in enumerate(features)])
    full = F.col("_c") == len(mixed_ones)
    # A coalition counts by the mean over the background.
    share = F.when(full, F.col("score")).otherwise(F.col("score") / count)
    sums = scorer(mixed).groupBy(id_column).agg(
        F.max(F.when(full, F.col("score"))).alias("score"), *[F.sum(share * weight[F.col("_c")][j]).alias(f"phi_{f}") for j, f in enumerate(features)])
    return sums.select(
        id_column, base.alias("base_value"), "score",
        *[(F.col(f"phi_{f}") + base * F.lit(float(of_empty[j]))).alias(f"phi_{f}") for j, f in enumerate(features)],
        F.lit("exact" if samples is None else f"sampled {samples}").alias("method"), (F.col("score") >= threshold).cast("int").alias("prediction"))


def long_values(values, id_column, features) -> DataFrame:
    """(id, feature, contribution) rows of wide Shapley values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"phi_{f}").alias("contribution")) for f in features])
    return values.select(id_column, F.inline(pairs))


def global_importance(values, features) -> DataFrame:
    """Mean absolute contribution per feature with its rank, from one aggregate."""
    wide = values.agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in features])
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])))
    # One row per feature.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def top_features(importance, count=10) -> DataFrame:
    return importance.orderBy(F.desc(F.abs("importance")), "feature").limit(count)


def sample_predictions(df, values, id_column, features, y_true, y_pred, top=5) -> DataFrame:
    """Rows with true and predicted label and their strongest contributions."""
    parts = F.array(*[F.struct(
        (-F.abs(f"phi_{f}")).alias("strength"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
        F.col(f"phi_{f}").alias("contribution")) for f in features])
    ranked = F.slice(F.array_sort(parts), 1, top)
    joined = df.select(id_column, y_true, y_pred, *features).join(values, id_column)
    return joined.select(
        id_column, F.col(y_true).alias("true_label"), F.col(y_pred).alias("predicted_label"),
        (F.col(y_true) == F.col(y_pred)).alias("correct"), "base_value", F.posexplode(ranked).alias("position", "part"),
    ).select(
        id_column, "true_label", "predicted_label", "correct", "base_value", (F.col("position") + 1).alias("rank"),
        "part.feature", "part.value", "part.contribution")


def zero_warning(contributions) -> DataFrame:
    """(method, warning): the text where every contribution of a method is zero."""
    return contributions.groupBy("method").agg(F.bool_and(F.abs("contribution") <= ZERO).alias("zero")).select(
        "method", F.when(F.col("zero"), ZERO_WARNING).alias("warning"))


# --- Model card and transparency checks --------------------------------------------------

def model_card(train_rows, test, features, y_true, y_pred, info=None) -> DataFrame:
    """One row: quality on the test data, features, row counts, as columns and as JSON."""
    quality = evaluation(test, y_true, y_pred)
    counted = train_rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    card = quality.select(
        "accuracy", "precision", "recall", "f1", counted.alias("training_rows"), F.col("rows").alias("evaluation_rows"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        *[F.lit(v).alias(k) for k, v in (info or {}).items()])
    return card.withColumn("card", F.to_json(F.struct(*card.columns)))


def transparency_checks(importance, local_values, card, surrogates=None, min_documented=MIN_DOCUMENTED) -> DataFrame:
    """(check, passed, details) rows; the surrogate check is made only when surrogates are given."""
    documented = importance.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("global_explanation").alias("check"), (F.col("n") >= min_documented).alias("passed"),
        F.format_string(f"Documented %d features (required: {min_documented})", "n").alias("details"))

    def present(df, name, text):
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("check"), (F.col("n") > 0).alias("passed"),
            F.when(F.col("n") > 0, text).otherwise("Failed to generate: no rows").alias("details"))

    out = documented.unionByName(present(local_values, "local_explanation", "Successfully generated local SHAP explanation"))
    if surrogates is not None:
        out = out.unionByName(present(surrogates, "lime_explanation", "Successfully generated LIME explanation"))
    return out.unionByName(present(card, "model_card", "Model card generated successfully"))


def transparency_report(df, id_column, features, scorer, y_true=None, y_pred="prediction", rows=None,
                        with_surrogates=False, surrogate_rows=None, seed=42, training=None):
    """The transparency audit as DataFrames by name; without a target it is skipped and counts as passed.

    All rows are explained unless ``rows`` or ``surrogate_rows`` ask for so many. ``training`` is the
    data the model was trained on, if the caller keeps it apart.
    """
    if y_true is None or y_true not in df.columns:
        return {"status": "cancelled", "passed": True}
    sample = background(df, id_column, features, seed=seed)
    chosen = df if rows is None else sample_rows(df, id_column, rows, seed + 1)
    values = shapley_values(chosen, id_column, features, sample, scorer)
    importance = global_importance(values, features)
    card = model_card(df if training is None else training, df, features, y_true, y_pred)
    surrogates = None
    if with_surrogates:
        near = df if surrogate_rows is None else sample_rows(df, id_column, surrogate_rows, seed)
        surrogates = local_surrogates(near, id_column, features, df if training is None else training, scorer, seed=seed)
    return {
        "status": "completed", "values": values, "importance": importance, "card": card, "surrogates": surrogates,
        "checks": transparency_checks(importance, values, card, surrogates),
    }
