"""A small zoo of classifiers trained with Spark ML."""

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from probity.functions.partitioning import packed
from probity.operators.binned import cells_of
from probity.operators.prep import finite_or_zero, stratified_split
from probity.operators.scoring import evaluation, score_pipeline

TREE_ENSEMBLES = ("random_forest", "gradient_boosting")
#: Fewer rows are fitted as they are.
MANY_ROWS = 200_000


def estimators(features, label="label", seed=42, trees=200, boosting_rounds=100):
    """The pipelines by name: scaled logistic regression, random forest, boosted trees."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return {
        "logistic_regression": Pipeline(stages=[assembled, scaled, LogisticRegression(
            featuresCol="scaled", labelCol=label, maxIter=100)]),
        "random_forest": Pipeline(stages=[assembled, RandomForestClassifier(
            labelCol=label, numTrees=trees, seed=seed)]),
        "gradient_boosting": Pipeline(stages=[assembled, GBTClassifier(
            labelCol=label, maxIter=boosting_rounds, seed=seed)]),
    }


def train_zoo(df, features, label, id_column, seed=42, trees=200, boosting_rounds=100, names=None, partial=False):
    """Fits every model on a stratified 80 % and evaluates it on both parts.

    Features are numbers; as in ``numeric_matrix``, one that is missing or not finite is 0.
    Returns (models by name, evaluation rows, failures by name). A target with
    one class trains nothing. A model that fails does not stop the others, but an error
    names it after them; with ``partial`` the others are returned, and the failures with them.
    Of very many rows the tree ensembles are fitted on and evaluated over counted cells of
    bins, where these are far fewer (``operators/binned.py``).
    """
    rows = df.select(id_column, label, *[finite_or_zero(F.col(f).cast("double")).alias(f) for f in features]).persist()
    if rows.select(label).where(F.col(label).isNotNull()).distinct().limit(2).count() < 2:
        rows.unpersist()
        return {}, None, {}
    marked = stratified_split(rows, label, id_column, seed=seed).select(label, *features, "split").persist()
    total = marked.count()  # the size of what is persisted is known only then
    rows.unpersist()
    split = packed(marked)
    if split is not marked:
        split = split.persist()
        split.count()
        marked.unpersist()
    pipelines = {k: v for k, v in estimators(features, label, seed, trees, boosting_rounds).items() if names is None or k in names}
    cells = None
    if total >= MANY_ROWS and set(pipelines) & set(TREE_ENSEMBLES):
        cells = cells_of(split, features, label, total)
    models, failures, tables, cause = {}, {}, [], None
    for name, pipeline in pipelines.items():
        try:
            if cells is not None and name in TREE_ENSEMBLES:
                binned = cells.fitted(pipeline.getStages()[-1])
                model, scored, weight = cells.of_values(binned), cells.scored(binned), "n"
            else:
                model = pipeline.fit(split.where("split = 'train'"))
                scored, weight = score_pipeline(split, model), None
        except Exception as exc:  # noqa: BLE001 - one model failing must not stop the others
            failures[name], cause = str(exc), exc
            continue
        models[name] = model
        tables.append(evaluation(scored, label, "prediction", ["split"], weight).withColumn("model", F.lit(name)))
    if failures and not partial:
        raise RuntimeError("Models that could not be fitted: " + "; ".join(f"{k}: {v}" for k, v in failures.items())) from cause
    table = reduce(lambda a, b: a.unionByName(b), tables) if tables else None
    return models, table, failures
