"""Shapley values of tree ensembles against coalitions, and against the models' own scores."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from probity.operators import explain, scoring, training, trees

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.normal(size=4))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    return df.withColumn("y", (F.col("a") * F.col("b") + F.col("c") > 0).cast("int"))


def random_tree(rng, depth, width):
    nodes, todo = {}, [(0, 0)]
    while todo:
        at, level = todo.pop()
        if level == depth or (level and rng.random() < 0.2):
            nodes[at] = (float(rng.normal()), -1, 0.0, -1, -1)
        else:
            nodes[at] = (0.0, int(rng.integers(width)), float(rng.normal()), 2 * at + 1, 2 * at + 2)
            todo += [(2 * at + 1, level + 1), (2 * at + 2, level + 1)]
    return nodes


def walk(nodes, x):
    at = 0
    while nodes[at][1] >= 0:
        at = nodes[at][3] if x[nodes[at][1]] <= nodes[at][2] else nodes[at][4]
    return nodes[at][0]


def by_coalitions(forest, x, background):
    width = len(x)
    masks, weights = explain.coalitions(width)
    worth = [np.mean([sum(walk(t, np.where(m, x, b)) for t in forest) for b in background]) for m in masks]
    return np.array(weights).T @ worth


@pytest.mark.parametrize("tabulated", [0, 2, 8])
@pytest.mark.parametrize("depth, width", [(0, 3), (1, 1), (4, 3), (6, 6)])
def test_leaves_give_the_values_of_coalitions(monkeypatch, tabulated, depth, width):
    monkeypatch.setattr(trees, "TABULATED", tabulated)
    rng = np.random.default_rng(depth * 10 + width)
    forest = [random_tree(rng, depth, width) for _ in range(3)]
    background, rows = rng.normal(size=(9, width)), rng.normal(size=(5, width))
    rows[0, 0] = np.nan
    background[1, -1] = np.nan
    explainer = trees.TreeEnsemble.of_nodes([f"x{i}" for i in range(width)], forest).explainer(background)
    phi, score = explainer(rows)
    assert score == pytest.approx([sum(walk(t, x) for t in forest) for x in rows])
    assert explainer.base == pytest.approx(np.mean([sum(walk(t, b) for t in forest) for b in background]))
    for x, own in zip(rows, phi, strict=True):
        assert own == pytest.approx(by_coalitions(forest, x, background), abs=1e-12)


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting", "tree"])
def test_fitted_models(spark, data, name):
    if name == "tree":
        from pyspark.ml import Pipeline

        pipeline = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), DecisionTreeClassifier(labelCol="y", maxDepth=4)])
    else:
        pipeline = training.estimators(FEATURES, "y", trees=6, boosting_rounds=4)[name]
    model = pipeline.fit(data)
    ensemble = trees.TreeEnsemble.of_model(model.stages[-1], FEATURES, spark)
    sample = explain.background(data, "id", FEATURES, rows=15)
    values = trees.tree_shap(scoring.score_pipeline(data, model), "id", ensemble, sample, keep={"probability": "p", "prediction": "q"}).toPandas()
    assert np.allclose(values.probability, values.p) and (values.prediction == values.q).all()
    assert np.allclose(values.base_value + values[[f"phi_{f}" for f in FEATURES]].sum(axis=1), values.score)
    few = explain.shapley_values(data.where("id < 8"), "id", FEATURES, sample, lambda df: df.withColumn("score", ensemble.score())).toPandas()
    both = few.merge(values, on="id", suffixes=("_c", "_t"))
    for c in ("base_value", "score", *[f"phi_{f}" for f in FEATURES]):
        assert np.allclose(both[f"{c}_c"], both[f"{c}_t"], atol=1e-12), c


def test_importance_missing_values_and_plan(spark, data):
    ensemble = trees.TreeEnsemble.of_nodes(FEATURES, [random_tree(np.random.default_rng(3), 3, 4)])
    sample = explain.background(data, "id", FEATURES, rows=10)
    holes = data.withColumn("a", F.when(F.col("id") % 3 != 0, F.col("a")))
    values = trees.tree_shap(holes, "id", ensemble, sample)
    assert values.count() == 200 and values.where("score IS NULL OR phi_a IS NULL").count() == 0
    assert explain.global_importance(values, FEATURES).count() == 4
    assert "Exchange" not in values._jdf.queryExecution().executedPlan().toString()
    assert trees.tree_shap(holes.where("false"), "id", ensemble, sample).count() == 0


def test_local_rows_say_class_and_probability(spark, data):
    model = scoring.LinearModel(tuple(FEATURES), (1.0, -1.0, 0.5, 0.0), 0.1)
    sample = explain.background(data, "id", FEATURES, rows=10)
    linear = explain.linear_shap(data, model, explain.feature_means(sample, FEATURES), ["id"]).toPandas().set_index("id").sort_index()
    assert ((linear.score >= 0) == linear.prediction).all() and np.allclose(linear.probability, 1 / (1 + np.exp(-linear.score)))
    own = explain.shapley_values(data, "id", FEATURES, sample, lambda d: d.withColumn("score", scoring.sigmoid(model.score())))
    own = own.toPandas().set_index("id").sort_index()
    assert (own.prediction == linear.prediction).all() and np.allclose(own.score, linear.probability)
    assert np.allclose(own.base_value + own[[f"phi_{f}" for f in FEATURES]].sum(axis=1), own.score)
