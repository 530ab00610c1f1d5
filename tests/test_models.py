import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from probity.operators import binned, elicit, explain, scoring, surrogates, templates, training
from probity.operators.prep import stratified_split

FEATURES = ("a", "b", "c")
MODEL = scoring.LinearModel(FEATURES, (2.0, -1.0, 0.5), 0.25)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(300)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double").persist()


def test_any_model_values_equal_the_linear_formula(data):
    sample = explain.background(data, "id", FEATURES)
    rows = data.where("id < 10")
    exact = explain.shapley_values(rows, "id", FEATURES, sample, lambda d: d.withColumn("score", MODEL.score()))
    linear = explain.linear_shap(rows, MODEL, explain.feature_means(sample, FEATURES), keep=["id"])
    got, want = exact.orderBy("id").collect(), linear.orderBy("id").collect()
    for g, w in zip(got, want):
        for f in FEATURES:
            assert g[f"phi_{f}"] == pytest.approx(w[f"phi_{f}"], abs=1e-9)
        assert g["base_value"] + sum(g[f"phi_{f}"] for f in FEATURES) == pytest.approx(g["score"], abs=1e-9)


def test_values_add_up_for_a_curved_model(data):
    sample = explain.background(data, "id", FEATURES, rows=20)
    scorer = lambda d: d.withColumn("score", scoring.sigmoid(F.col("a") * F.col("b") - F.col("c")))
    for r in explain.shapley_values(data.where("id < 5"), "id", FEATURES, sample, scorer).collect():
        assert r["base_value"] + r["phi_a"] + r["phi_b"] + r["phi_c"] == pytest.approx(r["score"], abs=1e-9)


def test_sampled_coalitions_are_exact_for_linear_models():
    count = 15
    masks, weights = explain.coalitions(count, samples=300)
    rng = np.random.default_rng(1)
    effects = rng.normal(size=count)
    worth = np.array(masks, dtype=float) @ effects + 3.0
    values = np.array(weights).T @ worth
    assert np.allclose(values, effects, atol=1e-5)
    assert np.isclose(values.sum(), worth[-1] - worth[-2])


def test_sampled_coalitions_run_in_spark(spark):
    names = [f"x{i}" for i in range(14)]
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=14))) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names))
    model = scoring.LinearModel(tuple(names), tuple(float(i) for i in range(14)), 0.0)
    sample = explain.background(df, "id", names, rows=5)
    out = explain.shapley_values(df.where("id < 2"), "id", names, sample, lambda d: d.withColumn("score", model.score()), samples=200)
    means = explain.feature_means(sample, names)
    want = {r["id"]: r for r in explain.linear_shap(df.where("id < 2"), model, means, ["id"]).collect()}
    for r in out.collect():
        assert r["phi_x13"] == pytest.approx(want[r["id"]]["phi_x13"], abs=1e-4)


def test_python_and_spark_models_score_the_same(data):
    batch = scoring.score_with(data, FEATURES, lambda x: 2 * x["a"] - x["b"] + 0.5 * x["c"] + 0.25, "score double")
    both = batch.join(MODEL.transform(data).select("id", F.col("score").alias("other")), "id")
    assert both.where(F.abs(F.col("score") - F.col("other")) > 1e-9).count() == 0


def test_zoo(spark, data):
    df = MODEL.transform(data).select("id", *FEATURES, F.col("prediction").alias("y"))
    models, quality, failures = training.train_zoo(df, FEATURES, "y", "id", trees=5, boosting_rounds=3)
    assert set(models) == {"logistic_regression", "random_forest", "gradient_boosting"} and not failures
    rows = {(r["model"], r["split"]): r for r in quality.collect()}
    assert rows[("logistic_regression", "train")]["accuracy"] > 0.9 and len(rows) == 6
    assert rows[("random_forest", "train")]["rows"] + rows[("random_forest", "test")]["rows"] == 300
    assert training.train_zoo(df.withColumn("y", F.lit(1)), FEATURES, "y", "id")[0] == {}


def test_exact_values_at_ranks(spark):
    rng = np.random.default_rng(1)
    odd = {"a": np.r_[rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500), [0.0, -0.0] * 100],
           "b.c": rng.integers(-50, 50, 700).astype(float), "d": np.exp(rng.normal(size=700) * 5), "e": np.full(700, -3.5)}
    df = spark.createDataFrame([tuple(map(float, row)) for row in zip(*odd.values())], [*odd]).repartition(3)
    ranks = [0, 5, 13, 100, 350, 400, 698, 699]
    assert binned.values_at_ranks(df, [*odd], ranks) == [[float(np.sort(v)[r]) for r in ranks] for v in odd.values()]


def test_cuts_between_bins(spark):
    rows = [(float(i), float(i % 3) * 10, 7.0, 0.0 if i % 10 else float(i)) for i in range(1000)]
    many, few, one, tied = binned.cuts_between_bins(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"], 8)
    assert many == [124.0, 249.0, 374.0, 499.0, 624.0, 749.0, 874.0]
    assert few == [5.0, 15.0] and one == [] and tied == [0.0]


def test_cells_draw_as_their_rows_would(spark):
    cells = spark.createDataFrame([(float(i), 400) for i in range(300)], "x double, n long").repartition(2, "x")
    first, again = ([r[2:] for r in sorted(binned.drawn(cells, ["x"], 20, 7).collect())] for _ in range(2))
    found = np.array(first)
    assert first == again and abs(found.mean() - 400) < 2 and 340 < found.var() < 460


def test_zoo_of_many_rows_is_that_of_its_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = [(int(a), int(b), int(c)) for a, b, c in rng.integers(0, (6, 5, 4), (4000, 3))]
    rows = [(i, *map(float, v), int(v[0] * v[1] - 3 * v[2] + rng.normal() * 3 > 1)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    plain, quality, _ = training.train_zoo(df, FEATURES, "y", "id", trees=30, boosting_rounds=6)
    fitted, own = [], GBTClassifier.fit

    def fit(self, data, params=None):
        fitted.append(data.count())
        return own(self, data, params)

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    monkeypatch.setattr(training, "MANY_ROWS", 1000)
    models, counted, failures = training.train_zoo(df, FEATURES, "y", "id", trees=30, boosting_rounds=6)
    assert not failures and fitted[0] <= 2 * 6 * 5 * 4
    found, want = ({(r["model"], r["split"]): r for r in q.collect()} for q in (counted, quality))
    # Boosted trees are the same; a forest's draws are others.
    assert set(found) == set(want) and all(found[k] == want[k] for k in want if k[0] != "random_forest")
    for k in want:
        assert found[k]["accuracy"] == pytest.approx(want[k]["accuracy"], abs=0.03) and found[k]["rows"] == want[k]["rows"]
    assert len(models["random_forest"].stages[-1].trees) == 30
    # The models compare the features themselves, and score rows as the cells were scored.
    both = stratified_split(df, "y", "id")
    for name, model in models.items():
        again = scoring.evaluation(scoring.score_pipeline(both, model), "y", "prediction", ["split"]).collect()
        assert {r["split"]: r for r in again} == {s: type(r)(**{c: v for c, v in r.asDict().items() if c != "model"}) for (m, s), r in found.items() if m == name}
    rounds = {k: scoring.score_pipeline(df, m["gradient_boosting"]).select("id", F.round("probability", 9)).orderBy("id").collect() for k, m in (("rows", plain), ("cells", models))}
    assert rounds["rows"] == rounds["cells"]


def test_a_failed_model_is_no_result(data, monkeypatch):
    df = MODEL.transform(data).select("id", *FEATURES, F.col("prediction").alias("y"))
    own = training.estimators

    def broken(*args, **kwargs):
        found = own(*args, **kwargs)
        found["random_forest"].getStages()[-1].setMaxDepth(31)
        return found

    monkeypatch.setattr(training, "estimators", broken)
    some = {"trees": 3, "boosting_rounds": 2, "names": ["logistic_regression", "random_forest"]}
    with pytest.raises(RuntimeError, match="random_forest: .*maxDepth"):
        training.train_zoo(df, FEATURES, "y", "id", **some)
    models, quality, failures = training.train_zoo(df, FEATURES, "y", "id", partial=True, **some)
    assert set(models) == {r["model"] for r in quality.collect()} == {"logistic_regression"} and set(failures) == {"random_forest"}


def test_missing_features_are_zeros_to_the_zoo(data):
    df = MODEL.transform(data).select("id", *FEATURES, F.col("prediction").alias("y"))
    odd = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, float("nan")).when(F.col("id") % 7 == 2, float("-inf"))
    tables = [training.train_zoo(df.withColumn("b", value), FEATURES, "y", "id", trees=3, boosting_rounds=2)[1] for value in (
        odd.otherwise(F.col("b")), F.when(F.col("id") % 7 > 2, F.col("b")).otherwise(0.0))]
    holes, zeros = (sorted(t.collect()) for t in tables)
    assert len(holes) == 6 and holes == zeros


def test_registered_model_queries_do_their_whole_job(spark, small, monkeypatch):
    from inspect import signature

    from probity.plans import model_queries

    asked, explained = [], []
    plain, own = signature(training.train_zoo), surrogates.local_surrogates

    def zoo(*args, **kwargs):
        call = plain.bind(*args, **kwargs)
        call.apply_defaults()
        asked.append((call.arguments["trees"], call.arguments["boosting_rounds"]))
        return {}, None, {}

    def counted(df, *args, **kwargs):
        explained.append(df.count())
        return own(df, *args, **kwargs)

    monkeypatch.setattr(training, "train_zoo", zoo)
    monkeypatch.setattr(surrogates, "local_surrogates", counted)
    model_queries.train_model_zoo(spark, small)
    assert asked == [(200, 100)]
    rows = model_queries.loans(spark, small).count()
    values = model_queries.explain_local_surrogates(spark, small)
    assert values.select("row_id").distinct().count() == rows
    model_queries.explain_fidelity(spark, small)
    assert explained == [rows, rows]


def test_probabilities(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1000.0], 2)], "s array<double>, y int")
    row = df.select(scoring.softmax(F.col("s")).alias("p"), scoring.one_hot(F.col("y"), 4).alias("h")).first()
    assert row["p"] == pytest.approx([0.0, 0.0, 1.0]) and row["h"] == [0.0, 0.0, 1.0, 0.0]


def test_report_is_skipped_without_a_target(data):
    assert explain.transparency_report(data, "id", FEATURES, None) == {"status": "cancelled", "passed": True}


def test_zero_contributions_are_warned_about(spark):
    df = spark.createDataFrame([("shap", 0.0), ("shap", 1e-13), ("lime", 0.0), ("lime", 0.1)], "method string, contribution double")
    rows = {r["method"]: r["warning"] for r in explain.zero_warning(df).collect()}
    assert rows == {"shap": explain.ZERO_WARNING, "lime": None}


def test_elicited_from_a_dataset(spark):
    df = spark.createDataFrame([("m", 1, 1.0)] * 9 + [("f", 0, 2.0)], "gender string, y int, age double")
    checks = {r["check_id"]: r for r in elicit.dataset_checks(df, ["gender", "y"], "unknown mode").collect()}
    assert checks["dataset_imbalance_gender"]["status"] == "triggered" and checks["dataset_imbalance_gender"]["value"] == 0.9
    assert checks["dataset_imbalance_gender"]["threshold"] == 0.3
    assert checks["dataset_pii_detection"]["value"] == 1.0
    rows = {r["name"]: r for r in elicit.dataset_suggestions(elicit.dataset_checks(df, ["gender"]), "d").collect()}
    assert rows["Fairness — Demographic Parity on 'gender'"]["confidence_score"] == 0.95
    none = {r["check_id"]: r["status"] for r in elicit.dataset_checks(df.select("y")).collect()}
    assert none["dataset_sensitive_attributes_available"] == "skipped"
    proxies = {r["column"]: r for r in elicit.proxy_correlations(df, "gender").collect()}
    assert proxies["age"]["is_proxy"] and proxies["age"]["correlation"] == pytest.approx(-1.0)
    few = elicit.proxy_correlations(df.limit(9), "gender").collect()
    assert not any(r["is_proxy"] for r in few)


def test_elicited_from_a_model(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 0)], "g string, prediction int")
    quiet = {r["check_id"]: r for r in elicit.model_checks(df, ["x"], ["g"]).collect()}
    assert quiet["model_baseline_monitoring"]["status"] == "triggered"
    assert elicit.model_suggestions(elicit.model_checks(df, ["x"], ["g"])).first()["confidence_score"] == 0.7
    loud = spark.createDataFrame([("a", 1)] * 9 + [("b", 0)], "g string, prediction int")
    rows = {r["check_id"]: r for r in elicit.model_checks(loud, ["x"] * 20, ["g", "h"]).collect()}
    assert rows["model_prediction_imbalance"]["value"] == 0.8 and rows["model_disparate_impact_g"]["value"] == 0.0
    assert rows["model_disparate_impact_h"]["status"] == "skipped" and rows["model_feature_count"]["status"] == "triggered"
    same = spark.createDataFrame([("a", 1), ("b", 1)], "g string, prediction int")
    assert {r["check_id"]: r["status"] for r in elicit.model_checks(same, ["x"], []).collect()}["model_prediction_imbalance"] == "skipped"


def test_templates(spark):
    built = templates.built_in(spark)
    assert built.count() == 26
    row = templates.with_baseline(built).where("template_id = 'GEN-PRIVACY'").first()
    assert [i["metric"] for i in row["items"]] == ["pii_count", "pii_without_consent", "k_anonymity", "l_diversity"]
    names = [r["template_id"] for r in templates.list_templates(built, domain="finance", search="fraud").collect()]
    assert names == ["FIN-FRAUD-01"]
    one = built.where("template_id = 'ETH3'")
    clone = templates.customise(one, overrides=[{"index": 0, "value": 0.5}, {"index": 9, "value": 1}], remove=[1], add=[{"metric": "m", "value": 2}]).first()
    assert [(i["metric"], i["value"]) for i in clone["items"]] == [("equalized_odds_ratio", 0.5), ("audit_trail_required", 1.0), ("m", 2.0)]
    assert clone["template_id"] == "ETH3-custom" and clone["version"] == 1
    settings = templates.validation_settings(one).first()
    assert settings["validators"] == ["accountability", "fairness"] and settings["k"] == 5
    choice = spark.createDataFrame([("p", "ETH4")], "project_id string, template_id string")
    made = templates.apply_to_projects(choice, built).orderBy("position").collect()
    assert made[2]["name"] == "pii_in_features (ETH4)" and made[2]["principle"] == "fairness"
    assert made[0]["specification"].startswith('{"rules":[{"metric":"demographic_parity_ratio","operator":">=","value":0.8')


def test_elicited_from_a_model_on_raw_data(spark):
    rows = [(i, "a" if i % 4 else "b", None if i % 5 == 0 else float(i), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y int")
    seen = []

    def predict(encoded):
        seen.append(encoded.columns)
        return encoded.withColumn("prediction", (F.col("x") + 100 * F.col("g") > 110).cast("int"))

    checks = {r["check_id"]: r for r in elicit.model_elicitation(df, "id", predict, "y", ["g"], 2).collect()}
    assert checks["model_feature_compatibility"]["position"] == 0 and checks["model_feature_compatibility"]["value"] == 2.0
    # b comes first and is 0, a is 1; a missing x is 0: only an a with x over 10 is predicted.
    assert checks["model_disparate_impact_g"]["status"] == "triggered" and checks["model_disparate_impact_g"]["value"] == 0.0
    assert '"lowest":{"group":"b","rate":0.0}' in checks["model_disparate_impact_g"]["metadata"]
    assert seen[0] == ["id", "g", "x", "_raw_g"]
    with pytest.raises(ValueError, match="expects 5 features, dataset provides 2"):
        elicit.model_elicitation(df, "id", predict, "y", ["g"], 5)
    none = elicit.model_elicitation(df.where("false"), "id", predict, "y", ["g"], 2).collect()
    assert [r["check_id"] for r in none] == ["model_feature_matrix_non_empty"]
    assert elicit.model_elicitation(df.select("id", "y"), "id", predict, "y").first()["check_id"] == "model_feature_matrix_non_empty"


def test_proxies_of_all_attributes_at_once(spark):
    rng = np.random.default_rng(8)
    rows = [(("x", "y", "z")[i % 3], i % 7, float(i % 3) + 1e6, float(rng.normal()), 5.0, None if i % 2 else float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows + [(None, None, 1.0, 1.0, 5.0, 1.0)], "g string, k int, near double, far double, same double, hole double")
    pdf = df.toPandas()
    pdf["code"] = pdf.g.map({"x": 0, "y": 1, "z": 2})
    got = {(r["attribute"], r["column"]): r for r in elicit.proxy_matrix(elicit.class_moments(df, ["g", "k"])).collect()}
    assert set(got) == {(a, c) for a in ("g", "k") for c in ("k", "near", "far", "same", "hole")} - {("k", "k")}
    for (a, c), r in got.items():
        both = pdf[["code" if a == "g" else a, c]].dropna()
        assert r["shared_rows"] == len(both)
        if c == "same":
            assert r["correlation"] is None and not r["is_proxy"]
        else:
            assert r["correlation"] == pytest.approx(both.iloc[:, 0].corr(both.iloc[:, 1]), abs=1e-9)
    assert got["g", "near"]["is_proxy"] and got["k", "hole"]["is_proxy"] and not got["g", "far"]["is_proxy"]
