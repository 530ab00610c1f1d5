import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from probity.operators import fairness as fair


def groups_of(spark, rows):
    df = spark.createDataFrame(rows, "sensitive string, y_true int, y_pred int")
    return fair.group_metrics(df)


def report_of(groups, **kwargs):
    return {r["metric_name"]: r for r in fair.fairness_report(groups, **kwargs).collect()}


def test_nobody_selected_is_undefined_for_parity_and_fair_for_impact(spark):
    report = report_of(groups_of(spark, [("a", 1, 0), ("a", 0, 0), ("b", 1, 0)]))
    assert report["demographic_parity_ratio"]["value"] is None
    assert not report["demographic_parity_ratio"]["passed"]
    assert report["disparate_impact_ratio"]["value"] == 1.0
    assert report["disparate_impact_ratio"]["passed"]
    assert "nan" in report["demographic_parity_ratio"]["description"]


def test_group_without_positives_has_tpr_zero(spark):
    rows = {r["group"]: r for r in groups_of(spark, [("a", 0, 1), ("a", 0, 0), ("b", 1, 1), ("b", 1, 0)]).collect()}
    assert rows["a"]["tpr"] == 0.0 and rows["a"]["fpr"] == 0.5
    assert rows["b"]["fpr"] == 0.0 and rows["b"]["tpr"] == 0.5 and rows["b"]["tnr"] == 0.0


def test_one_group_is_equal_to_itself(spark):
    report = report_of(groups_of(spark, [("a", 1, 1), ("a", 0, 1), ("a", 0, 0)]))
    assert all(report[m]["value"] == 0.0 for m in report if m.endswith("difference"))
    assert all(report[m]["value"] == 1.0 for m in report if m.endswith("ratio"))


def test_prediction_only_takes_the_tpr_ratio(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1)], "s string, p int")
    report, _ = fair.fairness_from_predictions(df, "p", "s")
    rows = {r["metric_name"]: r["value"] for r in report.collect()}
    assert rows["equalized_odds_difference"] == 0.0
    assert rows["equalized_odds_ratio"] == 1.0


def test_undefined_tpr_ratio_fails(spark):
    report = report_of(groups_of(spark, [("a", 1, 0), ("a", 0, 1), ("b", 1, 0), ("b", 0, 1)]))
    assert report["equalized_odds_ratio"]["value"] is None and not report["equalized_odds_ratio"]["passed"]


def test_missing_group_is_left_out_and_counted(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 1, 1), ("b", 0, 0)], "sensitive string, y_true int, y_pred int")
    assert {r["group"] for r in fair.group_metrics(df).collect()} == {"a", "b"}
    assert fair.excluded_rows(df).first()["rows_excluded"] == 1


def test_threshold_zero_is_honoured(spark):
    groups = groups_of(spark, [("a", 1, 1), ("b", 1, 0)])
    report = report_of(groups, thresholds={"demographic_parity_ratio": 0.0})
    assert report["demographic_parity_ratio"]["value"] == 0.0
    assert report["demographic_parity_ratio"]["passed"]


def test_selection_keeps_order_and_ignores_unknown_names(spark):
    groups = groups_of(spark, [("a", 1, 1), ("b", 1, 1)])
    chosen = ["disparate_impact_ratio", "nonsense", "demographic_parity_ratio"]
    rows = fair.fairness_report(groups, selected=chosen).orderBy("position").collect()
    assert [r["metric_name"] for r in rows] == ["disparate_impact_ratio", "demographic_parity_ratio"]
    with pytest.raises(ValueError):
        fair.fairness_report(groups, selected=["nonsense"])


def test_custom_rules_and_their_errors(spark):
    groups = groups_of(spark, [("a", 1, 1), ("a", 0, 0), ("b", 1, 1), ("b", 0, 1)])
    rules = fair.rules_frame(spark, [
        {"name": " acc ", "base_metric": "accuracy_score", "aggregation": "min_ratio", "default_threshold": 0.4},
        {"name": "gap", "base_metric": "false_positive_rate", "aggregation": "max_difference", "comparison": "<=", "default_threshold": 0.2},
        {"name": "bad", "base_metric": "x", "aggregation": "min_ratio", "default_threshold": 0.3},
        {"name": "", "base_metric": "f1_score", "aggregation": "min_ratio"},
        {"name": "inf", "base_metric": "f1_score", "aggregation": "min_ratio", "default_threshold": float("inf")},
    ])
    report = report_of(groups, selected=["none"], rules=rules, thresholds={"acc": 0.9})
    assert report["acc"]["value"] == 0.5 and report["acc"]["threshold"] == 0.9 and not report["acc"]["passed"]
    assert report["gap"]["value"] == 1.0 and not report["gap"]["passed"]
    assert report["bad"]["value"] == 0.0 and report["bad"]["threshold"] == 0.3 and not report["bad"]["passed"]
    assert report["bad"]["description"].startswith("Custom rule error: Custom rule 'bad': unsupported base_metric")
    assert not report["unknown_custom_rule"]["passed"] and not report["inf"]["passed"]
    assert report["acc"]["description"] == (
        "Custom rule 'acc': min_ratio(accuracy_score) = 0.500. Failed threshold >= 0.90.")


def test_result_rows_and_their_group_rows(spark):
    groups = groups_of(spark, [("a", 1, 1), ("a", 0, 0), ("b", 1, 1)])
    rows = {r["metric_name"]: r for r in fair.result_rows("v", fair.fairness_report(groups), groups).collect()}
    assert len(rows) == 7 and rows["group_confusion_matrices"]["passed"]
    assert json.loads(rows["group_confusion_matrices"]["details"]) == {"groups": 2}
    values = {(r["metric_name"], r["part"], r["group"]): r["value"] for r in fair.group_value_rows("v", groups).collect()}
    assert values["demographic_parity_ratio", "selection_rate", "a"] == 0.5 and values["demographic_parity_ratio", "selection_rate", "b"] == 1.0
    assert values["equalized_odds_ratio", "tpr", "a"] == 1.0 and values["group_confusion_matrices", "tn", "a"] == 1.0
    assert len(values) == 2 * 12


def test_stored_rules_apply_when_none_are_given(spark):
    stored = spark.createDataFrame(
        [(1, "fairness", "old", "f1_score", "min_ratio", ">=", 0.8, "2024-01-01"),
         (1, "fairness", "new", "f1_score", "min_ratio", ">=", 0.8, "2024-02-01"),
         (2, "fairness", "other", "f1_score", "min_ratio", ">=", 0.8, "2024-02-01"),
         (1, "privacy", "p", "f1_score", "min_ratio", ">=", 0.8, "2024-02-01")],
        "project_id int, principle string, name string, base_metric string, aggregation string, comparison string, "
        "default_threshold double, created_at string")
    names = [r["name"] for r in fair.rules_in_effect(stored, 1).orderBy("position").collect()]
    assert names == ["new", "old"]
    given = fair.rules_in_effect(stored, 1, spark, [{"name": "mine", "base_metric": "f1_score", "aggregation": "min_ratio"}])
    assert [r["name"] for r in given.collect()] == ["mine"]


row = st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 1), st.integers(0, 1))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=30))
def test_properties(spark, rows):
    groups = groups_of(spark, rows)
    counts = groups.collect()
    assert sum(g["tp"] + g["fp"] + g["fn"] + g["tn"] for g in counts) == len(rows)
    report = report_of(groups)
    value = {m: r["value"] for m, r in report.items()}
    assert 0 <= value["disparate_impact_ratio"] <= 1
    if any(p for _, _, p in rows):
        assert value["demographic_parity_ratio"] == value["disparate_impact_ratio"]
    assert value["equalized_odds_difference"] >= value["equal_opportunity_difference"]
