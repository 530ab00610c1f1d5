import datetime

import pytest
from pyspark.sql import functions as F

from probity.operators import accountability as acc
from probity.operators import catalogue, history, remediation, reports, trace

DAY = datetime.datetime


@pytest.fixture(scope="module")
def tables(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "requirements": make([(1, 10, "fair loans", "fairness"), (2, 10, "private", "privacy"), (3, 20, "other", "fairness")],
                             "requirement_id int, project_id int, name string, principle string"),
        "models": make([(5, 10, "scorer"), (6, 20, "second")], "model_id int, project_id int, name string"),
        "datasets": make([(7, 10, "loans", "gender")], "dataset_id int, project_id int, name string, sensitive_attribute string"),
        "validations": make(
            [(100, 1, 5, 7, "completed", DAY(2024, 1, 1)), (101, None, 5, 99, "failed", DAY(2024, 1, 2)),
             (102, 3, 5, 7, "completed", DAY(2024, 1, 3)), (103, 1, 5, 7, "running", DAY(2024, 1, 4))],
            "validation_id int, requirement_id int, model_id int, dataset_id int, status string, created_at timestamp"),
        "results": make(
            [(100, 1, "fairness", "demographic_parity_ratio", 0.7, 0.8, False),
             (100, 2, "fairness", "demographic_parity_ratio", 0.9, 0.8, True),
             (100, 3, "fairness", "group_confusion_matrices", None, None, True),
             (101, 1, "privacy", "k_anonymity", 2.0, 5.0, False), (101, 2, "fairness", "equalized_odds_ratio", 0.9, 0.8, True),
             (102, 1, "privacy", "custom", 1.0, 1.0, True)],
            "validation_id int, result_no bigint, principle string, metric_name string, metric_value double, threshold double, passed boolean"),
        "suites": make(
            [(50, 5, 7, 100, None, 101, "completed", True, DAY(2024, 1, 2)),
             (51, 5, 7, 999999999, 103, None, "completed", False, DAY(2024, 1, 5))],
            "suite_id int, model_id int, dataset_id int, fairness_validation_id int, transparency_validation_id int, "
            "privacy_validation_id int, status string, overall_passed boolean, started_at timestamp"),
    }


def matrix(tables, **kwargs):
    names = ("requirements", "models", "datasets", "validations", "results", "suites")
    return trace.traceability_matrix(*[tables[n] for n in names], **kwargs)


def test_matrix(tables):
    rows = {r["validation_id"]: r for r in matrix(tables).collect() if r["validation_id"]}
    assert rows[100]["status"] == "fail" and rows[100]["requirement_name"] == "fair loans" and rows[100]["suite_id"] == 50
    assert rows[101]["principle"] == "multiple" and rows[101]["requirement_id"] is None and rows[101]["dataset_name"] is None
    # The requirement belongs to another project than the model, so the validation is not linked.
    assert rows[102]["requirement_id"] is None and rows[102]["principle"] == "privacy" and rows[102]["status"] == "pass"
    assert rows[103]["status"] == "unknown" and rows[103]["metrics_total"] == 0
    untested = [(r["project_id"], r["requirement_id"]) for r in matrix(tables).where("status = 'not_validated'").collect()]
    assert sorted(untested) == [(10, 2), (20, 3)]
    assert matrix(tables, project_id=20).count() == 1


def test_summary(tables):
    rows = {r["project_id"]: r for r in trace.traceability_summary(matrix(tables), tables["requirements"]).collect()}
    assert rows[10]["total_requirements"] == 2 and rows[10]["total_validations"] == 4
    assert rows[10]["pass_rate"] == pytest.approx(33.3) and rows[20]["pass_rate"] == 0.0


def test_filter(tables):
    traces = matrix(tables)
    assert trace.filter_traces(traces, search="LOANS").count() == 2
    assert trace.filter_traces(traces, status="pass").count() == 1
    assert trace.filter_traces(traces, model_id=6, models=tables["models"]).count() == 0


def test_causes_and_patterns(tables):
    causes = {r["metric_name"]: r for r in trace.root_causes(tables["results"], tables["validations"], tables["datasets"]).collect()}
    assert causes["demographic_parity_ratio"]["gap"] == pytest.approx(0.1)
    assert "defined by 'gender'. Metric demographic_parity_ratio = 0.700 vs threshold 0.800." in causes["demographic_parity_ratio"]["description"]
    assert causes["k_anonymity"]["description"].startswith("k-Anonymity check failed: some groups have fewer than 5.0 identical")
    patterns = {r["validation_id"]: r["behavior_pattern"] for r in trace.behaviour_patterns(tables["validations"], tables["results"]).collect()}
    assert patterns[100] == "demographic_parity_ratio: 0.900 — model shows acceptable group parity."
    assert patterns[103] == trace.NO_RESULTS
    nothing = trace.behaviour_patterns(tables["validations"], tables["results"].where("metric_value IS NULL"))
    assert {r["validation_id"]: r["behavior_pattern"] for r in nothing.collect()}[100] == trace.NO_PATTERN


def test_dataset_impact(tables):
    rows = {r["requirement_id"]: r for r in trace.dataset_impact(7, tables["datasets"], tables["requirements"], tables["validations"]).collect()}
    assert rows[1]["validation_count"] == 2 and rows[1]["latest_validation_id"] == 103
    assert rows[2]["validation_count"] == 0 and 3 not in rows
    usage = {r["dataset_id"]: r for r in trace.dataset_usage(tables["validations"]).collect()}
    assert usage[99]["unlinked_validations"] == 1


def test_history(tables):
    rows = {(r["suite_id"], r["principle"]): r for r in history.suite_history(
        tables["suites"], tables["models"], tables["datasets"], tables["results"]).collect()}
    assert rows[(50, "fairness")]["metrics_count"] == 3 and rows[(50, "fairness")]["passed_count"] == 2
    assert not rows[(50, "transparency")]["completed"]
    assert rows[(51, "fairness")]["completed"] and rows[(51, "fairness")]["metrics_count"] == 0
    newest = history.newest_suites(tables["suites"], tables["models"], limit=1).collect()
    assert [r["suite_id"] for r in newest] == [51]


def test_two_values_for_one_metric_keep_the_last(tables):
    metrics = history.suite_metrics(tables["suites"], tables["results"])
    fair = metrics.where("suite_id = 50 AND principle = 'fairness'").collect()
    assert [(r["metric_name"], r["value"]) for r in fair] == [("demographic_parity_ratio", 0.9)]
    maps = {(r["suite_id"], r["principle"]): r["metrics"] for r in history.metric_maps(metrics).collect()}
    assert maps[(50, "fairness")]["demographic_parity_ratio"]["passed"]


def test_compare(spark):
    metrics = spark.createDataFrame(
        [(1, "fairness", "a_ratio", 0.5), (2, "fairness", "a_ratio", 0.7), (1, "fairness", "b_difference", 0.2),
         (2, "fairness", "b_difference", 0.1), (2, "privacy", "k", 5.0), (1, "fairness", "same", 1.0), (2, "fairness", "same", 1.0)],
        "suite_id int, principle string, metric_name string, value double")
    pairs = spark.createDataFrame([(1, 2)], "run_a int, run_b int")
    rows = {r["metric_name"]: r for r in history.compare_runs(metrics, pairs).collect()}
    assert rows["a_ratio"]["improved"] and rows["b_difference"]["improved"]
    assert rows["k"]["delta"] is None and rows["k"]["improved"] is None
    assert rows["same"]["delta"] == 0.0 and rows["same"]["improved"] is None


def test_trend_needs_two_runs(spark):
    suites = spark.createDataFrame([(1, 9, "2024"), (2, 9, "2025"), (3, 8, "2024")], "suite_id int, model_id int, started_at string")
    metrics = spark.createDataFrame(
        [(i, "fairness", "m", float(i)) for i in (1, 2, 3)], "suite_id int, principle string, metric_name string, value double")
    rows = history.metric_trend(suites, metrics, ["m", "n"]).collect()
    assert sorted((r["suite_id"], r["m"], r["n"]) for r in rows) == [(1, 1.0, None), (2, 2.0, None)]


def test_verdict(spark):
    parts = spark.createDataFrame(
        [(1, True, None, None), (2, None, False, "completed"), (3, True, True, "failed"), (4, True, True, "skipped")],
        "suite_id int, fairness_passed boolean, privacy_passed boolean, transparency_status string")
    assert {r["suite_id"]: r["overall_passed"] for r in history.suite_verdict(parts).collect()} == {1: True, 2: False, 3: False, 4: True}
    assert history.validators_to_run() == ["fairness", "transparency", "privacy", "accountability"]
    assert history.validators_to_run(["PRIVACY", "Fairness"]) == ["fairness", "privacy"]


@pytest.fixture(scope="module")
def wide(spark, tables):
    facts = spark.createDataFrame([(101, '{"overall_passed":false,"pii_detected":["a","b","c","d"],"k_anonymity":{"k_value":5,"satisfies_k":false}}'),
                                   (103, "{broken")], "run_id int, payload string")
    parsed = facts.withColumn("facts", F.from_json("payload", reports.ARTIFACT_FIELDS)).drop("payload")
    return reports.sections(tables["suites"], tables["validations"], tables["results"], parsed)


def test_reports(wide):
    summary = {r["suite_id"]: r["executive_summary"] for r in reports.executive_summary(wide).collect()}
    assert summary[50] == (
        "Model passed 1 out of 1 completed ethical validation sections. "
        "No major ethical validation failures were detected in completed sections.")
    assert summary[51] == "No completed validation sections were found for this suite yet."
    lines = {}
    for r in reports.recommendations(wide).orderBy("suite_id", "position").collect():
        lines.setdefault(r["suite_id"], []).append(r["recommendation"])
    assert lines[50] == [
        "Run transparency validation and publish model-card evidence for governance reviews.",
        "Remove, mask, or tokenize detected PII columns (a, b, c) before model training/inference.",
        "Improve quasi-identifier generalization/suppression to satisfy k-anonymity (target k=5)."]
    status = {r["suite_id"]: r for r in reports.principle_status(wide).collect()}
    assert status[50]["fairness"] == "PASS" and status[50]["transparency"] == "NOT RUN" and status[50]["privacy"] == "FAIL"
    checks = [r["check"] for r in reports.certificate_checks(wide).where("suite_id = 50").orderBy("position").collect()]
    assert checks[0] == "Demographic Parity Ratio >= 0.800: 0.900 (PASS)" and checks[-1] == "Privacy checks: not run"


def test_repeated_lines_are_given_once(spark):
    df = spark.createDataFrame([(1, 0, "Same "), (1, 1, "same"), (1, 2, "other")], "s int, position int, line string")
    rows = reports.first_of_each(df, ["s"], "line", "position").orderBy("position").collect()
    assert [r["line"] for r in rows] == ["Same ", "other"]


def test_compliance(tables):
    row = reports.project_compliance(tables["suites"], tables["models"]).first()
    assert row["total_suites"] == 2 and row["compliance_rate"] == 0.5 and row["verdict"] == "fail"
    parts = reports.custom_report(10, tables["suites"], tables["models"], matrix(tables), date_from="2024-01-03")
    assert parts["history"].count() == 1 and parts["traceability"].count() == 5
    assert set(reports.custom_report(10, tables["suites"], tables["models"], None, include=("summary",))) == {"summary"}


def test_remediation(spark, tables):
    artifacts = spark.createDataFrame([(101, '{"pii_detected":["a"],"hipaa":{"overall_passed":false}}')], "run_id int, payload string")
    parsed = artifacts.withColumn("facts", F.from_json("payload", reports.ARTIFACT_FIELDS)).drop("payload")
    failing = tables["results"].where("NOT (result_no = 2 AND validation_id = 100)")
    steps = remediation.numbered_steps(remediation.step_lists(tables["suites"], failing, parsed)).orderBy("principle", "number").collect()
    assert [s["step_id"] for s in steps] == [
        "fair-demographic_parity_ratio", "fair-revalidate", "priv-pii", "priv-hipaa", "priv-revalidate"]
    assert steps[0]["text"] == (
        "Fix failed fairness metric 'demographic_parity_ratio' (value=0.700, threshold=0.800); "
        "apply bias mitigation and reassess group impacts.")
    fresh = remediation.checklists(remediation.step_lists(tables["suites"], failing, parsed, ["fairness"]), "u")
    old = fresh.withColumn("principle", F.lit("privacy")).unionByName(fresh.withColumn("suite_id", F.lit(77)))
    out = {(r["suite_id"], r["principle"]): r["change"] for r in remediation.refresh_checklists(old, fresh, fresh).collect()}
    assert out == {(50, "fairness"): "inserted", (77, "fairness"): "kept"}
    gone = remediation.refresh_checklists(old, fresh.limit(0), old).count()  # refreshed, and nothing left to do
    assert gone == 0
    done = remediation.set_step(remediation.set_step(fresh, "fair-revalidate"), "fair-demographic_parity_ratio")
    assert remediation.with_all_done(done).first()["all_done"] and not remediation.with_all_done(fresh).first()["all_done"]


def test_runs(spark):
    starts = spark.createDataFrame([("r1", "m"), ("r2", "m")], "run_id string, model_id string")
    metrics = spark.createDataFrame([("r1", "a b", 1.0, 1), ("r1", "a-b", 2.0, 2), ("r1", "c", 3.0, 1)], "run_id string, metric string, value double, logged_at int")
    ends = spark.createDataFrame([("r1", DAY(2024, 1, 1), "e" * 3000, None)], "run_id string, completed_at timestamp, error string, passed boolean")
    rows = {r["run_id"]: r for r in acc.run_records(starts, metrics, ends).collect()}
    assert rows["r1"]["metrics"] == {"a_b": 2.0, "c": 3.0} and rows["r1"]["status"] == "error" and len(rows["r1"]["error"]) == 2000
    assert rows["r2"]["status"] == "running"


def test_long_errors_of_runs_are_not_broadcast(spark):
    starts = spark.createDataFrame([("r1", "m")], "run_id string, model_id string")
    metrics = spark.createDataFrame([("r1", "a", 1.0, 1), ("r1", None, 2.0, 2)], "run_id string, metric string, value double, logged_at int")
    ends = spark.createDataFrame([("r1", DAY(2024, 1, 1), "e", None)], "run_id string, completed_at timestamp, error string, passed boolean")
    runs = acc.run_records(starts, metrics, ends)
    joins = [x for x in runs._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert "SortMergeJoin" in joins[0]  # the last join brings the errors
    assert runs.first()["metrics"] == {"": 2.0, "a": 1.0}


def test_log_page_keeps_entries_of_unknown_users(spark):
    logs = spark.createDataFrame([(i, DAY(2024, 1, i), i, "x", "y") for i in range(1, 6)], "audit_id int, event_time timestamp, user_id int, action string, resource_type string")
    users = spark.createDataFrame([(4, "d@e.org")], "user_id int, email string")
    rows = acc.audit_log(logs, users, skip=1, limit=2, end="2024-01-05").collect()
    assert [(r["audit_id"], r["user_email"]) for r in rows] == [(4, "d@e.org"), (3, None)]


def test_notifications(spark):
    notes = spark.createDataFrame([(1, 7, False), (2, 7, False), (3, 8, False)], "notification_id int, user_id int, is_read boolean")
    assert [r["is_read"] for r in acc.mark_read(notes, 7).orderBy("notification_id").collect()] == [True, True, False]
    assert [r["is_read"] for r in acc.mark_read(notes, 7, [2, 3]).orderBy("notification_id").collect()] == [False, True, False]


def test_projects(spark):
    projects = spark.createDataFrame([(1, "a", None, DAY(2024, 1, 1)), (2, "b", DAY(2024, 1, 1), DAY(2024, 1, 1))],
                                     "project_id int, name string, deleted_at timestamp, updated_at timestamp")
    models = spark.createDataFrame([(1,), (1,)], "project_id int")
    none = models.limit(0)
    counts = catalogue.project_counts(projects, models, none, none)
    row = counts.first()
    assert row["model_count"] == 2 and row["dataset_count"] == 0 and counts.count() == 1
    assert catalogue.readiness(counts, "2024-01-01 00:01:00").first()["last_updated"] == "1 minute ago"
    ready = catalogue.readiness(counts, "2024-01-01 05:00:00").first()
    assert ready["last_updated"] == "5 hours ago" and ready["status"] == "In Progress"
    gone = catalogue.soft_delete(projects, [1], "2024-06-01 00:00:00")
    assert catalogue.live(gone).count() == 0 and gone.columns == projects.columns
    assert catalogue.dashboard_totals(counts).first()["total_assets"] == 2


def test_named_metrics_and_columns_are_an_argument(spark):
    lines = spark.createDataFrame([([" A", "b", "a ", None, "B", "c"],)], "x array<string>")
    assert lines.select(reports.unrepeated(F.array_compact("x")).alias("x")).first()["x"] == [" A", "b", "c"]
    suites = spark.createDataFrame([(1, None, None, 12)], "suite_id int, fairness_validation_id int, transparency_validation_id int, privacy_validation_id int")
    columns = [f"col{i}" for i in range(9)]
    facts = spark.createDataFrame([(12, columns)], "run_id int, pii array<string>").select("run_id", F.from_json(
        F.to_json(F.struct(F.col("pii").alias("pii_detected"))), reports.ARTIFACT_FIELDS).alias("facts"))
    results = spark.createDataFrame([], "validation_id int, result_no bigint, principle string, metric_name string, metric_value double, threshold double, passed boolean")
    text = lambda **kw: remediation.step_lists(suites, results, facts, **kw).first()["steps"][0]["text"]
    assert text() == "Mask/remove detected PII columns: col0, col1, col2, col3, col4."
    assert text(principles=["privacy"], named=None) == f"Mask/remove detected PII columns: {', '.join(columns)}."
    assert remediation.step_lists(suites, results, facts, ["fairness"]).count() == 0


def test_names_are_taken_by_kind(spark):
    assets = lambda rows: spark.createDataFrame(rows, "project_id int, user_id int, principle string, name string")
    there = assets([(1, 7, "fairness", " Loans "), (2, 7, "fairness", None)])
    new = assets([(1, 8, "privacy", "LOANS"), (1, 7, "fairness", " Loans "), (2, 7, "fairness", "Loans"), (2, 7, "fairness", None)])
    refused = lambda kind: sorted((r["user_id"], r["name"], r["reason"]) for r in catalogue.refused_names(kind, new, there).collect())
    said = "Dataset with name '{}' already exists in this project".format
    assert refused("datasets") == [(7, " Loans ", said("Loans")), (8, "LOANS", said("LOANS"))]
    assert refused("validation_presets") == [(7, " Loans ", "Preset ' Loans ' already exists")]
    assert [r[0] for r in refused("custom_rules")] == [7]


def test_ranked_assets_decide_ties_by_id(spark):
    rows = spark.createDataFrame([(1, 10, "a", "2024-01-02"), (1, 11, "b", "2024-01-02"), (1, 9, "c", "2024-01-03"), (2, 1, "d", None)],
                                 "project_id int, id int, name string, made string")
    out = catalogue.ranked_assets({"x": (rows, "id", "name", "made")}, 2)
    assert sorted((r["project_id"], r["rank"], r["name"]) for r in out.collect()) == [("1", 1, "c"), ("1", 2, "b"), ("2", 1, "d")]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in catalogue.newest_assets(rows, 1, "made", "id").collect()] == [9, 11, 10]
