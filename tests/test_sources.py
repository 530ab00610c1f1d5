import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from probity.operators import templates
from probity.sources import artifacts, benchmarks, datasets, governance


def lines_of(path):
    return [row for f in sorted(glob.glob(f"{path}/part-*")) for row in csv.reader(open(f, newline=""))]


def test_csv_types_and_first_rows(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write('k,name,score,flag\n2,"a ""quoted"", text",1.5,true\n1,b,,false\n')
    df = datasets.read_dataset(spark, path)
    assert dict(df.dtypes) == {"k": "int", "name": "string", "score": "double", "flag": "boolean"}
    assert df.where("k = 2").first()["name"] == 'a "quoted", text'
    assert [r["k"] for r in datasets.read_dataset(spark, path, order_by="k", max_rows=1).collect()] == [1]
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, path, max_rows=1)


def test_normalised_copies_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, None)], "k int, s string")
    datasets.normalise(df, str(tmp_path / "copy.parquet"))
    assert datasets.read_dataset(spark, str(tmp_path / "copy.parquet")).exceptAll(df).count() == 0
    datasets.normalise(df, str(tmp_path / "copy"), as_csv=True)
    back = datasets.read_dataset(spark, str(tmp_path / "copy"), "k int, s string").orderBy("k").collect()
    assert [r["s"] for r in back] == ["=x", None]  # later stages read what was there
    datasets.normalise(df, str(tmp_path / "sheet"), as_csv=True, for_spreadsheet=True)
    sheet = datasets.read_dataset(spark, str(tmp_path / "sheet"), "k int, s string").orderBy("k").collect()
    assert [r["s"] for r in sheet] == ["'=x", None]


def test_quoted_line_breaks_are_read_or_refused_but_never_torn(spark, tmp_path):
    (tmp_path / "f.csv").write_text('k,s\n1,"a\nb"\n2,c\n')
    whole = datasets.read_dataset(spark, str(tmp_path / "f.csv"), "k int, s string", multi_line=True)
    assert sorted(map(tuple, whole.collect())) == [(1, "a\nb"), (2, "c")]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        datasets.read_dataset(spark, str(tmp_path / "f.csv"), "k int, s string").collect()


def test_dataset_checks(spark):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    assert datasets.check_dataset(df, "k", ["s"]) is df
    with pytest.raises(ValueError):
        datasets.check_dataset(df, "t")
    with pytest.raises(ValueError):
        datasets.check_dataset(df.limit(0))


def test_anonymised_export(spark, tmp_path):
    df = spark.createDataFrame([("Alice", 1.0), ("Bob", 9.0)], "name string, x double")
    datasets.export_anonymised(df.coalesce(1), {"name": "mask", "x": "bin"}, str(tmp_path / "anon"))
    assert lines_of(tmp_path / "anon") == [["name", "x"], ["Al***", "0"], ["Bo***", "4"]]


def test_matrix_export_quotes_every_cell(spark, tmp_path):
    traces = spark.createDataFrame(
        [('say "hi"', "fairness", "d", "m", 1, 2, 3, "pass")],
        "requirement_name string, principle string, dataset_name string, model_name string, validation_id int, "
        "metrics_passed int, metrics_total int, status string")
    datasets.export_trace_matrix(traces.coalesce(1), str(tmp_path / "trace"))
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/trace/part-*"))
    assert text.splitlines()[1] == '"say ""hi""","fairness","d","m","2","3","pass",""'
    assert text.splitlines()[0].count('"') == 16


def test_artifacts_round_trip_with_default(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    rows = spark.createDataFrame([("r1", 1.5), ("r2", 2.5)], "run string, score double")
    artifacts.write_artifacts(artifacts.as_payload(rows, "run"), path, "model_card")
    artifacts.write_artifacts(artifacts.as_payload(rows, "run"), path, "privacy_report")
    stored = artifacts.read_artifacts(spark, path, "model_card")
    assert stored.count() == 2 and artifacts.read_artifacts(spark, path, "fairness_report").count() == 0
    with open(os.path.join(path, "kind=model_card", "extra.json"), "w") as f:
        f.write("not json\n")
    runs = spark.createDataFrame([("r1",), ("r9",)], "run_id string")
    got = {r["run_id"]: r["payload"] for r in artifacts.payload_or_default(runs, artifacts.read_artifacts(spark, path, "model_card")).collect()}
    assert got == {"r1": '{"score":1.5}', "r9": "{}"}
    parsed = artifacts.parsed(stored, "score double").select("run_id", "facts.score").collect()
    assert sorted((r[0], r[1]) for r in parsed) == [("r1", 1.5), ("r2", 2.5)]
    with pytest.raises(ValueError):
        artifacts.write_artifacts(stored, path, "other")
    artifacts.export_audit_trail(rows, rows, str(tmp_path / "trail"))
    assert spark.read.json(str(tmp_path / "trail" / "runs")).count() == 2


def test_governance_tables_grow(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([("v1", "fairness", "m", 0.5)], "validation_id string, principle string, metric_name string, metric_value double")
    governance.append_rows(first, root, "validation_results")
    governance.append_rows(first.withColumn("passed", F.lit(True)), root, "validation_results")
    stored = governance.read_table(spark, root, "validation_results")
    assert stored.count() == 2 and "details" in stored.columns
    governance.register_views(spark, root, ["validation_results"])
    assert spark.sql("SELECT count_if(passed) FROM validation_results").first()[0] == 1
    with pytest.raises(ValueError):
        governance.append_rows(first.withColumn("nope", F.lit(1)), root, "validation_results")
    assert all(governance.empty_table(spark, name).count() == 0 for name in governance.SCHEMAS)


def test_benchmarks(spark, tmp_path):
    folder = str(tmp_path)
    with open(os.path.join(folder, "adult.csv"), "w") as f:
        f.write("age,sex,income\n30,F,>50K\n40,M,<=50K\n")
    with open(os.path.join(folder, "german_credit_data.csv"), "w") as f:
        f.write("Risk,Duration\n")
    present = {r["dataset_key"]: r["present"] for r in benchmarks.catalogue_with_files(spark, folder).collect()}
    assert present["adult_income"] and not present["compas"] and len(present) == 5
    loaded, failures = benchmarks.load_all(spark, folder, "p1")
    assert set(loaded) == {"adult_income"} and set(failures) == {"compas", "german_credit", "bank_marketing", "diabetes_readmission"}
    df, record = loaded["adult_income"]
    row = record.first()
    assert json.loads(row["profile_data"]) == {
        "column_types": {"age": "int", "income": "string", "sex": "string"}, "missing_values": {"age": 0, "income": 0, "sex": 0},
        "unique_counts": {"age": 2, "income": 2, "sex": 2},
        "value_counts": {"age": {"30": 1, "40": 1}, "income": {"<=50K": 1, ">50K": 1}, "sex": {"F": 1, "M": 1}}}
    governance.append_rows(record, folder, "datasets")
    assert governance.read_table(spark, folder, "datasets").first()["profile_data"] == row["profile_data"]
    assert df.count() == 2 and row["row_count"] == 2 and row["sensitive_attributes"] == ["sex"] and row["target_column"] == "income"
    with pytest.raises(ValueError):
        benchmarks.load_benchmark(spark, folder, "nope", "p1")
    choices = spark.createDataFrame([("p1", "GEN-FAIRNESS"), ("p2", "ETH3")], "project_id string, template_id string")
    existing = spark.createDataFrame([("p1", "German Credit")], "project_id string, name string")
    files = datasets.files_in(spark, folder)
    plan = benchmarks.load_plan(choices, templates.built_in(spark), benchmarks.catalogue(spark), existing, files).collect()
    assert {(r["project_id"], r["dataset_key"]): r["outcome"] for r in plan} == {
        ("p1", "adult_income"): "loaded", ("p1", "german_credit"): "skipped_existing", ("p2", "compas"): "missing_files"}


def test_registration_profiles_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, "x" * 5000, 1.5), (None, 'a"b', None), (None, "x" * 5000, None)], "none string, `a b` string, `v.w` double")
    named = odd.toDF("none", "a b", "vw")
    row = datasets.dataset_record(named, "odd", "p", "odd.parquet", value_counts=True).first()
    facts = json.loads(row["profile_data"])
    assert row["row_count"] == 3 and facts["missing_values"] == {"none": 3, "a b": 0, "vw": 2}
    assert facts["unique_counts"] == {"none": 0, "a b": 2, "vw": 1}
    assert facts["value_counts"] == {"a b": {'a"b': 1, "x" * 5000: 2}, "vw": {"1.5": 1}}
    none = datasets.dataset_record(named.limit(0), "odd", "p", "odd.parquet", value_counts=True).first()
    assert none["row_count"] == 0 and json.loads(none["profile_data"])["unique_counts"] == {}
    assert datasets.dataset_record(named, "odd", "p", "odd.parquet", profiled=False).first()["profile_data"] is None


def test_details_by_suite_take_any_artifact(spark, tmp_path):
    suites = spark.createDataFrame([(1, "t1", "p1"), (2, "t2", None), (3, None, "p3")], "suite_id int, transparency_validation_id string, privacy_validation_id string")
    validations = spark.createDataFrame([(v, "completed", f"run-{v}") for v in ("t1", "t2", "p1", "p3")], "validation_id string, status string, run_id string")
    path = str(tmp_path / "artifacts")
    stored = lambda *rows: spark.createDataFrame(list(rows), "run_id string, payload string")
    artifacts.write_artifacts(stored(("run-p1", '{"pii_detected": ["a"], "own field": {"deep": [1]}}'), ("run-p3", "{torn")), path, "privacy_report")
    artifacts.write_artifacts(stored(("run-t1", '{"b": -2, "a": 2.0, "c": 0.5, "d": "no number", "e": null}')), path, "feature_importance")
    artifacts.write_artifacts(stored(("run-t1", '[1, 2]')), path, "sample_predictions")
    found = artifacts.variant_payloads(spark, path)
    privacy = {r["suite_id"]: r for r in artifacts.privacy_details(suites, validations, found).collect()}
    assert json.loads(privacy[1]["payload"]) == {"pii_detected": ["a"], "own field": {"deep": [1]}}
    assert privacy[1]["overall_passed"] is None and privacy[3]["payload"] == "{}" and set(privacy) == {1, 3}
    shown = {r["suite_id"]: r for r in artifacts.transparency_details(suites, validations, found).collect()}
    assert [tuple(e) for e in shown[1]["importance"]] == [("a", 2.0), ("b", -2.0), ("c", 0.5)]
    assert shown[1]["sample_predictions"] == "[1,2]" and shown[1]["missing"] is None and shown[1]["model_card"] == "{}"
    assert shown[2]["importance"] is None and shown[2]["missing"] == "model_card.json, feature_importance.json"
    assert set(shown) == {1, 2}
