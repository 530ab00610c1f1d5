import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probity.operators import anonymity, anonymize, hipaa, noise, pii, privacy_report


def report_of(df, **kwargs):
    return {r["column_name"]: r for r in pii.pii_report(df, "k", **kwargs).collect()}


def column(spark, values, name="v"):
    return spark.createDataFrame(list(enumerate(values)), f"k int, {name} string")


def test_match_rate_must_exceed_a_tenth(spark):
    some = ["a@b.org"] + ["same"] * 9
    assert not report_of(column(spark, some))["v"]["is_pii"]
    row = report_of(column(spark, some[:9]))["v"]
    assert row["is_pii"] and row["pii_type"] == "email" and row["details"] == "1/9 values match email pattern"


def test_unique_ratio_must_exceed_nine_tenths(spark):
    assert not report_of(column(spark, list("abcdefghi") + ["a"]))["v"]["is_pii"]
    row = report_of(column(spark, list("abcdefghij")))["v"]
    assert row["pii_type"] == "potential_identifier" and row["confidence"] == 0.6
    assert row["details"] == "High cardinality: 100.0% unique values"


def test_zip_inside_text_is_rejected(spark):
    assert not report_of(column(spark, ["near 94105"] * 20))["v"]["is_pii"]
    assert report_of(column(spark, ["94105"] * 20))["v"]["pii_type"] == "zip_code"
    assert not report_of(column(spark, ["00100"] * 20))["v"]["is_pii"]


def test_names_beat_values_and_dates_are_no_identifiers(spark):
    df = spark.createDataFrame(
        [(i, f"x{i}", f"2020-01-{i:02d}", f"{i:02d}/{i:02d}/2021", None) for i in range(1, 13)],
        "k int, home_address string, day string, us_day string, empty string")
    rows = report_of(df)
    assert rows["home_address"]["detection_method"] == "column_name" and rows["home_address"]["pii_type"] == "address"
    assert rows["day"]["details"] == "Column contains datetime values"
    assert rows["us_day"]["pii_type"] == "date_of_birth"
    assert rows["empty"]["details"] == "Column is empty or contains only null values"
    assert not rows["k"]["is_pii"]


def test_custom_patterns_are_checked(spark):
    df = column(spark, ["AB-1", "AB-2", "AB-2"])
    assert report_of(df, custom_patterns={"code": r"^AB-\d$"})["v"]["pii_type"] == "code"
    with pytest.raises(ValueError):
        report_of(df, custom_patterns={"bad": "("})
    with pytest.raises(ValueError):
        report_of(df, sample_size=0)
    assert report_of(column(spark, ["x"], "Staff_No"), custom_tokens=["staff no"])["Staff_No"]["is_pii"]


def test_sample_reads_the_first_values_only(spark):
    df = column(spark, ["plain"] * 10 + ["a@b.org"] * 10)
    assert report_of(df)["v"]["pii_type"] == "email"
    assert not report_of(df, sample_size=10)["v"]["is_pii"]
    samples = pii.pii_samples(df, pii.pii_report(df, "k"), "k").orderBy("rank").collect()
    assert [r["sample"] for r in samples] == ["a@b.org"] * 3


def test_k_anonymity_edges(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "q string, s int")
    row = anonymity.k_anonymity(df, ["q"], 10).first()
    assert not row["satisfies_k"] and row["actual_min_k"] == 2 and row["rows_with_missing_values"] == 1
    nothing = anonymity.k_anonymity(df.where("q IS NULL"), ["q"], 2).first()
    assert not nothing["satisfies_k"] and nothing["error"] == anonymity.NO_ROWS
    with pytest.raises(ValueError):
        anonymity.k_anonymity(df, [], 2)
    with pytest.raises(ValueError):
        anonymity.k_anonymity(df, ["q"], 0)
    with pytest.raises(ValueError):
        anonymity.k_anonymity(df, ["nope"], 2)


def test_configs_equal_single_checks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.choice(["x", "y", None], 400), "b": rng.integers(0, 5, 400), "c": rng.integers(0, 3, 400)})
    df = spark.createDataFrame(pdf)
    configs = [(["a"], 3), (["b", "a"], 20), (["a", "b", "c"], 5), (["c"], 500)]
    rows = {r["position"]: r for r in anonymity.k_anonymity_configs(df, configs).collect()}
    for i, (qis, k) in enumerate(configs):
        single = anonymity.k_anonymity(df, qis, k).first()
        for field in ("satisfies_k", "actual_min_k", "total_groups", "violating_groups", "rows_with_missing_values"):
            assert rows[i][field] == single[field], (qis, field)


def test_distribution_adds_up_to_kept_rows(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 5 + ["b"] * 2 + ["c"] * 2 + [None]], "q string")
    rows = anonymity.size_distribution(df, ["q"]).collect()
    assert {r["size"]: r["groups"] for r in rows} == {5: 1, 2: 2}
    assert sum(r["size"] * r["groups"] for r in rows) == 9


def test_l_diversity(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", None)], "q string, s string")
    row = anonymity.l_diversity(df, ["q"], "s", 2).first()
    assert not row["satisfies_l"] and row["actual_min_l"] == 1 and row["violating_groups"] == 1
    assert [r["q"] for r in anonymity.undiverse_groups(df, ["q"], "s", 2).collect()] == ["b"]


def test_bins_match_cut(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.gamma(2, 3, 500).round(3), "same": 4.0})
    df = spark.createDataFrame(pdf.assign(k=range(500)))
    rows = anonymize.bin_codes(df, ["x", "same"]).orderBy("k").collect()
    assert [r["x"] for r in rows] == pd.cut(pdf["x"], bins=5, labels=False).tolist()
    assert {r["same"] for r in rows} == set(pd.cut(pdf["same"], bins=5, labels=False))
    missing = spark.createDataFrame([(None,), (1.0,), (2.0,)], "x double")
    assert [r["x"] for r in anonymize.bin_codes(missing, ["x"]).collect()] == [None, 0, 4]


def test_anonymise_keeps_missing_texts_and_skips_unknown_columns(spark):
    df = spark.createDataFrame([("94102", "Alice", 1), (None, "Bo", 2)], "zip string, name string, n int")
    out = anonymize.anonymise(df, {"zip": "generalize", "name": "mask", "n": "suppress", "nope": "bin"})
    assert out.columns == ["zip", "name"]
    assert [tuple(r) for r in out.collect()] == [("941**", "Al***"), (None, "Bo***")]


def test_noise_has_the_right_spread_and_repeats(spark):
    df = spark.range(20000).select("id", (F.col("id") % 101).cast("double").alias("x"))
    noised = noise.laplace_noise(df, ["x"], ["id"], target_epsilon=1.0, seed=7)
    again = noise.laplace_noise(df.repartition(3), ["x"], ["id"], target_epsilon=1.0, seed=7)
    assert noised.exceptAll(again).count() == 0
    gap = noised.withColumnRenamed("x", "y").join(df, "id").select((F.col("y") - F.col("x")).alias("d"))
    row = gap.agg(F.stddev("d").alias("s"), F.avg("d").alias("m")).first()
    assert row["s"] == pytest.approx(100 * 2 ** 0.5, rel=0.05)
    assert abs(row["m"]) < 4


def test_epsilon_edges(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 5.0, "b")], "k int, same double, t string")
    rows = {r["column"]: r for r in noise.column_epsilons(df, ["same", "t", "k"]).collect()}
    assert rows["same"]["epsilon"] == 0.0
    assert rows["t"]["epsilon"] == 1.0
    assert rows["k"]["epsilon"] == pytest.approx(2 ** 0.5)
    nothing = noise.privacy_budget(df, [], 2.0).first()
    assert nothing["measured_epsilon"] == 0.0 and nothing["budget_satisfied"]
    empty = spark.createDataFrame([(None,)], "x double")
    assert noise.column_epsilons(empty, ["x"]).first()["sensitivity"] == 1.0


def test_hipaa(spark):
    df = spark.createDataFrame(
        [(1, "call 555-123-4567", "n"), (2, "on 2020-01-02", "n"), (3, "nothing", "n")], "k int, note string, fax string")
    rows = {r["identifier"]: r for r in hipaa.hipaa_report(df).collect()}
    assert len(rows) == 18
    assert rows["fax"]["flagged_columns"] == "fax" and rows["phone"]["flagged_columns"] == "note"
    assert not rows["dates"]["passed"] and rows["email"]["passed"]
    assert hipaa.flagged_by_name(["first_name", "First Name", "patient-id"]) == [("names", "first_name"), ("names", "First Name"), ("medical_record", "patient-id")]
    samples = [(r["identifier"], r["sample"]) for r in hipaa.hipaa_samples(df, "k").collect()]
    assert ("dates", "note: on 2020-01-02") in samples
    sampled = {r["identifier"]: r["passed"] for r in hipaa.hipaa_report(df, "k", sample_size=1).collect()}
    assert sampled["dates"] and not sampled["phone"]


def test_checks_that_cannot_run_fail_with_a_reason(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k int, q string")
    checks = {r["check"]: r for r in privacy_report.privacy_checks(df, "k", {
        "k_anonymity": {"quasi_identifiers": ["q"]}, "l_diversity": {"l": 2, "quasi_identifiers": ["x"], "sensitive_attribute": "q"},
        "k_anonymity_configs": [], "custom_pii_patterns": {"p": "["}}).collect()}
    assert not checks["k_anonymity"]["passed"] and "k" in checks["k_anonymity"]["detail"]
    assert "not found" in checks["l_diversity"]["detail"] and not checks["k_anonymity_configs"]["passed"]
    assert checks["pii_detection"]["passed"] and "Invalid" in checks["pii_detection"]["detail"]


def test_small_groups_weigh_more(spark):
    def score(minimum):
        df = spark.createDataFrame(
            [(i, "a") for i in range(minimum)] + [(i, "b") for i in range(minimum)], "k int, q string")
        checks = privacy_report.privacy_checks(df, "k", {
            "pii_detection": False, "k_anonymity": {"k": 5, "quasi_identifiers": ["q"]},
            "differential_privacy": {"quasi_identifiers": ["q"], "target_epsilon": 5.0}})
        return privacy_report.risk_score(checks).first()

    assert score(2)["risk_score"] == 75.0 and score(2)["risk_level"] == "High"
    assert score(4)["risk_score"] == 50.0 and score(4)["risk_level"] == "Medium"
    assert score(5)["risk_score"] == 0.0 and score(5)["risk_level"] == "Low"


def test_no_checks_are_no_risk(spark):
    df = spark.createDataFrame([(1, "a")], "k int, q string")
    checks = privacy_report.privacy_checks(df, "k", {"pii_detection": False})
    assert privacy_report.risk_score(checks).first()["risk_score"] == 0.0
    assert privacy_report.privacy_verdict(checks).first()["overall_passed"]


def test_presets(spark):
    assert privacy_report.preset_requirements("healthcare", ["q"], "s")["l_diversity"]["l"] == 3
    with pytest.raises(ValueError):
        privacy_report.preset_requirements("nope", ["q"])


def test_first_values_come_from_a_bounded_heap_in_one_scan(spark):
    df = spark.range(0, 1000, 1, 4).select(
        F.col("id").alias("value"), F.when(F.col("id") >= 3, F.concat(F.lit("2020-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).alias("seen"),
        F.when(F.col("id") != 5, "2021-05-05").otherwise("x").alias("odd"), F.lit(None).cast("string").alias("none"))
    rows = pii.first_values(df, ["seen", "odd", "none"], "value", 4).orderBy("position", "value").collect()
    assert [r["value"] for r in rows if r["column"] == "seen"] == ["2020-01-04", "2020-01-05", "2020-01-06", "2020-01-07"]
    assert [r["column"] for r in rows] == ["seen"] * 4 + ["odd"] * 4
    facts = {r["column"]: r for r in pii.column_facts(df, ["seen", "odd", "none"], "value", {"year": "^20"}).collect()}
    assert {c: f["is_date"] for c, f in facts.items()} == {"seen": True, "odd": False, "none": False}
    assert {c: (f["rows"], f["present"]) for c, f in facts.items()} == {"seen": (1000, 997), "odd": (1000, 1000), "none": (1000, 0)}
    report = pii.pii_report(df, "value", custom_patterns={"year": "^1999"}, approximate=True)
    text = report._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "TakeOrdered" not in text and text.count("Range (") == 1
    exact = pii.pii_report(df, "value")._jdf.queryExecution().executedPlan().toString()
    assert exact.count("Range (") == 2


def test_metric_rows_run_the_checks_once(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 5.0)], "k int, g string, x double")
    checks = privacy_report.privacy_checks(df, "k", {"pii_detection": False, "k_anonymity": {"k": 2, "quasi_identifiers": ["g"]}})
    rows = privacy_report.metric_rows(checks)
    scans = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert scans(rows) == scans(checks) == 1
    assert {r["metric"]: r["value"] for r in rows.collect()} == {
        "k_anonymity_satisfied": 0.0, "overall_passed": 0.0, "privacy_risk_score": 100.0}
    none = privacy_report.metric_rows(checks.limit(0)).collect()
    assert {r["metric"]: r["value"] for r in none} == {"overall_passed": 1.0, "privacy_risk_score": 0.0}
