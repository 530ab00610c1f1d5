"""Suite reports, executive summaries, advice, certificates and compliance.

A section is one row per suite and principle; every text is built from the
sections of a suite, so reports for all suites are one plan.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.messages import first_of, fixed, say
from probity.operators.history import newest_suites
from probity.operators.trace import latest_results, only, suite_validations

ARTIFACT_FIELDS = """
    overall_passed boolean, pii_detected array<string>,
    k_anonymity struct<k_value: double, satisfies_k: boolean>,
    l_diversity struct<l_value: double, satisfies_l: boolean>,
    hipaa struct<overall_passed: boolean>, warning string, features bigint
"""
SECTIONS = ("fairness", "transparency", "privacy")
FALLBACK = "Maintain periodic monitoring and rerun validation after any model/data updates."
PASS_RATE = 0.8
NAMED_METRICS = 3


def sections(suites, validations, results, artifacts, named=NAMED_METRICS) -> DataFrame:
    """One row per suite with a struct per section; the first ``named`` failed metrics are listed (all with None).

    ``artifacts`` has one row per run: (run_id, facts) with ``facts`` parsed as
    ``ARTIFACT_FIELDS``; a run without artifacts has empty facts.
    """
    parts = suite_validations(suites).select("suite_id", F.col("principle").alias("section"), "validation_id")
    latest = latest_results(results.select("validation_id", "metric_name", "result_no", "metric_value", "threshold", "passed"))
    # One latest result per metric, so the lists below have as many entries as a
    # validation has metrics. Plain numbers keep the rest a hash aggregate.
    failed = F.when(~F.col("passed"), F.struct("result_no", "metric_name"))
    shown = ("demographic_parity_ratio", "equalized_odds_ratio")
    of = lambda m, c: F.max(F.when(F.col("metric_name") == m, F.col(c)))
    outcome = latest.groupBy("validation_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("passed")).alias("failed"),
        F.array_sort(F.collect_list(failed)).alias("failures"),
        *[of(m, c).alias(f"{m}_{c}") for m in shown for c in ("metric_value", "threshold", "passed")],
    ).select(
        "validation_id", "total", "failed",
        F.transform(first_of("failures", named), lambda x: x["metric_name"]).alias("failed_names"),
        *[F.when(F.col(f"{m}_passed").isNotNull(), F.struct(*[
            F.col(f"{m}_{c}").alias(c) for c in ("metric_value", "threshold", "passed")])).alias(m) for m in shown],
    )
    joined = (
        parts.join(validations.select("validation_id", "status"), "validation_id", "left")
        .join(outcome, "validation_id", "left")
        .join(artifacts.select(F.col("run_id").alias("validation_id"), "facts"), "validation_id", "left")
    )
    body = F.struct(
        F.coalesce("status", F.lit("not_run")).alias("status"),
        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("failed", F.lit(0)).alias("failed"),
        F.coalesce("failed_names", F.array().cast("array<string>")).alias("failed_names"),
        "demographic_parity_ratio", "equalized_odds_ratio", "facts",
    )
    pick = lambda s: F.max_by(F.when(F.col("section") == s, body), F.when(F.col("section") == s, F.lit(1)))
    wide = joined.groupBy("suite_id").agg(*[pick(s).alias(s) for s in SECTIONS])
    return suites.select("suite_id", "model_id", "dataset_id", "overall_passed", "started_at").join(wide, "suite_id", "left")


def _status(section):
    return F.coalesce(F.col(section)["status"], F.lit("not_run"))


def _done(section):
    return _status(section) == "completed"


def _fair():
    total = F.coalesce(F.col("fairness")["total"], F.lit(0))
    return (total > 0) & (F.coalesce(F.col("fairness")["failed"], F.lit(0)) == 0)


def _private():
    return F.coalesce(F.col("privacy")["facts"]["overall_passed"], F.lit(False))


def executive_summary(wide) -> DataFrame:
    """Completed and passed sections of each suite and the sentence about them."""
    done = [F.when(_done(s), 1).otherwise(0) for s in SECTIONS]
    passed = [
        F.when(_done("fairness") & _fair(), 1).otherwise(0),
        F.when(_done("transparency"), 1).otherwise(0),
        F.when(_done("privacy") & _private(), 1).otherwise(0),
    ]
    failed = F.array_compact(F.array(
        F.when(_done("fairness") & ~_fair(), F.lit("fairness")), F.when(_done("privacy") & ~_private(), F.lit("privacy"))))
    rows = wide.select(
        "suite_id", sum(done[1:], done[0]).alias("sections"), sum(passed[1:], passed[0]).alias("sections_passed"),
        failed.alias("_failed"))
    base = F.format_string("Model passed %d out of %d completed ethical validation sections.", "sections_passed", "sections")
    text = F.when(F.col("sections") == 0, "No completed validation sections were found for this suite yet.").when(
        F.size("_failed") > 0, say(base, " Areas requiring attention: ", F.array_join("_failed", ", "), ".")
    ).otherwise(say(base, " No major ethical validation failures were detected in completed sections."))
    return rows.withColumn("executive_summary", text).drop("_failed")


def recommendations(wide, named=NAMED_METRICS) -> DataFrame:
    """Advice lines per suite in order, the same line once, with a fall-back line; the first ``named`` columns are listed."""
    fair, transparent, private = F.col("fairness"), F.col("transparency"), F.col("privacy")
    facts = private["facts"]
    pii = F.coalesce(facts["pii_detected"], F.array().cast("array<string>"))
    k, l = facts["k_anonymity"], facts["l_diversity"]  # noqa: E741
    lines = F.array(
        F.when(F.coalesce(fair["failed"], F.lit(0)) > 0, say(
            "Address failed fairness metrics (", F.array_join(fair["failed_names"], ", "),
            "): rebalance data and tune decision thresholds."))
        .when(~_status("fairness").isin("completed", "not_run"),
              "Investigate fairness validation execution status before approving deployment.")
        .when(_status("fairness") == "not_run", "Run fairness validation on sensitive groups before production release."),
        F.when(_done("transparency") & (F.coalesce(transparent["facts"]["features"], F.lit(0)) == 0),
               "Enable/verify explainability artifact generation (SHAP/LIME) for transparency evidence.")
        .when(_status("transparency") == "not_run",
              "Run transparency validation and publish model-card evidence for governance reviews."),
        say("Transparency warning: ", transparent["facts"]["warning"]),
        F.when(F.size(pii) > 0, say(
            "Remove, mask, or tokenize detected PII columns (", F.array_join(first_of(pii, named), ", "),
            ") before model training/inference.")),
        F.when(k.isNotNull() & ~F.coalesce(k["satisfies_k"], F.lit(False)), say(
            "Improve quasi-identifier generalization/suppression to satisfy k-anonymity (target k=", fixed(k["k_value"], 0), ").")),
        F.when(l.isNotNull() & ~F.coalesce(l["satisfies_l"], F.lit(False)), say(
            "Increase sensitive-attribute diversity to satisfy l-diversity (target l=", fixed(l["l_value"], 0), ").")),
        F.when(_status("privacy") == "not_run",
               "Run privacy validation (PII, anonymity checks) before sharing datasets externally."),
    )
    kept = unrepeated(F.filter(lines, lambda x: x.isNotNull() & (F.trim(x) != "")))
    final = F.when(F.size(kept) == 0, F.array(F.lit(FALLBACK))).otherwise(kept)
    return wide.select("suite_id", F.posexplode(final).alias("position", "recommendation"))


def unrepeated(lines):
    """An array of texts without repeats (ignoring case and outer blanks), the first one kept; for short lists."""
    same = lambda x: F.lower(F.trim(x))
    return F.filter(lines, lambda x, i: F.array_position(F.transform(lines, same), same(x)) == i + 1)


def first_of_each(lines, keys, text, position) -> DataFrame:
    """Lines without repeats (ignoring case and outer blanks), the first one kept."""
    marked = lines.withColumn("_same", F.lower(F.trim(text)))
    return marked.groupBy(*keys, "_same").agg(
        F.min(position).alias(position), F.min_by(text, position).alias(text)).drop("_same")


def principle_status(wide) -> DataFrame:
    """PASS, FAIL or NOT RUN per section of the certificate."""
    not_run = lambda s: _status(s) == "not_run"
    return wide.select(
        "suite_id",
        F.when(not_run("fairness"), "NOT RUN").when(_fair(), "PASS").otherwise("FAIL").alias("fairness"),
        F.when(not_run("transparency"), "NOT RUN").when(_done("transparency"), "PASS").otherwise("FAIL").alias("transparency"),
        F.when(not_run("privacy"), "NOT RUN").when(_private(), "PASS").otherwise("FAIL").alias("privacy"),
        F.lit("RECORDED").alias("accountability"),
    )


def certificate_checks(wide) -> DataFrame:
    """The check lines of each suite's certificate in order."""
    def measured(title, metric):
        row = F.col("fairness")[metric]
        outcome = F.when(row["passed"], "PASS").otherwise("FAIL")
        return F.when(row.isNotNull(), say(
            f"{title} >= ", fixed(row["threshold"]), ": ", fixed(row["metric_value"]), " (", outcome, ")"))

    facts = F.col("privacy")["facts"]
    k = facts["k_anonymity"]
    pass_fail = lambda c: F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise("FAIL")
    lines = F.array_compact(F.array(
        F.when(_done("fairness"), F.coalesce(
            measured("Demographic Parity Ratio", "demographic_parity_ratio"),
            F.lit("Demographic Parity Ratio: not evaluated in this run"))).otherwise("Fairness checks: not run"),
        F.when(_done("fairness"), measured("Equalized Odds Ratio", "equalized_odds_ratio")),
        F.when(_done("transparency"), "Transparency evidence (SHAP/LIME/model card): available").otherwise(
            "Transparency evidence: not available (validation not completed)"),
        F.when(_done("privacy"), F.format_string(
            "PII detection: %d flagged column(s)", F.coalesce(F.size(facts["pii_detected"]), F.lit(0)))).otherwise(
            "Privacy checks: not run"),
        F.when(_done("privacy") & k.isNotNull(), say("k-Anonymity (k=", fixed(k["k_value"], 0), "): ", pass_fail(k["satisfies_k"]))),
        F.when(_done("privacy") & facts["hipaa"].isNotNull(), say(
            "HIPAA Safe Harbor: ", pass_fail(facts["hipaa"]["overall_passed"]))),
    ))
    return wide.select("suite_id", F.posexplode(lines).alias("position", "check"))


def suite_report(wide, models, datasets, projects) -> DataFrame:
    """Names, status and summary of every suite."""
    summary = executive_summary(wide)
    return (
        wide.select("suite_id", "model_id", "dataset_id", "overall_passed", "started_at")
        .join(models.select("model_id", "project_id", F.col("name").alias("model_name")), "model_id", "left")
        .join(datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id", "left")
        .join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left")
        .join(summary, "suite_id")
        .select(
            "suite_id", "project_id",
            F.when(F.col("project_id").isNotNull(), F.coalesce("project_name", F.lit("Unknown Project"))).alias("project_name"),
            F.coalesce("model_name", F.lit("Unknown")).alias("model_name"),
            F.coalesce("dataset_name", F.lit("Unknown")).alias("dataset_name"),
            F.when(F.col("overall_passed"), "pass").otherwise("fail").alias("overall_status"),
            "started_at", "sections", "sections_passed", "executive_summary",
        )
    )


def project_compliance(suites, models, project_id=None, date_from=None, date_to=None) -> DataFrame:
    """Suites, passed suites, rate and verdict of each project, within a date range if given."""
    chosen = suites
    if date_from is not None:
        chosen = chosen.where(F.col("started_at") >= F.lit(date_from))
    if date_to is not None:
        chosen = chosen.where(F.col("started_at") <= F.lit(date_to))
    joined = newest_suites(chosen, models, None, project_id)
    rate = F.coalesce(F.try_divide(F.col("passed_suites").cast("double"), F.col("total_suites").cast("double")), F.lit(0.0))
    return joined.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_suites"), F.count_if("overall_passed").alias("passed_suites"),
    ).withColumn("compliance_rate", rate).withColumn(
        "verdict", F.when(F.col("compliance_rate") >= PASS_RATE, "pass").otherwise("fail"))


def compliance_history(suites, models, project_id=None) -> DataFrame:
    """Suites of a project; order by started_at descending to read them."""
    return newest_suites(suites, models, None, project_id).select(
        "project_id", "suite_id", "status", F.coalesce("overall_passed", F.lit(False)).alias("overall_passed"), "started_at")


def custom_report(project_id, suites, models, traces, include=("summary", "history", "traceability"), date_from=None, date_to=None):
    """The chosen sections of a project's compliance report as DataFrames."""
    out = {}
    if "summary" in include:
        out["summary"] = project_compliance(suites, models, project_id, date_from, date_to)
    if "history" in include:
        history = compliance_history(suites, models, project_id)
        if date_from is not None:
            history = history.where(F.col("started_at") >= F.lit(date_from))
        if date_to is not None:
            history = history.where(F.col("started_at") <= F.lit(date_to))
        out["history"] = history
    if "traceability" in include:
        out["traceability"] = only(traces, "project_id", project_id)
    return out
