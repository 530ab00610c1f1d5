"""Registered traceability, history, report, remediation, audit and catalogue queries."""

import uuid

from pyspark.sql import functions as F

from probity.functions import text as texts
from probity.operators import accountability as acc
from probity.operators import catalogue, history, remediation, reports, trace
from probity.plans.registry import register
from probity.session import ensure_checkpoint_dir
from probity.sources.artifacts import (
    as_payload, export_audit_trail, parsed, payload_or_default, privacy_details, transparency_details, variant_payloads, write_artifacts)
from probity.sources.datasets import export_trace_matrix, read_dataset
from probity.sources.tables import view, with_views

AS_OF = "2024-01-20 10:00:00"


def views(spark, directory, *names):
    return [view(spark, directory, n) for n in names]


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- Traceability ---------------------------------------------------------------

TRACE_SQL = """, totals AS (
        SELECT validation_id, COUNT(*) AS total, SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS ok, BOOL_AND(passed) AS all_ok,
               CASE WHEN MIN(principle) = MAX(principle) THEN MIN(principle) ELSE 'multiple' END AS principle
        FROM g_results GROUP BY validation_id),
    slots AS (
        SELECT suite_id, model_id, fairness_validation_id AS validation_id, 'fairness' AS slot, started_at FROM g_suites
        UNION ALL SELECT suite_id, model_id, transparency_validation_id, 'transparency', started_at FROM g_suites
        UNION ALL SELECT suite_id, model_id, privacy_validation_id, 'privacy', started_at FROM g_suites),
    checked AS (
        SELECT v.*, m.project_id, m.name AS model_name, d.name AS dataset_name, t.total, t.ok, t.all_ok,
               t.principle AS results_principle, s.suite_id
        FROM g_validations v JOIN g_models m ON v.model_id = m.model_id
        LEFT JOIN g_datasets d ON v.dataset_id = d.dataset_id LEFT JOIN totals t ON v.validation_id = t.validation_id
        LEFT JOIN slots s ON v.validation_id = s.validation_id),
    traces AS (
        SELECT c.project_id, r.requirement_id, r.name AS requirement_name, COALESCE(r.principle, c.results_principle) AS principle,
               c.dataset_name, c.model_name, c.validation_id, c.suite_id, COALESCE(ok, 0)::BIGINT AS metrics_passed,
               COALESCE(total, 0)::BIGINT AS metrics_total,
               CASE WHEN all_ok THEN 'pass' WHEN NOT all_ok THEN 'fail' ELSE 'unknown' END AS status
        FROM checked c LEFT JOIN g_requirements r ON c.requirement_id = r.requirement_id AND c.project_id = r.project_id
        UNION ALL
        SELECT r.project_id, r.requirement_id, r.name, r.principle, NULL, NULL, NULL, NULL, 0, 0, 'not_validated'
        FROM g_requirements r WHERE NOT EXISTS (
            SELECT 1 FROM checked c WHERE c.requirement_id = r.requirement_id AND c.project_id = r.project_id))"""
TRACE_VIEWS = ("g_requirements", "g_models", "g_datasets", "g_validations", "g_results", "g_suites")


def trace_sql(body):
    return with_views("", *TRACE_VIEWS) + TRACE_SQL + body


def traces_of(spark, directory):
    return trace.traceability_matrix(*views(spark, directory, *TRACE_VIEWS))


@register("trace_matrix", trace_sql(" SELECT * FROM traces"))
def trace_matrix(spark, directory):
    return traces_of(spark, directory)


@register("trace_summary", trace_sql("""
    SELECT t.project_id, MAX(n) AS total_requirements, COUNT(validation_id) AS total_validations,
           SUM(CASE WHEN status = 'pass' THEN 1 ELSE 0 END)::BIGINT AS pass_count,
           SUM(CASE WHEN status = 'fail' THEN 1 ELSE 0 END)::BIGINT AS fail_count,
           SUM(CASE WHEN status = 'not_validated' THEN 1 ELSE 0 END)::BIGINT AS not_validated_count,
           ROUND(SUM(CASE WHEN status = 'pass' THEN 1 ELSE 0 END)::DOUBLE
               / GREATEST(SUM(CASE WHEN status IN ('pass', 'fail') THEN 1 ELSE 0 END), 1) * 100, 1)::DOUBLE AS pass_rate
    FROM traces t JOIN (SELECT project_id, COUNT(*) AS n FROM g_requirements GROUP BY project_id) r ON t.project_id = r.project_id
    GROUP BY t.project_id"""))
def trace_summary(spark, directory):
    return trace.traceability_summary(traces_of(spark, directory), view(spark, directory, "g_requirements"))


@register("trace_filter", trace_sql("""
    SELECT * FROM traces WHERE status = 'fail' AND principle = 'privacy' AND CONTAINS(LOWER(CONCAT_WS(' ', requirement_name,
        CASE WHEN requirement_id IS NOT NULL THEN principle END, dataset_name, model_name)), 'widget')"""))
def trace_filter(spark, directory):
    return trace.filter_traces(traces_of(spark, directory), principle="privacy", status="fail", search="Widget")


@register("trace_requirement_history", trace_sql("""
    SELECT v.requirement_id, v.validation_id, v.status, all_ok AS overall_passed, COALESCE(m.name, 'Unknown') AS model_name,
           COALESCE(d.name, 'Unknown') AS dataset_name, STRFTIME(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
           COALESCE(total, 0)::BIGINT AS metrics_total
    FROM g_validations v LEFT JOIN totals t ON v.validation_id = t.validation_id LEFT JOIN g_models m ON v.model_id = m.model_id
    LEFT JOIN g_datasets d ON v.dataset_id = d.dataset_id WHERE v.requirement_id IS NOT NULL"""))
def trace_requirement_history(spark, directory):
    validations, results, models, datasets = views(
        spark, directory, "g_validations", "g_results", "g_models", "g_datasets")
    out = trace.requirement_history(validations, results, models, datasets)
    return out.withColumn("created_at", stamp("created_at"))


@register("trace_history_results", with_views("""
    SELECT v.requirement_id, v.validation_id, principle, metric_name, metric_value, threshold, passed, COUNT(*) AS "rows"
    FROM g_validations v JOIN g_results r ON v.validation_id = r.validation_id WHERE requirement_id IS NOT NULL GROUP BY ALL""",
    "g_validations", "g_results"))
def trace_history_results(spark, directory):
    validations, results, models, datasets = views(
        spark, directory, "g_validations", "g_results", "g_models", "g_datasets")
    joined = trace.requirement_history_results(
        trace.requirement_history(validations, results, models, datasets), results)
    keys = ["requirement_id", "validation_id", "principle", "metric_name", "metric_value", "threshold", "passed"]
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


@register("trace_decided_history", trace_sql("""
    SELECT v.validation_id, all_ok AS overall_passed FROM g_validations v JOIN totals t ON v.validation_id = t.validation_id
    WHERE requirement_id IS NOT NULL AND all_ok IS NOT NULL"""))
def trace_decided_history(spark, directory):
    validations, results, models, datasets = views(
        spark, directory, "g_validations", "g_results", "g_models", "g_datasets")
    found = trace.requirement_history(validations, results, models, datasets)
    return trace.decided_history(found).select("validation_id", "overall_passed")


@register("trace_dataset_uses", with_views("""
    SELECT dataset_id, requirement_id, COUNT(*) AS validation_count,
           ARG_MAX(validation_id, (created_at, validation_id)) AS latest_validation_id,
           ARG_MAX(status, (created_at, validation_id)) AS latest_status
    FROM g_validations WHERE requirement_id IS NOT NULL GROUP BY ALL""", "g_validations"))
def trace_dataset_uses(spark, directory):
    return trace.dataset_requirement_uses(view(spark, directory, "g_validations"))


@register("trace_dataset_usage", with_views("""
    SELECT dataset_id, COUNT(*) AS total_validations,
           SUM(CASE WHEN requirement_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlinked_validations
    FROM g_validations GROUP BY dataset_id""", "g_validations"))
def trace_dataset_usage(spark, directory):
    return trace.dataset_usage(view(spark, directory, "g_validations"))


CAUSE_SQL = """
    CASE principle WHEN 'fairness' THEN
        CASE WHEN metric_name LIKE '%parity%' OR metric_name LIKE '%impact%' THEN
                'The model''s selection/approval rate differs across groups defined by ''' || who || '''. Metric ' || metric_name
                || ' = ' || val || ' vs threshold 0.200. This indicates unequal treatment of demographic groups.'
             WHEN metric_name LIKE '%opportunity%' THEN
                'True positive rates differ across groups defined by ''' || who || '''. Metric ' || metric_name || ' = ' || val
                || ' vs threshold 0.200. The model is better at correctly identifying positive outcomes for some groups.'
             WHEN metric_name LIKE '%odds%' THEN
                'Error rates (both false positives and false negatives) differ across groups defined by ''' || who
                || '''. Metric ' || metric_name || ' = ' || val || ' vs threshold 0.200.'
             ELSE 'Fairness metric ''' || metric_name || ''' failed: value ' || num || ' vs threshold 0.2.' END
        WHEN 'privacy' THEN
        CASE WHEN metric_name LIKE '%pii%' THEN 'Personally Identifiable Information (PII) was detected in the dataset.'
             WHEN metric_name LIKE '%anonymity%' THEN 'k-Anonymity check failed: some groups have fewer than 0.2 identical records, making individuals potentially identifiable.'
             WHEN metric_name LIKE '%diversity%' THEN 'l-Diversity check failed: some equivalence classes have fewer than 0.2 distinct sensitive values, risking attribute disclosure.'
             ELSE 'Privacy metric ''' || metric_name || ''' failed.' END
        ELSE 'Explainability metric ''' || metric_name || ''' = ' || num || '. The model may not be sufficiently interpretable.' END"""

ADVICE_SQL = """
    CASE principle WHEN 'fairness' THEN
        CASE WHEN metric_name LIKE '%parity%' OR metric_name LIKE '%impact%' THEN
                'Consider applying fairness constraints (e.g., reweighing, threshold adjustment) targeting ''' || which || ''' to achieve demographic parity.'
             WHEN metric_name LIKE '%opportunity%' THEN
                'Retrain the model with equalized-opportunity constraints on ''' || which || ''' to balance true positive rates across groups.'
             WHEN metric_name LIKE '%odds%' THEN
                'Apply calibration or post-processing to equalize error rates across groups defined by ''' || which || '''.'
             ELSE 'Review and address fairness for metric ''' || metric_name || '''.' END
        WHEN 'privacy' THEN
        CASE WHEN metric_name LIKE '%pii%' THEN 'Remove or anonymize columns containing PII before deploying the model.'
             WHEN metric_name LIKE '%anonymity%' THEN 'Generalize or suppress quasi-identifier columns to increase k-anonymity.'
             WHEN metric_name LIKE '%diversity%' THEN 'Apply data perturbation or generalization to improve l-diversity.'
             ELSE 'Address privacy concern for metric ''' || metric_name || '''.' END
        ELSE 'Consider using a simpler, more interpretable model or adding SHAP/LIME explanation layers to improve transparency.' END"""


@register("trace_root_causes", with_views(f"""
    SELECT validation_id, result_no, principle, metric_name, metric_value, threshold, ROUND(ABS(metric_value - threshold), 4) AS gap,
           {CAUSE_SQL} AS description, {ADVICE_SQL} AS recommendation
    FROM (SELECT r.*, COALESCE(d.sensitive_attribute, 'unknown attribute') AS who, COALESCE(d.sensitive_attribute, 'the sensitive attribute') AS which,
                 COALESCE(PRINTF('%.3f', metric_value), 'N/A') AS val, COALESCE(CAST(metric_value AS VARCHAR), 'None') AS num
          FROM g_results r LEFT JOIN g_validations v ON r.validation_id = v.validation_id
          LEFT JOIN g_datasets d ON v.dataset_id = d.dataset_id WHERE NOT passed)""",
    "g_results", "g_validations", "g_datasets"))
def trace_root_causes(spark, directory):
    return trace.root_causes(*views(spark, directory, "g_results", "g_validations", "g_datasets"))


@register("trace_cause_details", """
    SELECT l_orderkey AS validation_id, l_shipdate::VARCHAR AS metric_name, l_returnflag AS affected_feature,
           '{"a":' || l_linenumber || '}' AS group_breakdown FROM lineitem WHERE l_discount < 0.02""")
def trace_cause_details(spark, directory):
    from probity.sources.tables import table

    results = table(spark, directory, "lineitem").select(
        F.col("l_orderkey").alias("validation_id"), F.col("l_shipdate").cast("string").alias("metric_name"),
        (F.col("l_discount") >= 0.02).alias("passed"),
        F.to_json(F.struct(
            F.col("l_returnflag").alias("affected_feature"),
            F.struct(F.col("l_linenumber").alias("a")).alias("group_metrics"))).alias("details"))
    return trace.cause_details(results)


LATEST_SQL = """latest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (
        PARTITION BY validation_id, metric_name ORDER BY result_no DESC) AS rn FROM g_results) WHERE rn = 1)"""

SENTENCE_SQL = """
    CASE WHEN metric_value IS NULL THEN NULL WHEN principle = 'fairness' THEN metric_name || ': ' || PRINTF('%.3f', metric_value) || ' — ' ||
        CASE WHEN metric_name LIKE '%parity%' OR metric_name LIKE '%impact%' THEN
                CASE WHEN passed THEN 'model shows acceptable group parity.' ELSE 'model exhibits disparity between demographic groups.' END
             WHEN metric_name LIKE '%opportunity%' OR metric_name LIKE '%odds%' THEN
                CASE WHEN passed THEN 'model errors are balanced across groups.' ELSE 'model error rates differ significantly across groups.' END
             ELSE CASE WHEN passed THEN 'passed.' ELSE 'failed.' END END
        WHEN principle = 'privacy' THEN CASE WHEN passed THEN metric_name || ': privacy check passed.'
             ELSE metric_name || ': privacy risk detected (value=' || CAST(metric_value AS VARCHAR) || ').' END
        ELSE metric_name || ': explainability metric ' || PRINTF('%.3f', metric_value) || '.' END"""


@register("trace_behaviour_sentences", with_views(f"""
    SELECT * FROM (SELECT validation_id, result_no, {SENTENCE_SQL} AS sentence FROM g_results) WHERE sentence IS NOT NULL""", "g_results"))
def trace_behaviour_sentences(spark, directory):
    return trace.behaviour_sentences(view(spark, directory, "g_results"))


@register("trace_behaviour_patterns", with_views("", "g_results", "g_validations") + f""", {LATEST_SQL}
    SELECT v.validation_id, CASE WHEN n IS NULL THEN 'No validation results available.'
           WHEN txt IS NULL THEN 'No measurable behavior patterns detected.' ELSE txt END AS behavior_pattern
    FROM g_validations v LEFT JOIN (
        SELECT validation_id, COUNT(*) AS n, STRING_AGG(sentence, ' ' ORDER BY result_no, sentence) AS txt
        FROM (SELECT *, {SENTENCE_SQL} AS sentence FROM latest) GROUP BY validation_id) s ON v.validation_id = s.validation_id""")
def trace_behaviour_patterns(spark, directory):
    return trace.behaviour_patterns(*views(spark, directory, "g_validations", "g_results"))


@register("trace_export", trace_sql("""
    SELECT COALESCE(requirement_name, '') AS "Requirement", COALESCE(principle, '') AS "Principle", COALESCE(dataset_name, '') AS "Dataset",
           COALESCE(model_name, '') AS "Model", metrics_passed AS "Metrics Passed", metrics_total AS "Total Metrics", status AS "Status",
           '' AS "Behavior Pattern" FROM traces WHERE status IN ('pass', 'fail')"""))
def trace_export(spark, directory):
    return trace.trace_export(trace.filter_traces(traces_of(spark, directory)))


# --- History -----------------------------------------------------------------------

SLOTS_SQL = """, slots AS (
        SELECT suite_id, fairness_validation_id AS validation_id, 'fairness' AS slot FROM g_suites WHERE fairness_validation_id IS NOT NULL
        UNION ALL SELECT suite_id, transparency_validation_id, 'transparency' FROM g_suites WHERE transparency_validation_id IS NOT NULL
        UNION ALL SELECT suite_id, privacy_validation_id, 'privacy' FROM g_suites WHERE privacy_validation_id IS NOT NULL)"""


@register("history_suites", with_views("", "g_suites", "g_models", "g_datasets", "g_results") + SLOTS_SQL + """,
    chosen AS (SELECT * FROM (
        SELECT s.*, m.project_id, m.name AS model_name, ROW_NUMBER() OVER (
            PARTITION BY m.project_id ORDER BY started_at DESC, suite_id DESC) AS r
        FROM g_suites s JOIN g_models m ON s.model_id = m.model_id) WHERE r <= 50),
    counts AS (SELECT validation_id, COUNT(*) AS n, SUM(CASE WHEN passed THEN 1 ELSE 0 END)::BIGINT AS ok FROM g_results GROUP BY validation_id)
    SELECT c.project_id, c.suite_id, model_name, COALESCE(d.name, 'Unknown') AS dataset_name, status, overall_passed,
           STRFTIME(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, p.principle, s.validation_id IS NOT NULL AS completed,
           COALESCE(n, 0) AS metrics_count, COALESCE(ok, 0) AS passed_count
    FROM chosen c CROSS JOIN (VALUES ('fairness'), ('transparency'), ('privacy')) p(principle)
    LEFT JOIN slots s ON s.suite_id = c.suite_id AND s.slot = p.principle LEFT JOIN counts k ON k.validation_id = s.validation_id
    LEFT JOIN g_datasets d ON c.dataset_id = d.dataset_id""")
def history_suites(spark, directory):
    suites, models, datasets, results = views(spark, directory, "g_suites", "g_models", "g_datasets", "g_results")
    return history.suite_history(suites, models, datasets, results).withColumn("started_at", stamp("started_at"))


@register("history_suite_slots", with_views("", "g_suites") + SLOTS_SQL + " SELECT suite_id, validation_id, slot AS principle FROM slots")
def history_suite_slots(spark, directory):
    return trace.suite_validations(view(spark, directory, "g_suites")).select("suite_id", "validation_id", "principle")


METRICS_SQL = SLOTS_SQL + f""", {LATEST_SQL.replace("FROM g_results)", "FROM g_results WHERE metric_value IS NOT NULL)")},
    metrics AS (SELECT suite_id, slot AS principle, metric_name, metric_value AS value, threshold, passed
                FROM slots JOIN latest ON slots.validation_id = latest.validation_id)"""


def metrics_of(spark, directory):
    return history.suite_metrics(*views(spark, directory, "g_suites", "g_results"))


@register("history_suite_metrics", with_views("", "g_suites", "g_results") + METRICS_SQL + " SELECT * FROM metrics")
def history_suite_metrics(spark, directory):
    return metrics_of(spark, directory)


@register("history_suite_results", with_views("", "g_suites", "g_results", "g_validations") + SLOTS_SQL + """
    SELECT suite_id, slot AS principle, s.validation_id, COALESCE(v.status, 'not_run') AS validation_status,
           metric_name, metric_value, threshold, passed
    FROM slots s LEFT JOIN g_validations v ON s.validation_id = v.validation_id LEFT JOIN g_results r ON s.validation_id = r.validation_id""")
def history_suite_results(spark, directory):
    return history.suite_results(*views(spark, directory, "g_suites", "g_validations", "g_results"))


@register("history_compare_runs", with_views("", "g_suites", "g_results") + METRICS_SQL + """,
    pairs AS (SELECT MAX(CASE WHEN r = 2 THEN suite_id END) AS run_a, MAX(CASE WHEN r = 1 THEN suite_id END) AS run_b FROM (
        SELECT model_id, suite_id, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY started_at DESC, suite_id DESC) AS r FROM g_suites)
        WHERE r <= 2 GROUP BY model_id HAVING COUNT(*) = 2),
    a AS (SELECT p.*, principle, metric_name, value FROM pairs p JOIN metrics m ON m.suite_id = run_a),
    b AS (SELECT p.*, principle, metric_name, value FROM pairs p JOIN metrics m ON m.suite_id = run_b)
    SELECT COALESCE(a.run_a, b.run_a) AS run_a, COALESCE(a.run_b, b.run_b) AS run_b, COALESCE(a.principle, b.principle) AS principle,
           COALESCE(a.metric_name, b.metric_name) AS metric_name, a.value AS value_a, b.value AS value_b,
           ROUND(b.value - a.value, 6) AS delta,
           CASE WHEN b.value = a.value THEN NULL WHEN COALESCE(a.metric_name, b.metric_name) LIKE '%difference%'
                THEN b.value < a.value ELSE b.value > a.value END AS improved
    FROM a FULL OUTER JOIN b ON a.run_a = b.run_a AND a.run_b = b.run_b AND a.principle = b.principle AND a.metric_name = b.metric_name""")
def history_compare_runs(spark, directory):
    pairs = history.latest_pairs(view(spark, directory, "g_suites"))
    return history.compare_runs(metrics_of(spark, directory), pairs).withColumn("delta", F.round("delta", 6))


TREND = ("demographic_parity_ratio", "disparate_impact_ratio", "equalized_odds_difference")


@register("history_metric_trend", with_views("", "g_suites", "g_results") + METRICS_SQL + f""",
    runs AS (SELECT suite_id, {', '.join(f"MAX(CASE WHEN metric_name = '{m}' THEN value END) AS {m}" for m in TREND)}
             FROM metrics WHERE principle = 'fairness' GROUP BY suite_id),
    dated AS (SELECT runs.*, model_id, STRFTIME(started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM runs JOIN g_suites s ON runs.suite_id = s.suite_id)
    SELECT * FROM dated WHERE model_id IN (SELECT model_id FROM dated GROUP BY model_id HAVING COUNT(*) >= 2)""")
def history_metric_trend(spark, directory):
    trend = history.metric_trend(view(spark, directory, "g_suites"), metrics_of(spark, directory), TREND)
    return trend.withColumn("started_at", stamp("started_at"))


@register("history_suite_verdicts", with_views("", "g_suites", "g_results", "g_validations") + SLOTS_SQL + """,
    passed AS (SELECT validation_id, BOOL_AND(passed) AS ok FROM g_results GROUP BY validation_id),
    parts AS (SELECT s.suite_id, MAX(CASE WHEN slot = 'fairness' THEN ok::INTEGER END) AS f, MAX(CASE WHEN slot = 'privacy' THEN ok::INTEGER END) AS p,
                     MAX(CASE WHEN slot = 'transparency' THEN v.status END) AS t
              FROM slots s LEFT JOIN passed r ON s.validation_id = r.validation_id LEFT JOIN g_validations v ON s.validation_id = v.validation_id
              GROUP BY s.suite_id)
    SELECT suite_id, COALESCE(f, 1) = 1 AND COALESCE(p, 1) = 1 AND COALESCE(t IN ('completed', 'skipped'), TRUE) AS overall_passed FROM parts""")
def history_suite_verdicts(spark, directory):
    suites, validations, results = views(spark, directory, "g_suites", "g_validations", "g_results")
    passed = results.groupBy("validation_id").agg(F.bool_and("passed").alias("ok"))
    slots = trace.suite_validations(suites).select("suite_id", "principle", "validation_id")
    joined = slots.join(passed, "validation_id", "left").join(
        validations.select("validation_id", F.col("status").alias("state")), "validation_id", "left")
    pick = lambda p, c: F.max(F.when(F.col("principle") == p, F.col(c)))
    parts = joined.groupBy("suite_id").agg(
        pick("fairness", "ok").alias("fairness_passed"), pick("privacy", "ok").alias("privacy_passed"),
        pick("transparency", "state").alias("transparency_status"))
    return history.suite_verdict(parts)


@register("history_requirement_links", with_views("""
    SELECT project_id, principle, MAX(requirement_id) AS requirement_id FROM g_requirements GROUP BY ALL""", "g_requirements"))
def history_requirement_links(spark, directory):
    return history.requirement_links(view(spark, directory, "g_requirements"))


@register("history_json_safe", """
    SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 OR o_custkey % 5 = 0 THEN NULL ELSE o_totalprice END AS score,
           CASE WHEN o_custkey % 3 = 0 OR o_custkey % 5 = 0 THEN 1 ELSE 2 END AS kept FROM orders""")
def history_json_safe(spark, directory):
    from probity.sources.tables import table

    key = F.col("o_custkey")
    score = F.when(key % 3 == 0, F.lit(float("nan"))).when(key % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    df = table(spark, directory, "orders").select("o_orderkey", score.alias("score"), F.array(score, F.lit(1.0)).alias("nested"))
    safe = texts.json_safe(df)
    return safe.select("o_orderkey", "score", F.size(F.array_compact("nested")).alias("kept"))


# --- Reports ------------------------------------------------------------------------

def artifacts_of(spark, directory):
    """Artifacts as stored JSON, some unreadable, parsed again."""
    facts = view(spark, directory, "g_artifacts")
    pii = F.transform(F.sequence(F.lit(1), F.col("pii_count")), lambda i: F.concat(F.lit("col"), i.cast("string")))
    privacy = facts.withColumns({
        "overall_passed": (F.col("pii_count") == 0) & F.col("satisfies_k") & F.col("satisfies_l") & F.col("hipaa_passed"),
        "pii_detected": F.when(F.col("pii_count") > 0, pii).otherwise(F.array().cast("array<string>")),
        "k_anonymity": F.struct(F.lit(5.0).alias("k_value"), "satisfies_k"),
        "l_diversity": F.struct(F.lit(2.0).alias("l_value"), "satisfies_l"),
        "hipaa": F.struct(F.col("hipaa_passed").alias("overall_passed")),
    })
    broken = F.when(F.col("readable"), F.col("payload")).otherwise("{broken")
    stored = as_payload(privacy, "privacy_run", "overall_passed", "pii_detected", "k_anonymity", "l_diversity", "hipaa", "readable")
    stored = stored.withColumn("readable", F.get_json_object("payload", "$.readable").cast("boolean")).withColumn("payload", broken)
    shown = as_payload(facts, "transparency_run", "warning", "features")
    return parsed(stored.select("run_id", "payload").unionByName(shown), reports.ARTIFACT_FIELDS).withColumn(
        "run_id", F.col("run_id").cast("bigint"))


REPORT_VIEWS = ("g_suites", "g_validations", "g_results", "g_artifacts", "g_models", "g_datasets", "g_projects")
SECTIONS_SQL = SLOTS_SQL + f""", {LATEST_SQL},
    outcome AS (
        SELECT validation_id, COUNT(*) AS total, SUM(CASE WHEN passed THEN 0 ELSE 1 END) AS failed,
               MAX(CASE WHEN metric_name = 'demographic_parity_ratio' THEN 'Demographic Parity Ratio >= ' || PRINTF('%.3f', threshold) || ': '
                   || COALESCE(PRINTF('%.3f', metric_value), 'N/A') || CASE WHEN passed THEN ' (PASS)' ELSE ' (FAIL)' END END) AS dpr,
               MAX(CASE WHEN metric_name = 'equalized_odds_ratio' THEN 'Equalized Odds Ratio >= ' || PRINTF('%.3f', threshold) || ': '
                   || COALESCE(PRINTF('%.3f', metric_value), 'N/A') || CASE WHEN passed THEN ' (PASS)' ELSE ' (FAIL)' END END) AS eor
        FROM latest GROUP BY validation_id),
    names AS (
        SELECT validation_id, STRING_AGG(metric_name, ', ' ORDER BY r) AS failed_names FROM (
            SELECT validation_id, metric_name, ROW_NUMBER() OVER (PARTITION BY validation_id ORDER BY result_no, metric_name) AS r
            FROM latest WHERE NOT passed) WHERE r <= 3 GROUP BY validation_id),
    wide AS (
        SELECT s.suite_id, s.model_id, s.dataset_id, s.overall_passed, s.started_at,
               COALESCE(fv.status, 'not_run') AS f, COALESCE(tv.status, 'not_run') AS t, COALESCE(pv.status, 'not_run') AS p,
               COALESCE(o.total, 0) AS f_total, COALESCE(o.failed, 0) AS f_failed, n.failed_names, o.dpr, o.eor,
               a.warning, a.features, s.privacy_validation_id IS NOT NULL AND a.readable AS has_facts,
               CASE WHEN s.privacy_validation_id IS NOT NULL AND a.readable THEN a.pii_count = 0 AND satisfies_k AND satisfies_l AND hipaa_passed ELSE FALSE END AS private,
               a.pii_count, a.satisfies_k, a.satisfies_l, a.hipaa_passed, COALESCE(o.total, 0) > 0 AND COALESCE(o.failed, 0) = 0 AS fair
        FROM g_suites s LEFT JOIN g_validations fv ON s.fairness_validation_id = fv.validation_id
        LEFT JOIN g_validations tv ON s.transparency_validation_id = tv.validation_id
        LEFT JOIN g_validations pv ON s.privacy_validation_id = pv.validation_id
        LEFT JOIN outcome o ON s.fairness_validation_id = o.validation_id LEFT JOIN names n ON s.fairness_validation_id = n.validation_id
        LEFT JOIN g_artifacts a ON a.suite_id = s.suite_id),
    summary AS (
        SELECT suite_id, n AS sections, k AS sections_passed, CASE WHEN n = 0 THEN 'No completed validation sections were found for this suite yet.'
               ELSE 'Model passed ' || k || ' out of ' || n || ' completed ethical validation sections.' || CASE WHEN bad <> ''
               THEN ' Areas requiring attention: ' || bad || '.' ELSE ' No major ethical validation failures were detected in completed sections.' END END AS executive_summary
        FROM (SELECT suite_id, (f = 'completed')::INTEGER + (t = 'completed')::INTEGER + (p = 'completed')::INTEGER AS n,
                     (f = 'completed' AND fair)::INTEGER + (t = 'completed')::INTEGER + (p = 'completed' AND private)::INTEGER AS k,
                     CONCAT_WS(', ', CASE WHEN f = 'completed' AND NOT fair THEN 'fairness' END,
                                     CASE WHEN p = 'completed' AND NOT private THEN 'privacy' END) AS bad FROM wide))"""


def report_sql(body):
    return with_views("", *REPORT_VIEWS) + SECTIONS_SQL + body


def wide_of(spark, directory):
    suites, validations, results = views(spark, directory, "g_suites", "g_validations", "g_results")
    return reports.sections(suites, validations, results, artifacts_of(spark, directory))


@register("report_executive_summaries", report_sql(" SELECT * FROM summary"))
def report_executive_summaries(spark, directory):
    return reports.executive_summary(wide_of(spark, directory))


@register("report_suites", report_sql("""
    SELECT w.suite_id, m.project_id, CASE WHEN m.project_id IS NOT NULL THEN COALESCE(p.name, 'Unknown Project') END AS project_name,
           COALESCE(m.name, 'Unknown') AS model_name, COALESCE(d.name, 'Unknown') AS dataset_name,
           CASE WHEN w.overall_passed THEN 'pass' ELSE 'fail' END AS overall_status, STRFTIME(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
           sections, sections_passed, executive_summary
    FROM wide w LEFT JOIN g_models m ON w.model_id = m.model_id LEFT JOIN g_datasets d ON w.dataset_id = d.dataset_id
    LEFT JOIN g_projects p ON m.project_id = p.project_id JOIN summary s ON s.suite_id = w.suite_id"""))
def report_suites(spark, directory):
    models, datasets, projects = views(spark, directory, "g_models", "g_datasets", "g_projects")
    out = reports.suite_report(wide_of(spark, directory), models, datasets, projects)
    return out.withColumn("started_at", stamp("started_at"))


@register("report_recommendations", report_sql("""
    , lines AS (
        SELECT suite_id, 1 AS o, CASE WHEN f_failed > 0 THEN 'Address failed fairness metrics (' || failed_names || '): rebalance data and tune decision thresholds.'
               WHEN f NOT IN ('completed', 'not_run') THEN 'Investigate fairness validation execution status before approving deployment.'
               WHEN f = 'not_run' THEN 'Run fairness validation on sensitive groups before production release.' END AS line FROM wide
        UNION ALL SELECT suite_id, 2, CASE WHEN t = 'completed' AND features = 0 THEN 'Enable/verify explainability artifact generation (SHAP/LIME) for transparency evidence.'
               WHEN t = 'not_run' THEN 'Run transparency validation and publish model-card evidence for governance reviews.' END FROM wide
        UNION ALL SELECT suite_id, 3, 'Transparency warning: ' || warning FROM wide
        UNION ALL SELECT suite_id, 4, CASE WHEN has_facts AND pii_count > 0 THEN 'Remove, mask, or tokenize detected PII columns (col1, col2'
               || CASE WHEN pii_count > 2 THEN ', col3' ELSE '' END || ') before model training/inference.' END FROM wide
        UNION ALL SELECT suite_id, 5, CASE WHEN has_facts AND NOT satisfies_k THEN 'Improve quasi-identifier generalization/suppression to satisfy k-anonymity (target k=5).' END FROM wide
        UNION ALL SELECT suite_id, 6, CASE WHEN has_facts AND NOT satisfies_l THEN 'Increase sensitive-attribute diversity to satisfy l-diversity (target l=2).' END FROM wide
        UNION ALL SELECT suite_id, 7, CASE WHEN p = 'not_run' THEN 'Run privacy validation (PII, anonymity checks) before sharing datasets externally.' END FROM wide),
    kept AS (SELECT suite_id, line, CAST(ROW_NUMBER() OVER (PARTITION BY suite_id ORDER BY o) - 1 AS INTEGER) AS position FROM lines WHERE line IS NOT NULL)
    SELECT w.suite_id, COALESCE(k.position, 0) AS position,
           COALESCE(line, 'Maintain periodic monitoring and rerun validation after any model/data updates.') AS recommendation
    FROM wide w LEFT JOIN kept k ON w.suite_id = k.suite_id"""))
def report_recommendations(spark, directory):
    return reports.recommendations(wide_of(spark, directory))


@register("report_certificate_status", report_sql("""
    SELECT suite_id, CASE WHEN f = 'not_run' THEN 'NOT RUN' WHEN fair THEN 'PASS' ELSE 'FAIL' END AS fairness,
           CASE WHEN t = 'not_run' THEN 'NOT RUN' WHEN t = 'completed' THEN 'PASS' ELSE 'FAIL' END AS transparency,
           CASE WHEN p = 'not_run' THEN 'NOT RUN' WHEN private THEN 'PASS' ELSE 'FAIL' END AS privacy, 'RECORDED' AS accountability
    FROM wide"""))
def report_certificate_status(spark, directory):
    return reports.principle_status(wide_of(spark, directory))


@register("report_certificate_checks", report_sql("""
    , lines AS (
        SELECT suite_id, 1 AS o, CASE WHEN f = 'completed' THEN COALESCE(dpr, 'Demographic Parity Ratio: not evaluated in this run') ELSE 'Fairness checks: not run' END AS line FROM wide
        UNION ALL SELECT suite_id, 2, CASE WHEN f = 'completed' THEN eor END FROM wide
        UNION ALL SELECT suite_id, 3, CASE WHEN t = 'completed' THEN 'Transparency evidence (SHAP/LIME/model card): available'
                  ELSE 'Transparency evidence: not available (validation not completed)' END FROM wide
        UNION ALL SELECT suite_id, 4, CASE WHEN p = 'completed' THEN 'PII detection: ' || CASE WHEN has_facts THEN pii_count ELSE 0 END || ' flagged column(s)' ELSE 'Privacy checks: not run' END FROM wide
        UNION ALL SELECT suite_id, 5, CASE WHEN p = 'completed' AND has_facts THEN 'k-Anonymity (k=5): ' || CASE WHEN satisfies_k THEN 'PASS' ELSE 'FAIL' END END FROM wide
        UNION ALL SELECT suite_id, 6, CASE WHEN p = 'completed' AND has_facts THEN 'HIPAA Safe Harbor: ' || CASE WHEN hipaa_passed THEN 'PASS' ELSE 'FAIL' END END FROM wide)
    SELECT suite_id, CAST(ROW_NUMBER() OVER (PARTITION BY suite_id ORDER BY o) - 1 AS INTEGER) AS position, line AS "check" FROM lines WHERE line IS NOT NULL"""))
def report_certificate_checks(spark, directory):
    return reports.certificate_checks(wide_of(spark, directory))


@register("report_project_compliance", with_views("""
    SELECT project_id, COUNT(*) AS total_suites, SUM(CASE WHEN overall_passed THEN 1 ELSE 0 END)::BIGINT AS passed_suites,
           ROUND(SUM(CASE WHEN overall_passed THEN 1 ELSE 0 END)::DOUBLE / COUNT(*), 6) AS compliance_rate,
           CASE WHEN SUM(CASE WHEN overall_passed THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) >= 0.8 THEN 'pass' ELSE 'fail' END AS verdict
    FROM g_suites s JOIN g_models m ON s.model_id = m.model_id GROUP BY project_id""", "g_suites", "g_models"))
def report_project_compliance(spark, directory):
    out = reports.project_compliance(*views(spark, directory, "g_suites", "g_models"))
    return out.withColumn("compliance_rate", F.round("compliance_rate", 6))


@register("report_compliance_history", with_views("""
    SELECT project_id, suite_id, status, COALESCE(overall_passed, FALSE) AS overall_passed, STRFTIME(started_at, '%Y-%m-%d %H:%M:%S') AS started_at
    FROM g_suites s JOIN g_models m ON s.model_id = m.model_id""", "g_suites", "g_models"))
def report_compliance_history(spark, directory):
    out = reports.compliance_history(*views(spark, directory, "g_suites", "g_models"))
    return out.withColumn("started_at", stamp("started_at"))


@register("report_period_compliance", with_views("""
    SELECT project_id, COUNT(*) AS total_suites, SUM(CASE WHEN overall_passed THEN 1 ELSE 0 END)::BIGINT AS passed_suites
    FROM g_suites s JOIN g_models m ON s.model_id = m.model_id
    WHERE started_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY project_id""", "g_suites", "g_models"))
def report_period_compliance(spark, directory):
    suites, models = views(spark, directory, "g_suites", "g_models")
    period = reports.custom_report(
        None, suites, models, None, include=("summary",), date_from="1996-01-01 00:00:00", date_to="1997-12-31 00:00:00")
    return period["summary"].select("project_id", "total_suites", "passed_suites")


CUSTOM_FROM, CUSTOM_TO = "1996-01-01 00:00:00", "1997-12-31 00:00:00"


def custom_report_of(spark, directory):
    """Every section of the custom report over a period, for all projects."""
    suites, models = views(spark, directory, "g_suites", "g_models")
    return reports.custom_report(None, suites, models, traces_of(spark, directory), date_from=CUSTOM_FROM, date_to=CUSTOM_TO)


@register("report_custom_history", with_views("""
    SELECT project_id, suite_id, status, COALESCE(overall_passed, FALSE) AS overall_passed, STRFTIME(started_at, '%Y-%m-%d %H:%M:%S') AS started_at
    FROM g_suites s JOIN g_models m ON s.model_id = m.model_id
    WHERE started_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'""", "g_suites", "g_models"))
def report_custom_history(spark, directory):
    return custom_report_of(spark, directory)["history"].withColumn("started_at", stamp("started_at"))


@register("report_custom_traceability", trace_sql(" SELECT * FROM traces"))
def report_custom_traceability(spark, directory):
    return custom_report_of(spark, directory)["traceability"]


# --- Remediation ---------------------------------------------------------------------

STEPS_SQL = SLOTS_SQL + f""", {LATEST_SQL},
    metric_steps AS (
        SELECT suite_id, slot AS principle, result_no AS o, CASE slot WHEN 'fairness' THEN 'fair-' ELSE 'trans-' END || metric_name AS step_id,
               CASE slot WHEN 'fairness' THEN 'Fix failed fairness metric ''' ELSE 'Fix transparency metric ''' END || metric_name || ''' (value='
               || COALESCE(PRINTF('%.3f', metric_value), 'N/A') || ', threshold=' || PRINTF('%.3f', threshold) || '); '
               || CASE slot WHEN 'fairness' THEN 'apply bias mitigation and reassess group impacts.' ELSE 'improve explainability artifacts/model-card quality.' END AS text
        FROM slots JOIN latest ON slots.validation_id = latest.validation_id WHERE NOT passed AND slot <> 'privacy'),
    facts AS (SELECT a.* FROM g_artifacts a JOIN slots s ON s.validation_id = a.privacy_run WHERE readable),
    steps AS (
        SELECT * FROM metric_steps
        UNION ALL SELECT s.suite_id, 'transparency', 4611686018427387903, 'trans-warning', 'Address transparency warning: ' || warning
        FROM g_artifacts a JOIN slots s ON s.validation_id = a.transparency_run WHERE warning IS NOT NULL
        UNION ALL SELECT suite_id, 'privacy', 1, 'priv-pii', 'Mask/remove detected PII columns: ' || CASE pii_count WHEN 2 THEN 'col1, col2' ELSE 'col1, col2, col3, col4' END || '.' FROM facts WHERE pii_count > 0
        UNION ALL SELECT suite_id, 'privacy', 2, 'priv-k-anonymity', 'Increase k-anonymity: actual min k=N/A, required k=5.' FROM facts WHERE NOT satisfies_k
        UNION ALL SELECT suite_id, 'privacy', 3, 'priv-l-diversity', 'Increase l-diversity: actual min l=N/A, required l=2.' FROM facts WHERE NOT satisfies_l
        UNION ALL SELECT suite_id, 'privacy', 4, 'priv-hipaa', 'Resolve HIPAA Safe Harbor violations by de-identifying flagged identifiers.' FROM facts WHERE NOT hipaa_passed),
    with_rerun AS (
        SELECT * FROM steps
        UNION ALL SELECT DISTINCT suite_id, principle, 4611686018427387904,
            CASE principle WHEN 'fairness' THEN 'fair-revalidate' WHEN 'privacy' THEN 'priv-revalidate' ELSE 'trans-revalidate' END,
            CASE principle WHEN 'fairness' THEN 'Re-run fairness validation to confirm all fairness metrics pass.'
                WHEN 'privacy' THEN 'Re-run privacy validation to verify all privacy checks pass.'
                ELSE 'Re-run transparency validation after remediation updates.' END FROM steps)"""


def steps_of(spark, directory, principles=None):
    suites, results = views(spark, directory, "g_suites", "g_results")
    return remediation.step_lists(suites, results, artifacts_of(spark, directory), principles)


@register("remediation_steps", with_views("", "g_suites", "g_results", "g_artifacts") + STEPS_SQL + """
    SELECT suite_id, principle, step_id, text, '/knowledge-base#' || principle AS link,
           CAST(ROW_NUMBER() OVER (PARTITION BY suite_id, principle ORDER BY o, step_id) AS INTEGER) AS number FROM with_rerun""")
def remediation_steps(spark, directory):
    return remediation.numbered_steps(steps_of(spark, directory))


@register("remediation_chosen_principles", with_views("", "g_suites", "g_results", "g_artifacts") + STEPS_SQL + """
    SELECT principle, COUNT(*) AS steps, COUNT(DISTINCT suite_id) AS suites FROM with_rerun WHERE principle <> 'transparency' GROUP BY principle""")
def remediation_chosen_principles(spark, directory):
    steps = remediation.numbered_steps(steps_of(spark, directory, ["privacy", "fairness"]))
    return steps.groupBy("principle").agg(
        F.count(F.lit(1)).alias("steps"), F.count_distinct("suite_id").alias("suites"))


@register("remediation_checklists", with_views("", "g_suites", "g_results", "g_artifacts") + STEPS_SQL + """,
    fresh AS (SELECT suite_id, principle, COUNT(*) AS n FROM with_rerun WHERE suite_id % 3 <> 0 GROUP BY suite_id, principle),
    existing AS (SELECT suite_id, 'fairness' AS principle FROM g_suites UNION ALL SELECT suite_id, 'accountability' FROM g_suites)
    SELECT f.suite_id, f.principle, CASE WHEN e.suite_id IS NOT NULL THEN 'replaced' ELSE 'inserted' END AS change, n::INTEGER AS steps
    FROM fresh f LEFT JOIN existing e ON f.suite_id = e.suite_id AND f.principle = e.principle
    UNION ALL SELECT suite_id, principle, 'kept', 1 FROM existing WHERE suite_id % 3 = 0""")
def remediation_checklists(spark, directory):
    suites = view(spark, directory, "g_suites")
    old_step = F.array(F.struct(
        F.lit("old").alias("id"), F.lit("old").alias("text"), F.lit("").alias("link"), F.lit(True).alias("done")))
    existing = suites.select(
        F.lit("u1").alias("user_id"), "suite_id",
        F.explode(F.array(F.lit("fairness"), F.lit("accountability"))).alias("principle"), old_step.alias("steps"))
    # Two of three suites are refreshed, whether they have steps left or not.
    refreshed = suites.where("suite_id % 3 <> 0").select(F.lit("u1").alias("user_id"), "suite_id")
    fresh = remediation.checklists(steps_of(spark, directory), "u1").join(refreshed.select("suite_id"), "suite_id", "left_semi")
    out = remediation.refresh_checklists(existing, fresh, refreshed)
    return out.select("suite_id", "principle", "change", F.size("steps").alias("steps"))


@register("remediation_step_toggle", with_views("", "g_suites", "g_results", "g_artifacts") + STEPS_SQL + """
    SELECT suite_id, principle, COUNT(*)::INTEGER AS steps, SUM(CASE WHEN step_id = 'priv-k-anonymity' THEN 1 ELSE 0 END)::INTEGER AS done_steps,
           COUNT(*) = SUM(CASE WHEN step_id = 'priv-k-anonymity' THEN 1 ELSE 0 END) AS all_done
    FROM with_rerun WHERE principle = 'privacy' GROUP BY suite_id, principle""")
def remediation_step_toggle(spark, directory):
    lists = remediation.checklists(steps_of(spark, directory, ["privacy"]), "u1")
    marked = remediation.with_all_done(remediation.set_step(lists, "priv-k-anonymity"))
    return marked.select(
        "suite_id", "principle", F.size("steps").alias("steps"),
        F.size(F.filter("steps", lambda s: s["done"])).alias("done_steps"), "all_done")


@register("report_payloads_or_default", with_views("""
    SELECT privacy_run::VARCHAR AS run_id, CASE WHEN readable AND p.suite_id IS NOT NULL THEN 'stored' ELSE '{}' END AS payload
    FROM g_artifacts a LEFT JOIN (SELECT suite_id FROM g_artifacts WHERE features > 0) p ON a.suite_id = p.suite_id""", "g_artifacts"))
def report_payloads_or_default(spark, directory):
    facts = view(spark, directory, "g_artifacts")
    stored = as_payload(facts.where("features > 0"), "privacy_run", "pii_count", "readable")
    readable = F.get_json_object("payload", "$.readable") == "true"
    stored = stored.withColumn("payload", F.when(readable, F.col("payload")).otherwise("{broken"))
    out = payload_or_default(facts.select(F.col("privacy_run").cast("string").alias("run_id")), stored)
    return out.select("run_id", F.when(F.col("payload") == "{}", "{}").otherwise("stored").alias("payload"))


def stored_folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_payloads(spark, directory):
    """Artifacts of four kinds written to the shared folder and read back, some of them no JSON."""
    folder = stored_folder(spark, "artifacts")
    facts = view(spark, directory, "g_artifacts")
    checked = facts.select(
        "privacy_run", ((F.col("pii_count") == 0) & F.col("satisfies_k")).alias("overall_passed"),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("pii_count")), lambda i: i > 0), lambda i: F.concat(F.lit("col"), i.cast("string"))).alias("pii_detected"),
        "readable")
    privacy = as_payload(checked, "privacy_run", "overall_passed", "pii_detected", "readable")
    broken = F.get_json_object("payload", "$.readable") == "false"
    write_artifacts(privacy.withColumn("payload", F.when(broken, "{broken").otherwise(F.col("payload"))), folder, "privacy_report")
    value = lambda start, step: (F.lit(start) - F.col("features") * step) / 8
    importance = facts.where("features > 0").select("transparency_run", value(6, 4).alias("balance"), value(-4, 1).alias("price"), F.lit(0.25).alias("nation"))
    write_artifacts(as_payload(importance, "transparency_run"), folder, "feature_importance")
    write_artifacts(as_payload(facts.where("features = 2"), "transparency_run", "features"), folder, "model_card")
    write_artifacts(as_payload(facts.where("warning IS NOT NULL"), "transparency_run", "warning"), folder, "transparency_warning")
    return variant_payloads(spark, folder)


def suites_and_runs(spark, directory):
    suites, validations = views(spark, directory, "g_suites", "g_validations")
    return suites, validations.withColumn("run_id", F.col("validation_id"))


@register("report_privacy_details", with_views("""
    SELECT s.suite_id, v.validation_id, v.status, CASE WHEN readable THEN '{"overall_passed":' || ok || ',"pii_detected":[' || list || '],"readable":true}' ELSE '{}' END AS payload,
           CASE WHEN readable THEN ok END AS overall_passed, CASE WHEN readable THEN REPLACE(list, '"', '') END AS pii_detected
    FROM g_suites s JOIN g_validations v ON v.validation_id = s.privacy_validation_id
    JOIN (SELECT *, pii_count = 0 AND satisfies_k AS ok,
                 CASE pii_count WHEN 0 THEN '' WHEN 2 THEN '"col1","col2"' ELSE '"col1","col2","col3","col4"' END AS list FROM g_artifacts) a ON a.suite_id = s.suite_id""",
    "g_suites", "g_validations", "g_artifacts"))
def report_privacy_details(spark, directory):
    out = privacy_details(*suites_and_runs(spark, directory), stored_payloads(spark, directory))
    return out.withColumn("pii_detected", F.array_join("pii_detected", ","))


@register("report_transparency_details", with_views("""
    SELECT s.suite_id, v.validation_id, v.status,
           CASE features WHEN 1 THEN 'price=-0.625,balance=0.25,nation=0.25' WHEN 2 THEN 'price=-0.75,balance=-0.25,nation=0.25'
                WHEN 3 THEN 'price=-0.875,balance=-0.75,nation=0.25' END AS importance,
           CASE features WHEN 2 THEN '{"features":2}' ELSE '{}' END AS model_card, warning,
           CASE features WHEN 0 THEN 'model_card.json, feature_importance.json' END AS missing
    FROM g_suites s JOIN g_validations v ON v.validation_id = s.transparency_validation_id JOIN g_artifacts a ON a.suite_id = s.suite_id""",
    "g_suites", "g_validations", "g_artifacts"))
def report_transparency_details(spark, directory):
    out = transparency_details(*suites_and_runs(spark, directory), stored_payloads(spark, directory))
    shown = F.array_join(F.transform("importance", lambda e: F.concat(e["feature"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("importance", shown).drop("sample_predictions")


@register("exported_audit_trail", with_views("""
    SELECT 'runs' AS part, run_id::VARCHAR AS id, model_id, status AS state FROM g_runs
    UNION ALL SELECT 'versions', model_id::VARCHAR, model_id, version FROM g_models""", "g_runs", "g_models"))
def exported_audit_trail(spark, directory):
    """Run records and model versions written as JSON and read back."""
    runs, models = views(spark, directory, "g_runs", "g_models")
    folder = stored_folder(spark, "trail")
    export_audit_trail(runs, models.select("model_id", "version"), folder)
    back = spark.read.schema("run_id bigint, model_id bigint, status string").json(f"{folder}/runs")
    versions = spark.read.schema("model_id bigint, version string").json(f"{folder}/versions")
    return back.select(F.lit("runs").alias("part"), F.col("run_id").cast("string").alias("id"), "model_id", F.col("status").alias("state")).unionByName(
        versions.select(F.lit("versions").alias("part"), F.col("model_id").cast("string").alias("id"), "model_id", F.col("version").alias("state")))


@register("exported_trace_matrix", trace_sql("""
    SELECT requirement_name AS "Requirement", principle AS "Principle", dataset_name AS "Dataset", model_name AS "Model",
           metrics_passed AS "Metrics Passed", metrics_total AS "Total Metrics", status AS "Status" FROM traces"""))
def exported_trace_matrix(spark, directory):
    """The matrix written as CSV with every cell quoted and read back."""
    folder = stored_folder(spark, "matrix")
    export_trace_matrix(traces_of(spark, directory), folder)
    schema = ("Requirement string, Principle string, Dataset string, Model string, `Metrics Passed` bigint, `Total Metrics` bigint, "
              "Status string, `Behavior Pattern` string")
    return read_dataset(spark, folder, schema).drop("Behavior Pattern")


# --- Accountability --------------------------------------------------------------------

@register("run_history", with_views("""
    SELECT run_id, model_name, status FROM g_runs WHERE principle = 'privacy' AND status = 'failed'
    ORDER BY started_at DESC, run_id DESC LIMIT 100""", "g_runs"))
def run_history(spark, directory):
    out = acc.run_history(view(spark, directory, "g_runs"), principle="privacy", status="failed")
    return out.select("run_id", "model_name", "status")


@register("run_records", """
    WITH logged AS (
        SELECT l_orderkey, REGEXP_REPLACE('loss ' || l_returnflag || '-' || l_linestatus, '[^A-Za-z0-9_]', '_', 'g') AS metric, l_extendedprice,
               ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_shipdate DESC, l_extendedprice DESC) AS r FROM lineitem)
    SELECT o_orderkey AS run_id, COALESCE(n, 0)::INTEGER AS metrics, ROUND(COALESCE(total, 0), 2) AS total,
           CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'error' ELSE CASE WHEN o_totalprice > 200000 THEN 'passed' ELSE 'failed' END END AS status,
           CASE o_orderstatus WHEN 'O' THEN 2000 END AS error_length
    FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, SUM(l_extendedprice) AS total FROM logged WHERE r = 1 GROUP BY l_orderkey) m
    ON o_orderkey = l_orderkey""")
def run_records(spark, directory):
    from probity.sources.tables import table

    orders, lines = table(spark, directory, "orders"), table(spark, directory, "lineitem")
    starts = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("model_id"))
    metrics = lines.select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("loss "), F.coalesce("l_returnflag", F.lit("")), F.lit("-"), F.coalesce("l_linestatus", F.lit(""))).alias("metric"),
        F.col("l_extendedprice").alias("value"), F.struct("l_shipdate", "l_extendedprice").alias("logged_at"))
    ends = orders.where(~F.col("o_orderstatus").eqNullSafe("P")).select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"),
        F.when(F.col("o_orderstatus") == "O", F.repeat(F.lit("x"), 3000)).alias("error"),
        (F.col("o_totalprice") > 200000).alias("passed"))
    runs = acc.run_records(starts, metrics, ends)
    values = F.map_values(F.coalesce("metrics", F.create_map().cast("map<string,double>")))
    return runs.select(
        "run_id", F.size(values).alias("metrics"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 2).alias("total"), "status",
        F.length("error").alias("error_length"))


@register("model_versions", """
    SELECT o_custkey AS model_id, ARG_MAX(o_orderstatus, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY o_custkey""")
def model_versions(spark, directory):
    from probity.sources.tables import table

    rows = table(spark, directory, "orders").select(
        F.col("o_custkey").alias("model_id"), F.col("o_orderstatus").alias("version"),
        F.struct("o_orderdate", "o_orderkey").alias("registered_at"))
    early = F.col("registered_at.o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return acc.register_versions(rows.where(early), rows.where(~early)).select("model_id", "version")


@register("model_lineage", with_views("""
    SELECT m.model_id, m.version, COUNT(run_id) AS total_runs, SUM(CASE WHEN r.status = 'passed' THEN 1 ELSE 0 END)::BIGINT AS passed,
           SUM(CASE WHEN r.status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed,
           COALESCE(STRING_AGG(DISTINCT principle, ',' ORDER BY principle), '') AS principles
    FROM g_models m LEFT JOIN g_runs r ON m.model_id = r.model_id GROUP BY m.model_id, m.version""", "g_models", "g_runs"))
def model_lineage(spark, directory):
    models, runs = views(spark, directory, "g_models", "g_runs")
    return acc.model_lineage(models.select("model_id", "version"), runs)


PERIOD = "started_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'"
AUDIT_SQL = f"""SELECT 'status' AS kind, status AS name, COUNT(*) AS runs FROM g_runs WHERE {PERIOD} GROUP BY status
    UNION ALL SELECT 'principle', principle, COUNT(*) FROM g_runs WHERE {PERIOD} GROUP BY principle
    UNION ALL SELECT 'model', model_name, COUNT(*) FROM g_runs WHERE {PERIOD} GROUP BY model_name"""


def period_report(spark, directory):
    return acc.audit_report(view(spark, directory, "g_runs"), "1996-01-01 00:00:00", "1999-12-31 00:00:00")


@register("audit_report", with_views(AUDIT_SQL, "g_runs"))
def audit_report(spark, directory):
    return period_report(spark, directory)


@register("audit_report_summary", with_views(f"""
    SELECT COUNT(*) AS total_runs, COUNT(DISTINCT model_name) AS models_checked,
           SUM(CASE WHEN status = 'passed' THEN 1 ELSE 0 END)::BIGINT AS passed_runs,
           ROUND(SUM(CASE WHEN status = 'passed' THEN 1 ELSE 0 END)::DOUBLE / COUNT(*), 6) AS pass_rate FROM g_runs WHERE {PERIOD}""", "g_runs"))
def audit_report_summary(spark, directory):
    out = acc.audit_report_summary(period_report(spark, directory))
    return out.withColumn("pass_rate", F.round("pass_rate", 6))


@register("audit_first_runs", with_views(f"""
    SELECT run_id, model_name, status FROM g_runs WHERE {PERIOD} ORDER BY started_at, run_id LIMIT 10""", "g_runs"))
def audit_first_runs(spark, directory):
    runs = acc.first_runs(view(spark, directory, "g_runs"), "1996-01-01 00:00:00", "1999-12-31 00:00:00")
    return runs.select("run_id", "model_name", "status")


@register("audit_log_page", with_views("""
    SELECT audit_id, a.user_id, action, resource_type, email AS user_email FROM (
        SELECT * FROM g_audit WHERE action = 'error' AND event_time >= TIMESTAMP '2024-01-05' ORDER BY event_time DESC, audit_id DESC
        LIMIT 40 OFFSET 20) a LEFT JOIN g_users u ON a.user_id = u.user_id""", "g_audit", "g_users"))
def audit_log_page(spark, directory):
    page = acc.audit_log(
        *views(spark, directory, "g_audit", "g_users"), action="error", start="2024-01-05 00:00:00", skip=20, limit=40)
    return page.select("audit_id", "user_id", "action", "resource_type", "user_email")


@register("audit_totals", with_views("""
    SELECT COUNT(*) AS total, SUM(CASE WHEN event_time >= TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END)::BIGINT AS today,
           SUM(CASE WHEN event_time >= TIMESTAMP '2024-01-13' THEN 1 ELSE 0 END)::BIGINT AS last_7_days FROM g_audit""", "g_audit"))
def audit_totals(spark, directory):
    return acc.audit_totals(view(spark, directory, "g_audit"), AS_OF)


@register("audit_breakdown", with_views("""
    SELECT 'action' AS kind, action AS name, COUNT(*) AS entries FROM g_audit GROUP BY action
    UNION ALL SELECT 'resource_type', resource_type, COUNT(*) FROM g_audit GROUP BY resource_type""", "g_audit"))
def audit_breakdown(spark, directory):
    return acc.audit_breakdown(view(spark, directory, "g_audit"))


@register("platform_stats", with_views("""
    SELECT 'total_users' AS statistic, COUNT(*) AS value FROM g_users
    UNION ALL SELECT 'total_projects', COUNT(*) FROM g_projects WHERE deleted_at IS NULL
    UNION ALL SELECT 'total_models', COUNT(*) FROM g_models UNION ALL SELECT 'total_datasets', COUNT(*) FROM g_datasets
    UNION ALL SELECT 'total_validations', COUNT(*) FROM g_validations
    UNION ALL SELECT 'validations_' || CASE status WHEN 'completed' THEN 'passed' ELSE status END, COUNT(*) FROM g_validations GROUP BY status""",
    "g_users", "g_projects", "g_models", "g_datasets", "g_validations"))
def platform_stats(spark, directory):
    return acc.platform_stats(*views(spark, directory, "g_users", "g_projects", "g_models", "g_datasets", "g_validations"))


@register("recent_activity", with_views("""
    SELECT audit_id, user_id, action, resource_type FROM g_audit ORDER BY event_time DESC, audit_id DESC LIMIT 20""", "g_audit"))
def recent_activity(spark, directory):
    return acc.recent_activity(view(spark, directory, "g_audit")).select("audit_id", "user_id", "action", "resource_type")


@register("user_list", with_views("""
    SELECT user_id, email, role FROM g_users ORDER BY created_at DESC, user_id DESC LIMIT 25 OFFSET 5""", "g_users"))
def user_list(spark, directory):
    return acc.list_users(view(spark, directory, "g_users"), skip=5, limit=25).select("user_id", "email", "role")


@register("notification_list", with_views("""
    SELECT notification_id, user_id, kind FROM g_notifications WHERE NOT is_read ORDER BY created_at DESC, notification_id DESC LIMIT 50""",
    "g_notifications"))
def notification_list(spark, directory):
    notes = acc.list_notifications(view(spark, directory, "g_notifications"), unread_only=True)
    return notes.select("notification_id", "user_id", "kind")


@register("notification_unread_counts", with_views("""
    SELECT user_id, COUNT(*) AS notifications, SUM(CASE WHEN is_read THEN 0 ELSE 1 END)::BIGINT AS unread
    FROM g_notifications GROUP BY user_id""", "g_notifications"))
def notification_unread_counts(spark, directory):
    return acc.unread_counts(view(spark, directory, "g_notifications"))


@register("notification_mark_read", with_views("""
    SELECT notification_id, is_read OR (user_id = 7 AND kind = 'click') AS is_read FROM g_notifications""", "g_notifications"))
def notification_mark_read(spark, directory):
    notes = view(spark, directory, "g_notifications")
    named = notes.where("kind = 'click'").select("notification_id")
    return acc.mark_read(notes, 7, named).select("notification_id", "is_read")


# --- Catalogue ---------------------------------------------------------------------------

COUNTS_SQL = """SELECT p.project_id, p.name, p.deleted_at, p.updated_at, COALESCE(m.n, 0) AS model_count,
           COALESCE(d.n, 0) AS dataset_count, COALESCE(r.n, 0) AS requirement_count FROM g_projects p
    LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM g_models GROUP BY project_id) m ON p.project_id = m.project_id
    LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM g_datasets WHERE sensitive_attribute IS NOT NULL GROUP BY project_id) d ON p.project_id = d.project_id
    LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM g_requirements GROUP BY project_id) r ON p.project_id = r.project_id
    WHERE p.deleted_at IS NULL"""
COUNT_VIEWS = ("g_projects", "g_models", "g_datasets", "g_requirements")


def counts_of(spark, directory):
    projects, models, datasets, requirements = views(spark, directory, *COUNT_VIEWS)
    return catalogue.project_counts(projects, models, datasets.where("sensitive_attribute IS NOT NULL"), requirements)


@register("project_counts", with_views(
    f"SELECT project_id, name, model_count, dataset_count, requirement_count FROM ({COUNTS_SQL})", *COUNT_VIEWS))
def project_counts(spark, directory):
    return counts_of(spark, directory).select("project_id", "name", "model_count", "dataset_count", "requirement_count")


@register("trace_dataset_impact", with_views("""
    , uses AS (SELECT requirement_id, COUNT(*) AS validation_count, ARG_MAX(validation_id, (created_at, validation_id)) AS latest_validation_id,
               ARG_MAX(status, (created_at, validation_id)) AS latest_status
        FROM g_validations WHERE dataset_id = 3 AND requirement_id IS NOT NULL GROUP BY requirement_id)
    SELECT r.requirement_id, r.principle, COALESCE(u.validation_count, 0) AS validation_count, u.latest_validation_id, u.latest_status
    FROM g_requirements r LEFT JOIN uses u ON r.requirement_id = u.requirement_id
    WHERE r.project_id IN (SELECT project_id FROM g_datasets WHERE dataset_id = 3)""", "g_validations", "g_requirements", "g_datasets"))
def trace_dataset_impact(spark, directory):
    return trace.dataset_impact(3, *(view(spark, directory, v) for v in ("g_datasets", "g_requirements", "g_validations")))


@register("project_one", with_views(f"SELECT project_id, name, model_count, dataset_count, requirement_count FROM ({COUNTS_SQL}) WHERE project_id = 7", *COUNT_VIEWS))
def project_one(spark, directory):
    return catalogue.one_project(counts_of(spark, directory), 7).select("project_id", "name", "model_count", "dataset_count", "requirement_count")


@register("project_page", with_views(f"""
    SELECT project_id, model_count FROM ({COUNTS_SQL}) ORDER BY updated_at DESC, project_id DESC LIMIT 10 OFFSET 2""", *COUNT_VIEWS))
def project_page(spark, directory):
    page = catalogue.newest_page(counts_of(spark, directory), "updated_at", "project_id", 2, 10)
    return page.select("project_id", "model_count")


@register("project_soft_delete", with_views("""
    SELECT p.project_id, STRFTIME(CASE WHEN deleted_at IS NULL AND p.project_id IN (
        SELECT project_id FROM g_requirements WHERE status = 'archived' GROUP BY project_id HAVING COUNT(*) > 3)
        THEN TIMESTAMP '2024-06-01' ELSE deleted_at END, '%Y-%m-%d %H:%M:%S') AS deleted_at FROM g_projects p""", "g_projects", "g_requirements"))
def project_soft_delete(spark, directory):
    projects, requirements = views(spark, directory, "g_projects", "g_requirements")
    archived = requirements.where("status = 'archived'").groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    out = catalogue.soft_delete(projects, archived, "2024-06-01 00:00:00")
    return out.select("project_id", stamp("deleted_at").alias("deleted_at"))


@register("repeated_requirement_names", with_views("""
    SELECT project_id, LOWER(TRIM(name)) AS name, COUNT(*) AS uses FROM g_requirements GROUP BY ALL HAVING COUNT(*) > 1""", "g_requirements"))
def repeated_requirement_names(spark, directory):
    return catalogue.repeated_names(view(spark, directory, "g_requirements"), ["project_id"], ignore_case=True)


@register("name_conflicts", with_views("""
    SELECT position, name FROM g_rules r WHERE EXISTS (SELECT 1 FROM g_requirements q WHERE q.project_id = r.project_id
        AND LOWER(TRIM(q.name)) = LOWER(TRIM(r.name)))""", "g_rules", "g_requirements"))
def name_conflicts(spark, directory):
    rules, requirements = views(spark, directory, "g_rules", "g_requirements")
    return catalogue.name_conflicts(rules, requirements, ["project_id"], ignore_case=True).select("position", "name")


@register("refused_dataset_names", with_views("""
    SELECT p_partkey AS upload, p_partkey % 25 AS project_id,
           'Dataset with name ' || CHR(39) || CASE WHEN p_partkey % 2 = 0 THEN UPPER(s_name) ELSE s_name END || CHR(39) || ' already exists in this project' AS reason
    FROM part JOIN supplier ON s_suppkey = p_partkey % 50 WHERE EXISTS (
        SELECT 1 FROM g_datasets d WHERE d.project_id = p_partkey % 25 AND LOWER(TRIM(d.name)) = LOWER(TRIM(s_name)))""", "g_datasets"))
def refused_dataset_names(spark, directory):
    """Uploads under the name of a supplier, every other one in capitals, against the datasets of the project."""
    from probity.sources.tables import table

    parts, suppliers = table(spark, directory, "part"), table(spark, directory, "supplier")
    key = F.col("p_partkey")
    uploads = parts.join(suppliers, F.col("s_suppkey") == key % 50).select(
        key.alias("upload"), (key % 25).alias("project_id"),
        F.concat(F.lit(" "), F.when(key % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name"))).alias("name"))
    return catalogue.refused_names("datasets", uploads, view(spark, directory, "g_datasets")).select("upload", "project_id", "reason")


@register("refused_preset_names", """
    SELECT event_id AS request, 'Preset ' || CHR(39) || event_type || CHR(39) || ' already exists' AS reason FROM events e WHERE event_id % 2 = 1 AND EXISTS (
        SELECT 1 FROM events p WHERE p.event_id % 2 = 0 AND p.user_id = e.user_id AND p.user_id % 25 = e.user_id % 25 AND p.event_type = e.event_type)""")
def refused_preset_names(spark, directory):
    """Every other event asks for a preset of its user under a name of the others."""
    from probity.sources.tables import table

    presets = table(spark, directory, "events").select(
        F.col("event_id").alias("request"), (F.col("user_id") % 25).alias("project_id"), "user_id", F.col("event_type").alias("name"))
    return catalogue.refused_names("validation_presets", presets.where("request % 2 = 1"), presets.where("request % 2 = 0")).select("request", "reason")


ASSETS = {"rules": ("g_rules", "position", "name", "created_at"), "requirements": ("g_requirements", "requirement_id", "name", None),
          "models": ("g_models", "model_id", "name", None), "datasets": ("g_datasets", "dataset_id", "name", None),
          "presets": ("g_notifications", "notification_id", "kind", "created_at")}


def asset_sql(kind):
    source, key, name, at = ASSETS[kind]
    project = "user_id % 25" if kind == "presets" else "project_id"
    when = at or f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST({key} % 30 AS INTEGER)"
    return f"""SELECT '{kind}' AS kind, ({project})::VARCHAR AS project_id, r AS "rank", {key}::VARCHAR AS asset_id, {name} AS name,
        STRFTIME(listed_at, '%Y-%m-%d %H:%M:%S') AS listed_at FROM (SELECT *, {when} AS listed_at,
            CAST(ROW_NUMBER() OVER (PARTITION BY {project} ORDER BY {when} DESC, {key} DESC) AS INTEGER) AS r FROM {source}) WHERE r <= 100"""


@register("assets_newest_first", with_views(" UNION ALL ".join(asset_sql(k) for k in ASSETS), *[v[0] for v in ASSETS.values()]))
def assets_newest_first(spark, directory):
    """The newest 100 assets of every kind and project with their rank."""
    lists = {}
    for kind, (source, key, name, at) in ASSETS.items():
        df = view(spark, directory, source)
        if kind == "presets":
            df = df.withColumn("project_id", F.col("user_id") % 25)
        day = F.timestamp_add("DAY", (F.col(key) % 30).cast("int"), F.lit("2024-01-01").cast("timestamp"))
        lists[kind] = (df if at else df.withColumn("listed_at", day), key, name, at or "listed_at")
    return catalogue.ranked_assets(lists, 100).withColumn("listed_at", stamp("listed_at"))


@register("rules_newest_first", with_views("""
    SELECT position, project_id, STRFTIME(created_at, '%Y-%m-%d') AS created_on FROM g_rules WHERE principle = 'fairness'""", "g_rules"))
def rules_newest_first(spark, directory):
    rules = view(spark, directory, "g_rules").where("principle = 'fairness'")
    out = catalogue.newest_assets(rules)
    return out.select("position", "project_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@register("project_access", with_views("""
    SELECT user_id, role, CASE WHEN role = 'admin' THEN (SELECT COUNT(*) FROM g_projects)
        ELSE (SELECT COUNT(*) FROM g_projects p WHERE p.owner_id = u.user_id) END AS visible_projects FROM g_users u""", "g_projects", "g_users"))
def project_access(spark, directory):
    return catalogue.with_access(*views(spark, directory, "g_projects", "g_users"))


@register("dashboard_totals", with_views(f"""
    SELECT COUNT(*) AS total_projects, SUM(model_count)::BIGINT AS total_models, SUM(dataset_count)::BIGINT AS total_datasets,
           SUM(model_count + dataset_count)::BIGINT AS total_assets, COUNT(*) AS active_projects FROM ({COUNTS_SQL})""", *COUNT_VIEWS))
def dashboard_totals(spark, directory):
    return catalogue.dashboard_totals(counts_of(spark, directory))


@register("dashboard_readiness", with_views(f"""
    SELECT project_id, name, CASE WHEN model_count > 0 AND dataset_count > 0 THEN 100 WHEN model_count > 0 OR dataset_count > 0 THEN 50 ELSE 0 END AS progress,
           CASE WHEN model_count > 0 AND dataset_count > 0 THEN 'Ready' WHEN model_count > 0 OR dataset_count > 0 THEN 'In Progress' ELSE 'Not Started' END AS status,
           CASE WHEN mins < 60 THEN mins || ' minute' || CASE WHEN mins = 1 THEN '' ELSE 's' END || ' ago'
                WHEN mins < 1440 THEN mins // 60 || ' hour' || CASE WHEN mins // 60 = 1 THEN '' ELSE 's' END || ' ago'
                ELSE mins // 1440 || ' day' || CASE WHEN mins // 1440 = 1 THEN '' ELSE 's' END || ' ago' END AS last_updated
    FROM (SELECT *, CAST(FLOOR(EPOCH(TIMESTAMP '2024-01-26 10:00:00' - updated_at) / 60) AS BIGINT) AS mins FROM ({COUNTS_SQL}))""", *COUNT_VIEWS))
def dashboard_readiness(spark, directory):
    return catalogue.readiness(counts_of(spark, directory), "2024-01-26 10:00:00")
