"""Registered fairness queries."""

from pyspark.sql import functions as F

from probity.operators import fairness as fair
from probity.plans.registry import register
from probity.sources.tables import view, with_views

GROUPS_SQL = """
    counts AS (
        SELECT sensitive AS grp, COUNT(*) AS n,
               SUM(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
               SUM(CASE WHEN y_true <> 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
               SUM(CASE WHEN y_true = 1 AND y_pred <> 1 THEN 1 ELSE 0 END) AS fn,
               SUM(CASE WHEN y_true <> 1 AND y_pred <> 1 THEN 1 ELSE 0 END) AS tn
        FROM {source} WHERE sensitive IS NOT NULL AND y_true IS NOT NULL AND y_pred IS NOT NULL
        GROUP BY sensitive),
    groups AS (
        SELECT grp, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
               CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
               CAST(tp + fp AS DOUBLE) / n AS selection_rate,
               CAST(tp + tn AS DOUBLE) / n AS accuracy,
               COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS tpr,
               COALESCE(CAST(fp AS DOUBLE) / NULLIF(fp + tn, 0), 0) AS fpr,
               COALESCE(CAST(tn AS DOUBLE) / NULLIF(fp + tn, 0), 0) AS tnr,
               COALESCE(CAST(fn AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS fnr,
               COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS prec,
               COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0) AS f1
        FROM counts)"""

REPORT_SQL = """
    extremes AS (
        SELECT MIN(selection_rate) AS s0, MAX(selection_rate) AS s1, MIN(tpr) AS t0, MAX(tpr) AS t1,
               MIN(fpr) AS f0, MAX(fpr) AS f1 FROM groups),
    metrics AS (
        SELECT 0 AS position, 'demographic_parity_ratio' AS metric_name, s0 / NULLIF(s1, 0) AS value, 0.8 AS threshold, '>=' AS comparison FROM extremes
        UNION ALL SELECT 1, 'demographic_parity_difference', s1 - s0, 0.1, '<=' FROM extremes
        UNION ALL SELECT 2, 'equalized_odds_ratio',
            CASE WHEN t1 = 0 THEN NULL WHEN f1 = 0 THEN t0 / t1 ELSE LEAST(t0 / t1, f0 / f1) END, 0.8, '>=' FROM extremes
        UNION ALL SELECT 3, 'equalized_odds_difference', GREATEST(t1 - t0, f1 - f0), 0.1, '<=' FROM extremes
        UNION ALL SELECT 4, 'equal_opportunity_difference', t1 - t0, 0.05, '<=' FROM extremes
        UNION ALL SELECT 5, 'disparate_impact_ratio', CASE WHEN s1 > 0 THEN s0 / s1 ELSE 1.0 END, 0.8, '>=' FROM extremes),
    report AS (
        SELECT position, metric_name, CAST(value AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold, comparison,
               COALESCE(CASE WHEN comparison = '>=' THEN value >= threshold ELSE value <= threshold END, FALSE) AS passed
        FROM metrics)"""

RULES_SQL = """
    extremes9 AS (
        SELECT base_metric, MIN(v) AS low, MAX(v) AS high FROM (
            SELECT 'accuracy_score' AS base_metric, accuracy AS v FROM groups
            UNION ALL SELECT 'precision_score', prec FROM groups
            UNION ALL SELECT 'recall_score', tpr FROM groups
            UNION ALL SELECT 'f1_score', f1 FROM groups
            UNION ALL SELECT 'selection_rate', selection_rate FROM groups
            UNION ALL SELECT 'true_positive_rate', tpr FROM groups
            UNION ALL SELECT 'false_positive_rate', fpr FROM groups
            UNION ALL SELECT 'true_negative_rate', tnr FROM groups
            UNION ALL SELECT 'false_negative_rate', fnr FROM groups) GROUP BY base_metric),
    checked AS (
        SELECT position, TRIM(name) AS name, base_metric, aggregation, COALESCE(comparison, '>=') AS comparison,
               default_threshold,
               CASE WHEN TRIM(name) = '' THEN 'name'
                    WHEN base_metric = 'gini' THEN 'base_metric'
                    WHEN aggregation NOT IN ('min_ratio', 'max_difference') THEN 'aggregation'
                    WHEN COALESCE(comparison, '>=') NOT IN ('>=', '<=') THEN 'comparison'
                    WHEN ISNAN(default_threshold) THEN 'threshold' END AS fault
        FROM g_rules),
    valued AS (
        SELECT c.*, CASE WHEN fault IS NOT NULL THEN 0.0
                    WHEN aggregation = 'min_ratio' THEN CASE WHEN high > 0 THEN low / high ELSE 1.0 END
                    ELSE high - low END AS value
        FROM checked c LEFT JOIN extremes9 e ON c.base_metric = e.base_metric)"""


def sql_over(source, body, *parts, views=("predictions",)):
    text = with_views("", *views)
    steps = ", ".join(p.replace("{source}", source) for p in (GROUPS_SQL, *parts))
    return f"{text}, {steps} {body}"


def groups_of(spark, directory):
    return fair.group_metrics(view(spark, directory, "predictions"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


RATES = ("selection_rate", "accuracy", "tpr", "fpr", "tnr", "fnr", "precision")


@register("fairness_report", sql_over(
    "predictions",
    "SELECT position, metric_name, ROUND(value, 6) AS value, threshold, comparison, passed FROM report",
    REPORT_SQL))
def fairness_report(spark, directory):
    report, _ = fair.fairness_from_predictions(
        view(spark, directory, "predictions"), "y_pred", "sensitive", "y_true")
    return rounded(report.drop("description"), "value")


@register("fairness_report_documents", sql_over(
    "doc_predictions",
    "SELECT metric_name, ROUND(value, 6) AS value, threshold, passed FROM report WHERE position IN (0, 2, 5)",
    REPORT_SQL, views=("doc_predictions",)))
def fairness_report_documents(spark, directory):
    groups = fair.group_metrics(view(spark, directory, "doc_predictions"))
    chosen = ["disparate_impact_ratio", "unknown", "equalized_odds_ratio", "demographic_parity_ratio"]
    report = fair.fairness_report(groups, selected=chosen)
    return rounded(report.select("metric_name", "value", "threshold", "passed"), "value")


@register("fairness_prediction_only", sql_over(
    "same",
    "SELECT metric_name, ROUND(value, 6) AS value, passed FROM report",
    REPORT_SQL, views=("predictions",)).replace(
        "counts AS (", "same AS (SELECT sensitive, y_pred AS y_true, y_pred FROM predictions), counts AS (", 1))
def fairness_prediction_only(spark, directory):
    report, _ = fair.fairness_from_predictions(
        view(spark, directory, "predictions"), "y_pred", "sensitive", "no_such_target")
    return rounded(report.select("metric_name", "value", "passed"), "value")


@register("fairness_group_metrics", sql_over(
    "predictions",
    """SELECT grp AS "group", n, tp, fp, fn, tn, ROUND(selection_rate, 6) AS selection_rate,
       ROUND(accuracy, 6) AS accuracy, ROUND(tpr, 6) AS tpr, ROUND(fpr, 6) AS fpr, ROUND(tnr, 6) AS tnr,
       ROUND(fnr, 6) AS fnr, ROUND(prec, 6) AS "precision" FROM groups"""))
def fairness_group_metrics(spark, directory):
    return rounded(groups_of(spark, directory), *RATES)


@register("fairness_confusion_matrices", sql_over(
    "by_nation",
    """SELECT grp AS "group", tn, fp, fn, tp, ROUND(accuracy, 6) AS accuracy, ROUND(tpr, 6) AS tpr,
       ROUND(fpr, 6) AS fpr, ROUND(tnr, 6) AS tnr, ROUND(fnr, 6) AS fnr, ROUND(prec, 6) AS "precision" FROM groups"""
    ).replace("counts AS (", """by_nation AS (SELECT CAST(nation AS VARCHAR) AS sensitive, y_true, y_pred
        FROM predictions), counts AS (""", 1))
def fairness_confusion_matrices(spark, directory):
    groups = fair.group_metrics(view(spark, directory, "predictions"), sensitive="nation")
    return rounded(fair.confusion_matrices(groups), *RATES[1:])


@register("fairness_excluded_rows", with_views(
    """SELECT COUNT(*) AS rows_total, SUM(CASE WHEN sensitive = 'BUILDING' THEN 1 ELSE 0 END)::BIGINT AS rows_excluded
       FROM predictions""", "predictions"))
def fairness_excluded_rows(spark, directory):
    df = view(spark, directory, "predictions")
    df = df.withColumn("sensitive", F.nullif("sensitive", F.lit("BUILDING")))
    return fair.excluded_rows(df)


@register("fairness_custom_rules", sql_over(
    "predictions",
    """SELECT position, CASE WHEN name = '' THEN 'unknown_custom_rule' ELSE name END AS metric_name,
              ROUND(value, 6) AS value, default_threshold AS threshold, comparison,
              fault IS NULL AND CASE WHEN comparison = '>=' THEN value >= default_threshold
                                     ELSE value <= default_threshold END AS passed
       FROM valued""",
    RULES_SQL, views=("predictions", "g_rules")))
def fairness_custom_rules(spark, directory):
    rules = view(spark, directory, "g_rules")
    report = fair.fairness_report(groups_of(spark, directory), selected=["none"], rules=rules)
    return rounded(report.drop("description"), "value")


@register("fairness_rule_checks", sql_over(
    "predictions",
    "SELECT COALESCE(fault, 'valid') AS outcome, COUNT(*) AS rules FROM checked GROUP BY fault",
    RULES_SQL, views=("predictions", "g_rules")))
def fairness_rule_checks(spark, directory):
    checked = fair.check_rules(view(spark, directory, "g_rules"))
    words = ("base_metric", "aggregation", "comparison", "name", "threshold")
    outcome = F.coalesce(*[F.when(F.col("error").contains(w), w) for w in words], F.lit("valid"))
    return checked.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("rules"))


@register("fairness_rules_in_effect", with_views("""
    SELECT CAST(ROW_NUMBER() OVER (
           ORDER BY created_at DESC, name, base_metric, aggregation, comparison NULLS FIRST, default_threshold) - 1 AS INTEGER) AS position, name, base_metric, aggregation, comparison, default_threshold
    FROM g_rules WHERE project_id = 4 AND principle = 'fairness'""", "g_rules"))
def fairness_rules_in_effect(spark, directory):
    return fair.rules_in_effect(view(spark, directory, "g_rules"), 4)


@register("fairness_duplicate_rules", with_views(
    """SELECT project_id, principle, TRIM(name) AS name, COUNT(*) AS uses FROM g_rules
       GROUP BY project_id, principle, TRIM(name) HAVING COUNT(*) > 1""", "g_rules"))
def fairness_duplicate_rules(spark, directory):
    return fair.duplicate_rules(view(spark, directory, "g_rules"))


@register("fairness_verdict", sql_over(
    "predictions",
    """SELECT COUNT(*) AS metrics, SUM(CASE WHEN passed THEN 1 ELSE 0 END)::BIGINT AS metrics_passed,
              BOOL_AND(passed) AS overall_passed FROM report""",
    REPORT_SQL))
def fairness_verdict(spark, directory):
    return fair.overall_verdict(fair.fairness_report(groups_of(spark, directory)))


@register("fairness_summary", sql_over(
    "predictions",
    """SELECT ROUND(MAX(CASE WHEN position = 0 THEN value END), 6) AS demographic_parity_ratio,
              ROUND(MAX(CASE WHEN position = 2 THEN value END), 6) AS equalized_odds_ratio,
              ROUND(MAX(CASE WHEN position = 5 THEN value END), 6) AS disparate_impact_ratio,
              BOOL_AND(passed) AS overall_fair
       FROM report WHERE position IN (0, 2, 5)""",
    REPORT_SQL))
def fairness_summary(spark, directory):
    summary = fair.fairness_summary(groups_of(spark, directory))
    return rounded(summary, "demographic_parity_ratio", "equalized_odds_ratio", "disparate_impact_ratio")


@register("fairness_by_group", sql_over(
    "predictions",
    """SELECT m.metric_name, m.part, grp AS "group", ROUND(CASE m.part WHEN 'tpr' THEN tpr WHEN 'fpr' THEN fpr
              ELSE selection_rate END, 6) AS value
       FROM groups CROSS JOIN (VALUES
           ('demographic_parity_ratio', 'selection_rate'), ('demographic_parity_difference', 'selection_rate'),
           ('equalized_odds_ratio', 'tpr'), ('equalized_odds_ratio', 'fpr'),
           ('equalized_odds_difference', 'tpr'), ('equalized_odds_difference', 'fpr'),
           ('equal_opportunity_difference', 'tpr'), ('disparate_impact_ratio', 'selection_rate')
       ) AS m(metric_name, part)"""))
def fairness_by_group(spark, directory):
    return rounded(fair.by_group(groups_of(spark, directory)), "value")


@register("fairness_result_rows", sql_over(
    "predictions",
    """SELECT 'run-1' AS validation_id, 'fairness' AS principle, metric_name, ROUND(value, 6) AS metric_value,
              threshold, passed, CAST(NULL AS INTEGER) AS detail_groups FROM report
       UNION ALL SELECT 'run-1', 'fairness', 'group_confusion_matrices', NULL, NULL, TRUE,
              (SELECT COUNT(*)::INTEGER FROM groups)""",
    REPORT_SQL))
def fairness_result_rows(spark, directory):
    groups = groups_of(spark, directory)
    rows = fair.result_rows("run-1", fair.fairness_report(groups), groups)
    return rounded(rows.withColumn("detail_groups", F.get_json_object("details", "$.groups").cast("int")).drop("details"), "metric_value")


@register("fairness_group_value_rows", """
    WITH groups AS (
        SELECT CAST(o_custkey AS VARCHAR) AS grp, COUNT(*) FILTER (WHERE y AND p) AS tp, COUNT(*) FILTER (WHERE NOT y AND p) AS fp,
               COUNT(*) FILTER (WHERE y AND NOT p) AS fn, COUNT(*) FILTER (WHERE NOT y AND NOT p) AS tn, COUNT(*) AS n
        FROM (SELECT o_custkey, o_orderstatus = 'F' AS y, o_totalprice > 250000 AS p FROM orders) GROUP BY o_custkey),
    rates AS (
        SELECT *, (tp + fp) / n AS selection_rate, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS tpr,
               CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr FROM groups),
    named AS (
        SELECT * FROM (VALUES ('demographic_parity_ratio', 'selection_rate'), ('demographic_parity_difference', 'selection_rate'),
            ('equalized_odds_ratio', 'tpr'), ('equalized_odds_ratio', 'fpr'), ('equalized_odds_difference', 'tpr'), ('equalized_odds_difference', 'fpr'),
            ('equal_opportunity_difference', 'tpr'), ('disparate_impact_ratio', 'selection_rate'), ('group_confusion_matrices', 'tn'),
            ('group_confusion_matrices', 'fp'), ('group_confusion_matrices', 'fn'), ('group_confusion_matrices', 'tp')) t(metric_name, part))
    SELECT 'run-1' AS validation_id, metric_name, part, grp AS "group", ROUND(CAST(CASE part WHEN 'selection_rate' THEN selection_rate
           WHEN 'tpr' THEN tpr WHEN 'fpr' THEN fpr WHEN 'tn' THEN tn WHEN 'fp' THEN fp WHEN 'fn' THEN fn ELSE tp END AS DOUBLE), 6) AS value
    FROM rates, named""")
def fairness_group_value_rows(spark, directory):
    """Every customer is a group: more than a thousand of them."""
    orders = spark.read.parquet(f"{directory}/orders.parquet").select(
        F.col("o_custkey").alias("sensitive"), (F.col("o_orderstatus") == "F").cast("int").alias("y_true"), (F.col("o_totalprice") > 250000).cast("int").alias("y_pred"))
    return rounded(fair.group_value_rows("run-1", fair.group_metrics(orders)), "value")


@register("fairness_summary_groups", sql_over(
    "predictions", """SELECT grp AS "group", n AS sample_size, ROUND(selection_rate, 6) AS selection_rate FROM groups"""))
def fairness_summary_groups(spark, directory):
    return rounded(fair.summary_groups(groups_of(spark, directory)), "selection_rate")


@register("fairness_rule_group_values", sql_over(
    "predictions",
    """, each AS (
        SELECT grp, 'accuracy_score' AS base_metric, accuracy AS v FROM groups UNION ALL SELECT grp, 'precision_score', prec FROM groups
        UNION ALL SELECT grp, 'recall_score', tpr FROM groups UNION ALL SELECT grp, 'f1_score', f1 FROM groups
        UNION ALL SELECT grp, 'selection_rate', selection_rate FROM groups UNION ALL SELECT grp, 'true_positive_rate', tpr FROM groups
        UNION ALL SELECT grp, 'false_positive_rate', fpr FROM groups UNION ALL SELECT grp, 'true_negative_rate', tnr FROM groups
        UNION ALL SELECT grp, 'false_negative_rate', fnr FROM groups)
       SELECT 'run-1' AS validation_id, name AS metric_name, c.base_metric AS part, grp AS "group", ROUND(v, 6) AS value
       FROM checked c JOIN each e ON c.base_metric = e.base_metric WHERE fault IS NULL""",
    RULES_SQL, views=("predictions", "g_rules")))
def fairness_rule_group_values(spark, directory):
    groups, rules = groups_of(spark, directory), view(spark, directory, "g_rules")
    built_in = fair.by_group(groups).select("metric_name").distinct()  # seven names
    rows = fair.group_value_rows("run-1", groups, rules).where("metric_name <> 'group_confusion_matrices'")
    return rounded(rows.join(F.broadcast(built_in), "metric_name", "left_anti").select(*rows.columns), "value")


@register("fairness_chart_series", sql_over(
    "predictions",
    """SELECT 'selection_rate' AS chart, 'selection_rate' AS series, grp AS label, ROUND(selection_rate, 6) AS value FROM groups
       UNION ALL SELECT 'tpr_fpr', 'tpr', grp, ROUND(tpr, 6) FROM groups
       UNION ALL SELECT 'tpr_fpr', 'fpr', grp, ROUND(fpr, 6) FROM groups
       UNION ALL SELECT 'confusion', 'tn', grp, CAST(tn AS DOUBLE) FROM groups
       UNION ALL SELECT 'confusion', 'fp', grp, CAST(fp AS DOUBLE) FROM groups
       UNION ALL SELECT 'confusion', 'fn', grp, CAST(fn AS DOUBLE) FROM groups
       UNION ALL SELECT 'confusion', 'tp', grp, CAST(tp AS DOUBLE) FROM groups
       UNION ALL SELECT 'selection_rate', 'parity_line', 'all', ROUND(MIN(selection_rate) / 0.8, 6) FROM groups
       UNION ALL SELECT 'radar', 'metric', metric_name, ROUND(LEAST(GREATEST(value, 0), 1), 6) FROM report""",
    REPORT_SQL))
def fairness_chart_series(spark, directory):
    groups = groups_of(spark, directory)
    return rounded(fair.chart_series(groups, fair.fairness_report(groups)), "value")
