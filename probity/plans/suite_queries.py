"""Registered queries of the whole audit."""

from pyspark.sql import functions as F

from probity.plans.fairness_queries import REPORT_SQL, GROUPS_SQL
from probity.plans.model_queries import FEATURES, SCORED_SQL, probability, scored_loans
from probity.plans.registry import register
from probity.plans.suite import SuiteConfig, audit_suite
from probity.sources.tables import view, with_views

QIS = ["segment", "priority", "nation"]

SUITE_SQL = with_views("", "loans") + SCORED_SQL + """,
    judged AS (SELECT segment AS sensitive, y_true, prediction AS y_pred FROM scored), """ + GROUPS_SQL.replace(
        "{source}", "judged") + ", " + REPORT_SQL + f""",
    sizes AS (SELECT COUNT(*) AS n FROM loans GROUP BY {', '.join(QIS)}),
    suite AS (
        SELECT 'fairness' AS principle, metric_name, ROUND(value, 6) AS metric_value, passed FROM report
        UNION ALL SELECT 'fairness', 'group_confusion_matrices', NULL, TRUE
        UNION ALL SELECT 'privacy', 'k_anonymity', MIN(n)::DOUBLE, MIN(n) >= 5 FROM sizes
        UNION ALL SELECT 'accountability', 'audit_trail_exists', there::INT::DOUBLE, there FROM recorded)"""


def suite_sql(number, body):
    """The suite's rows, accountability read from the run records of that suite."""
    runs = with_views("", "g_runs")[len("WITH "):]
    recorded = f"recorded AS (SELECT COUNT(*) > 0 AS there FROM g_runs WHERE requirement_id = {number} AND status IN ('passed', 'failed'))"
    return SUITE_SQL.replace("WITH ", f"WITH {runs}, {recorded}, ", 1) + body


def suite_of(spark, directory, validators, number=1):
    runs = view(spark, directory, "g_runs").withColumn("suite_id", F.format_string("suite-%d", "requirement_id"))
    config = SuiteConfig(
        suite_id=f"suite-{number}", id_column="row_id", y_pred="prediction", sensitive="segment", y_true="y_true", features=FEATURES,
        scorer=probability, validators=validators, runs=runs,
        privacy={"pii_detection": False, "k_anonymity": {"k": 5, "quasi_identifiers": QIS}})
    return audit_suite(scored_loans(spark, directory), config)


@register("audit_suite_rows", suite_sql(1, " SELECT * FROM suite"))
def audit_suite_rows(spark, directory):
    rows = suite_of(spark, directory, ("fairness", "privacy", "accountability"))["rows"]
    return rows.select("principle", "metric_name", F.round("metric_value", 6).alias("metric_value"), "passed")


#: No order's key leads to this requirement, so no run of this suite is on record.
UNRECORDED = 1_000_000


@register("audit_suite_unrecorded", suite_sql(UNRECORDED, " SELECT * FROM suite"))
def audit_suite_unrecorded(spark, directory):
    rows = suite_of(spark, directory, ("fairness", "privacy", "accountability"), UNRECORDED)["rows"]
    return rows.select("principle", "metric_name", F.round("metric_value", 6).alias("metric_value"), "passed")


@register("audit_suite_verdict", suite_sql(1, """
    SELECT 'suite-1' AS suite_id, BOOL_AND(passed) AS overall_passed FROM suite WHERE principle IN ('fairness', 'privacy')"""))
def audit_suite_verdict(spark, directory):
    return suite_of(spark, directory, ("fairness", "transparency", "privacy", "accountability"))["verdict"]
