"""The given tables and the audit views derived from them."""

from pyspark.sql import DataFrame

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Every view is plain SQL over the given tables, in braces, so that Spark and an
# ANSI engine read the same rows. Projects are nations, models customers,
# datasets suppliers, requirements parts; an order is a suite of three
# validations and a line item one result of the validation it belongs to. The
# one place where the dialects differ, a row repeated three times, is filled in.
VIEWS = {
    "predictions": """
        SELECT o.o_orderkey AS row_id, c.c_mktsegment AS sensitive, c.c_nationkey AS nation,
               o.o_orderpriority AS priority,
               CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true,
               CASE WHEN o.o_totalprice > 200000 + 15000 * c.c_nationkey THEN 1 ELSE 0 END AS y_pred
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "doc_predictions": """
        SELECT l.doc_id AS row_id, d.lang AS sensitive, l.quality AS y_true,
               CASE WHEN d.n_chars >= 200 THEN 1 ELSE 0 END AS y_pred
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "loans": """
        SELECT o.o_orderkey AS row_id, c.c_mktsegment AS segment, o.o_orderpriority AS priority,
               o.o_totalprice / 100000 AS price, c.c_acctbal / 1000 AS balance,
               CAST(c.c_nationkey AS DOUBLE) AS nation,
               CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "g_projects": """
        SELECT n_nationkey AS project_id, n_regionkey AS owner_id, n_name AS name,
               CASE WHEN n_nationkey % 5 = 4 THEN TIMESTAMP '2024-01-15 00:00:00' END AS deleted_at,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * n_nationkey AS updated_at
        FROM {nation}""",
    "g_users": """
        SELECT user_id, CONCAT('user', CAST(user_id AS VARCHAR(20)), '@example.com') AS email,
               CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user' END AS role, MIN(ts) AS created_at
        FROM {events} WHERE event_type <> 'error' GROUP BY user_id""",
    "g_models": """
        SELECT c_custkey AS model_id, c_custkey % 25 AS project_id, c_name AS name,
               c_mktsegment AS model_type, CAST(c_nationkey AS VARCHAR(10)) AS version
        FROM {customer}""",
    "g_datasets": """
        SELECT s_suppkey AS dataset_id, CAST(s_nationkey AS BIGINT) AS project_id, s_name AS name,
               CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE s_name END AS sensitive_attribute
        FROM {supplier}""",
    "g_requirements": """
        SELECT p_partkey AS requirement_id, p_partkey % 25 AS project_id, p_name AS name,
               CASE p_size % 4 WHEN 0 THEN 'fairness' WHEN 1 THEN 'transparency'
                               WHEN 2 THEN 'privacy' ELSE 'accountability' END AS principle,
               CASE WHEN p_brand = 'Brand#1' THEN 'archived' ELSE 'active' END AS status,
               CASE p_partkey % 7
                    WHEN 0 THEN 'demographic_parity_ratio' WHEN 1 THEN 'equalized_odds_ratio'
                    WHEN 2 THEN 'k_anonymity_k' WHEN 3 THEN 'l_diversity_l'
                    WHEN 4 THEN 'shap_explanation_coverage' WHEN 5 THEN 'audit_trail_exists'
                    ELSE 'accuracy' END AS metric,
               CASE p_size % 6 WHEN 0 THEN '>=' WHEN 1 THEN '<=' WHEN 2 THEN '>'
                               WHEN 3 THEN '<' WHEN 4 THEN '==' ELSE '!=' END AS operator,
               CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_retailprice / 1000 END AS rule_value
        FROM {part}""",
    "g_rules": """
        SELECT CAST(p_partkey AS INTEGER) AS position, p_partkey % 25 AS project_id,
               CASE WHEN p_size % 5 = 0 THEN 'privacy' ELSE 'fairness' END AS principle,
               CASE WHEN p_size = 7 THEN '  ' ELSE CONCAT(p_name, ' ') END AS name,
               CASE p_size % 10 WHEN 0 THEN 'accuracy_score' WHEN 1 THEN 'precision_score'
                    WHEN 2 THEN 'recall_score' WHEN 3 THEN 'f1_score' WHEN 4 THEN 'selection_rate'
                    WHEN 5 THEN 'true_positive_rate' WHEN 6 THEN 'false_positive_rate'
                    WHEN 7 THEN 'true_negative_rate' WHEN 8 THEN 'false_negative_rate'
                    ELSE 'gini' END AS base_metric,
               CASE p_type WHEN 'ECONOMY' THEN 'min_ratio' WHEN 'STANDARD' THEN 'max_difference'
                    WHEN 'PROMO' THEN 'mean' ELSE 'min_ratio' END AS aggregation,
               CASE p_brand WHEN 'Brand#1' THEN '==' WHEN 'Brand#2' THEN '<=' WHEN 'Brand#3' THEN NULL
                    ELSE '>=' END AS comparison,
               CASE WHEN p_size = 11 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice / 1000 END AS default_threshold,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * p_size AS created_at
        FROM {part}""",
    "g_validations": """
        SELECT 3 * o.o_orderkey + k.kind AS validation_id,
               CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
                    ELSE o.o_custkey % 25 + 25 * (o.o_orderkey % 80) END AS requirement_id,
               o.o_custkey AS model_id, o.o_custkey % 100 AS dataset_id,
               CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
               o.o_orderdate AS created_at
        FROM {orders} o {three_kinds}""",
    "g_suites": """
        SELECT o_orderkey AS suite_id, o_custkey AS model_id, o_custkey % 100 AS dataset_id,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 3 * o_orderkey END AS fairness_validation_id,
               3 * o_orderkey + 1 AS transparency_validation_id,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 3 * o_orderkey + 2 END AS privacy_validation_id,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
               CASE WHEN o_orderstatus = 'O' THEN NULL
                    WHEN o_orderpriority < '4' THEN TRUE ELSE FALSE END AS overall_passed,
               o_orderdate AS started_at
        FROM {orders}""",
    "g_results": """
        SELECT 3 * l_orderkey + l_linenumber % 3 AS validation_id,
               CAST(ROUND(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS result_no,
               CASE l_linenumber % 3 WHEN 0 THEN 'fairness' WHEN 1 THEN 'transparency' ELSE 'privacy' END AS principle,
               CASE WHEN l_linenumber = 1 THEN 'shap_explanation_coverage'
                    WHEN l_linenumber = 4 THEN 'model_card_generated'
                    WHEN l_linenumber = 7 THEN 'local_explanations'
                    WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN 'pii_count'
                    WHEN l_linenumber = 2 AND l_returnflag = 'N' THEN 'k_anonymity'
                    WHEN l_linenumber = 2 THEN 'l_diversity'
                    WHEN l_linenumber = 5 THEN 'dp_epsilon'
                    WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN 'demographic_parity_ratio'
                    WHEN l_linenumber = 3 AND l_returnflag = 'N' THEN 'disparate_impact_ratio'
                    WHEN l_linenumber = 3 THEN 'equal_opportunity_difference'
                    WHEN l_returnflag = 'A' THEN 'equalized_odds_ratio'
                    WHEN l_returnflag = 'N' THEN 'equalized_odds_difference'
                    ELSE 'accuracy_gap' END AS metric_name,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE ROUND(l_discount * 10, 2) END AS metric_value,
               0.2E0 AS threshold,
               CASE WHEN l_discount >= 0.02 THEN TRUE ELSE FALSE END AS passed
        FROM {lineitem}""",
    "g_artifacts": """
        SELECT o_orderkey AS suite_id, 3 * o_orderkey + 2 AS privacy_run, 3 * o_orderkey + 1 AS transparency_run,
               CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 4 ELSE 0 END AS pii_count,
               CASE WHEN o_totalprice > 250000 THEN TRUE ELSE FALSE END AS satisfies_k,
               CASE WHEN o_custkey % 3 = 0 THEN TRUE ELSE FALSE END AS satisfies_l,
               CASE WHEN o_totalprice > 100000 THEN TRUE ELSE FALSE END AS hipaa_passed,
               CASE WHEN o_custkey % 7 = 0 THEN 'All contributions are zero' END AS warning,
               o_custkey % 4 AS features,
               CASE WHEN o_custkey % 11 = 0 THEN FALSE ELSE TRUE END AS readable
        FROM {orders}""",
    "g_audit": """
        SELECT event_id AS audit_id, ts AS event_time, user_id, event_type AS action,
               CASE event_id % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'dataset' ELSE 'validation' END AS resource_type,
               props AS details
        FROM {events}""",
    "g_notifications": """
        SELECT event_id AS notification_id, user_id, ts AS created_at, event_type AS kind,
               CASE WHEN value < 20 THEN FALSE ELSE TRUE END AS is_read
        FROM {events}""",
    "g_runs": """
        SELECT o_orderkey AS run_id, o_custkey AS model_id, c_name AS model_name,
               o_custkey % 25 + 25 * (o_orderkey % 80) AS requirement_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'fairness' WHEN '2-HIGH' THEN 'privacy'
                    WHEN '3-MEDIUM' THEN 'transparency' ELSE 'accountability' END AS principle,
               CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'error' END AS status,
               o_orderdate AS started_at, o_totalprice AS score
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
}


def table(spark, directory, name) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def view(spark, directory, name) -> DataFrame:
    """A derived view, resolved lazily so that only the tables it names are opened."""
    sql = VIEWS[name].replace("{three_kinds}", "LATERAL VIEW explode(array(0, 1, 2)) k AS kind")
    used = {t: table(spark, directory, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def view_sql(name) -> str:
    """The view as SQL over tables that carry their own names."""
    return VIEWS[name].format(three_kinds="CROSS JOIN (VALUES (0), (1), (2)) k(kind)", **{t: t for t in TABLES})


def with_views(body, *names) -> str:
    """SQL text with the named views as common table expressions."""
    parts = [f"{n} AS ({view_sql(n)})" for n in names]
    return f"WITH {', '.join(parts)} {body}" if parts else body
