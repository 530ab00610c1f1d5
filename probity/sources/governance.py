"""The audit tables: columns, reading and writing."""

from pyspark.sql import DataFrame

# Column lists of the audit tables. Ids are text, times are UTC, details are JSON text.
SCHEMAS = {
    "projects": "project_id string, name string, owner_id string, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "datasets": (
        "dataset_id string, project_id string, name string, file_path string, row_count bigint, column_count int, "
        "columns array<string>, sensitive_attributes array<string>, target_column string, profile_data string, uploaded_at timestamp"),
    "ml_models": "model_id string, project_id string, name string, model_type string, model_metadata string, version string",
    "requirements": (
        "requirement_id string, project_id string, name string, description string, principle string, specification string, "
        "based_on_template_id string, status string, version int, elicited_automatically boolean, elicitation_reason string, "
        "confidence_score double, created_at timestamp"),
    "templates": (
        "template_id string, name string, description string, domain string, principles array<string>, "
        "recommended_datasets array<string>, reference string, "
        "items array<struct<metric:string,operator:string,value:double,principle:string,description:string>>, "
        "version int, is_active boolean"),
    "validations": (
        "validation_id string, requirement_id string, model_id string, dataset_id string, status string, progress int, "
        "started_at timestamp, completed_at timestamp, run_id string, error_message string, behavior_pattern string, "
        "affected_groups array<string>, feature_contributions string, created_at timestamp"),
    "validation_results": (
        "validation_id string, result_no bigint, principle string, metric_name string, metric_value double, threshold double, "
        "passed boolean, details string"),
    "validation_suites": (
        "suite_id string, model_id string, dataset_id string, fairness_validation_id string, transparency_validation_id string, "
        "privacy_validation_id string, status string, overall_passed boolean, error_message string, started_at timestamp, "
        "completed_at timestamp, created_by_id string"),
    "audit_logs": (
        "audit_id string, event_time timestamp, user_id string, action string, resource_type string, resource_id string, "
        "details string, ip_address string"),
    "notifications": (
        "notification_id string, user_id string, kind string, message string, is_read boolean, created_at timestamp"),
    "remediation_checklists": (
        "user_id string, suite_id string, principle string, "
        "steps array<struct<id:string,text:string,link:string,done:boolean>>"),
    "custom_rules": (
        "rule_id string, project_id string, principle string, name string, base_metric string, aggregation string, "
        "comparison string, default_threshold double, created_at timestamp"),
    "validation_presets": "preset_id string, project_id string, user_id string, name string, config string, created_at timestamp",
    "users": "user_id string, email string, name string, role string, is_active boolean, created_at timestamp, last_login timestamp",
}


def empty_table(spark, name) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def read_table(spark, root, name) -> DataFrame:
    """A stored audit table with its declared columns."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def append_rows(df, root, name):
    """Adds rows to an audit table; columns not given are null, unknown ones are an error."""
    spark = df.sparkSession
    wanted = empty_table(spark, name)
    unknown = set(df.columns) - set(wanted.columns)
    if unknown:
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    wanted.unionByName(df, allowMissingColumns=True).to(wanted.schema).write.mode("append").parquet(f"{root}/{name}")


def register_views(spark, root, names=None):
    """Temporary SQL views of the stored tables."""
    for name in names or SCHEMAS:
        read_table(spark, root, name).createOrReplaceTempView(name)
