"""JSON artifacts of runs: written by kind, read with a default.

Rows are (run_id, payload). Files are partitioned by the kind of artifact, of
which there are a few, and not by run, of which there may be millions.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds of artifacts a run may leave.
KINDS = (
    "fairness_report", "feature_importance", "model_card", "sample_predictions",
    "lime_explanations", "privacy_report", "transparency_warning",
)


def as_payload(df, run_column, *columns) -> DataFrame:
    """(run_id, payload) with the other columns as one JSON object."""
    rest = columns or [c for c in df.columns if c != run_column]
    return df.select(F.col(run_column).cast("string").alias("run_id"), F.to_json(F.struct(*rest)).alias("payload"))


def write_artifacts(artifacts, path, kind, mode="append"):
    """Stores (run_id, payload) rows of one kind as JSON lines."""
    if kind not in KINDS:
        raise ValueError(f"unknown artifact kind {kind}")
    artifacts.select("run_id", "payload").write.mode(mode).json(f"{path}/kind={kind}")


def read_artifacts(spark, path, kind) -> DataFrame:
    """The stored rows of a kind; a kind never written gives no rows, a bad line is skipped."""
    schema = "run_id string, payload string, kind string"
    files = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return files.where(F.col("kind") == kind).select("run_id", "payload")


def parsed(artifacts, schema, column="payload") -> DataFrame:
    """Rows with ``facts`` parsed from the payload; what cannot be read is empty.

    Exploding an array of one makes each payload be parsed once, however many
    of its fields later steps and filters use.
    """
    rest = [c for c in artifacts.columns if c != column]
    return artifacts.select(*rest, F.explode(F.array(F.from_json(column, schema))).alias("facts"))


def payload_or_default(runs, artifacts, default="{}") -> DataFrame:
    """Each run with its payload, or the default when it is missing or not JSON."""
    joined = runs.join(artifacts, "run_id", "left")
    valid = F.try_parse_json("payload").isNotNull()
    return joined.withColumn("payload", F.when(valid, F.col("payload")).otherwise(F.lit(default)))


def variant_payloads(spark, path, kinds=KINDS) -> DataFrame:
    """(run_id, kind, payload) of stored artifacts with the payload as a VARIANT, whatever its fields; null if it is not JSON."""
    schema = "run_id string, payload string, kind string"
    files = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return files.where(F.col("kind").isin(*kinds)).select("run_id", "kind", F.try_parse_json("payload").alias("payload"))


def _of_suites(suites, validations, slot):
    """(suite_id, validation_id, status, run_id) of the suites whose ``slot`` names a validation."""
    named = suites.select("suite_id", F.col(slot).alias("validation_id")).where(F.col("validation_id").isNotNull())
    return named.join(validations.select("validation_id", "status", F.col("run_id").cast("string").alias("run_id")), "validation_id")


def privacy_details(suites, validations, payloads) -> DataFrame:
    """The privacy report of each suite that has a privacy validation, ``{}`` where none can be read.

    ``payloads`` as ``variant_payloads`` gives them; ``payload`` keeps every field of the report as JSON.
    """
    reports = payloads.where("kind = 'privacy_report' AND payload IS NOT NULL").select("run_id", "payload")
    joined = _of_suites(suites, validations, "privacy_validation_id").join(reports, "run_id", "left")
    return joined.select(
        "suite_id", "validation_id", "status", F.coalesce(F.to_json("payload"), F.lit("{}")).alias("payload"),
        F.try_variant_get("payload", "$.overall_passed", "boolean").alias("overall_passed"),
        F.try_variant_get("payload", "$.pii_detected", "array<string>").alias("pii_detected"))


def transparency_details(suites, validations, payloads) -> DataFrame:
    """The transparency artifacts of each suite that has a transparency validation.

    ``importance`` lists (feature, value) by falling absolute value, equal ones by name. ``missing`` names what the
    run should have left and did not, if both the model card and the importance are missing; other parts are null.
    """
    kinds = ("model_card", "feature_importance", "sample_predictions", "transparency_warning")
    of = lambda kind: F.any_value(F.when(F.col("kind") == kind, F.col("payload")), True).alias(kind)
    # One row per run; a run leaves one artifact of a kind, so nothing is gathered here.
    per_run = payloads.where(F.col("kind").isin(*kinds) & F.col("payload").isNotNull()).groupBy("run_id").agg(*[of(k) for k in kinds])
    joined = _of_suites(suites, validations, "transparency_validation_id").join(per_run, "run_id", "left")
    entries = F.filter(F.map_entries(F.try_variant_get("feature_importance", "$", "map<string,double>")), lambda e: e["value"].isNotNull())
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct(
        (-F.abs(e["value"])).alias("order"), e["key"].alias("feature"), e["value"].alias("value"))))
    gone = F.col("model_card").isNull() & F.col("feature_importance").isNull()
    return joined.select(
        "suite_id", "validation_id", "status",
        F.transform(ranked, lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"))).alias("importance"),
        F.coalesce(F.to_json("model_card"), F.lit("{}")).alias("model_card"), F.to_json("sample_predictions").alias("sample_predictions"),
        F.try_variant_get("transparency_warning", "$.warning", "string").alias("warning"),
        F.when(gone, "model_card.json, feature_importance.json").alias("missing"))


def export_audit_trail(runs, versions, path, mode="overwrite"):
    """All run records and model versions as JSON lines."""
    runs.write.mode(mode).json(f"{path}/runs")
    versions.write.mode(mode).json(f"{path}/versions")
