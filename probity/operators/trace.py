"""Traceability from requirements to validations and their results.

All functions work on every project at once; pass ``project_id`` to narrow a
plan down, which Spark pushes into the scans.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions import messages as M
from probity.functions.partitioning import parted_by

NO_RESULTS = "No validation results available."
NO_PATTERN = "No measurable behavior patterns detected."
SUITE_PARTS = {
    "fairness": "fairness_validation_id",
    "transparency": "transparency_validation_id",
    "privacy": "privacy_validation_id",
}


def only(df, column, value):
    return df if value is None else df.where(F.col(column) == value)


def result_totals(results) -> DataFrame:
    """Per validation: results, passed results, whether all pass, and their principle."""
    return results.groupBy("validation_id").agg(
        F.count(F.lit(1)).alias("metrics_total"),
        F.count_if("passed").alias("metrics_passed"),
        F.bool_and("passed").alias("overall_passed"),
        F.when(F.min("principle") == F.max("principle"), F.min("principle")).otherwise("multiple").alias("results_principle"),
    )


def suite_validations(suites) -> DataFrame:
    """(suite, principle, validation) rows of suites that name up to three validations."""
    parts = F.array(*[F.struct(F.lit(p).alias("principle"), F.col(c).alias("validation_id")) for p, c in SUITE_PARTS.items()])
    others = [c for c in suites.columns if c not in SUITE_PARTS.values()]
    return suites.select(*others, F.inline(parts)).where(F.col("validation_id").isNotNull())


def status_of(passed):
    return F.when(passed, "pass").when(~passed, "fail").otherwise("unknown")


def traceability_matrix(requirements, models, datasets, validations, results, suites, project_id=None) -> DataFrame:
    """One trace per validation of a project's models, and one per requirement never validated.

    A validation is linked when its requirement belongs to the model's project.
    """
    reqs = only(requirements, "project_id", project_id).select(
        "requirement_id", "project_id", F.col("name").alias("requirement_name"), F.col("principle").alias("requirement_principle"))
    projects = only(models, "project_id", project_id).select("model_id", "project_id", F.col("name").alias("model_name"))
    suite_of = suite_validations(suites).groupBy("validation_id").agg(F.min_by("suite_id", "started_at").alias("suite_id"))
    checked = (
        validations.select("validation_id", "requirement_id", "model_id", "dataset_id")
        .join(projects, "model_id")
        .join(datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id", "left")
        .join(result_totals(results), "validation_id", "left")
        .join(suite_of, "validation_id", "left")
    )
    linked = checked.join(reqs.withColumn("linked", F.lit(True)), ["requirement_id", "project_id"], "left")
    known = F.col("linked").isNotNull()
    traces = linked.select(
        "project_id",
        F.when(known, F.col("requirement_id")).alias("requirement_id"),
        "requirement_name",
        F.when(known, F.col("requirement_principle")).otherwise(F.col("results_principle")).alias("principle"),
        "dataset_name", "model_name", "validation_id", "suite_id",
        F.coalesce("metrics_passed", F.lit(0)).alias("metrics_passed"),
        F.coalesce("metrics_total", F.lit(0)).alias("metrics_total"),
        status_of(F.col("overall_passed")).alias("status"),
    )
    used = checked.select("requirement_id", "project_id").where(F.col("requirement_id").isNotNull()).distinct()
    untested = reqs.join(used, ["requirement_id", "project_id"], "left_anti").select(
        "project_id", "requirement_id", "requirement_name", F.col("requirement_principle").alias("principle"),
        F.lit("not_validated").alias("status"))
    return traces.unionByName(untested, allowMissingColumns=True).withColumns({
        "metrics_passed": F.coalesce("metrics_passed", F.lit(0)),
        "metrics_total": F.coalesce("metrics_total", F.lit(0)),
    })


def traceability_summary(traces, requirements) -> DataFrame:
    """Totals and pass rate per project."""
    counts = traces.groupBy("project_id").agg(
        F.count("validation_id").alias("total_validations"),
        F.count_if(F.col("status") == "pass").alias("pass_count"),
        F.count_if(F.col("status") == "fail").alias("fail_count"),
        F.count_if(F.col("status") == "not_validated").alias("not_validated_count"),
    )
    totals = requirements.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_requirements"))
    decided = F.greatest(F.col("pass_count") + F.col("fail_count"), F.lit(1))
    return counts.join(totals, "project_id", "left").select(
        "project_id", F.coalesce("total_requirements", F.lit(0)).alias("total_requirements"),
        "total_validations", "pass_count", "fail_count", "not_validated_count",
        F.round(F.col("pass_count") / decided * 100, 1).alias("pass_rate"),
    )


def filter_traces(traces, principle=None, status=None, search=None, model_id=None, models=None) -> DataFrame:
    """Decided traces, by principle, status and text over names."""
    out = traces.where(F.col("status").isin("pass", "fail"))
    out = only(only(out, "principle", principle), "status", status)
    if search:
        text = F.lower(F.concat_ws(
            " ", "requirement_name", F.when(F.col("requirement_id").isNotNull(), F.col("principle")), "dataset_name", "model_name"))
        out = out.where(F.contains(text, F.lit(search.lower())))
    if model_id is not None:
        named = models.where(F.col("model_id") == model_id).select(F.col("name").alias("model_name"), "project_id")
        out = out.join(named, ["model_name", "project_id"], "left_semi")
    return out


def requirement_history(validations, results, models, datasets, requirement_id=None) -> DataFrame:
    """Validations of requirements with their verdict; order by created_at descending to read it."""
    chosen = only(validations.where(F.col("requirement_id").isNotNull()), "requirement_id", requirement_id)
    return (
        chosen.join(result_totals(results), "validation_id", "left")
        .join(models.select("model_id", F.col("name").alias("model_name")), "model_id", "left")
        .join(datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id", "left")
        .select(
            "requirement_id", "validation_id", "status", "overall_passed",
            F.coalesce("model_name", F.lit("Unknown")).alias("model_name"),
            F.coalesce("dataset_name", F.lit("Unknown")).alias("dataset_name"),
            "created_at", F.coalesce("metrics_total", F.lit(0)).alias("metrics_total"),
        )
    )


def requirement_history_results(history, results) -> DataFrame:
    """The results behind a history, one row each."""
    return history.select("requirement_id", "validation_id", "created_at").join(parted_by(results, "validation_id"), "validation_id")


def decided_history(history) -> DataFrame:
    return history.where(F.col("overall_passed").isNotNull())


def dataset_requirement_uses(validations) -> DataFrame:
    """Per dataset and requirement: validations that used both and the latest of them."""
    latest = F.struct("created_at", "validation_id", "status")
    return validations.where(F.col("requirement_id").isNotNull()).groupBy("dataset_id", "requirement_id").agg(
        F.count(F.lit(1)).alias("validation_count"), F.max(latest).alias("latest"),
    ).select(
        "dataset_id", "requirement_id", "validation_count",
        F.col("latest.validation_id").alias("latest_validation_id"), F.col("latest.status").alias("latest_status"))


def dataset_impact(dataset_id, datasets, requirements, validations) -> DataFrame:
    """Every requirement of a dataset's project with the validations that used the dataset."""
    project = datasets.where(F.col("dataset_id") == dataset_id).select("project_id")
    mine = requirements.join(project, "project_id", "left_semi").select("requirement_id", "principle")
    uses = dataset_requirement_uses(validations.where(F.col("dataset_id") == dataset_id)).drop("dataset_id")
    return mine.join(uses, "requirement_id", "left").withColumn(
        "validation_count", F.coalesce("validation_count", F.lit(0)))


def dataset_usage(validations) -> DataFrame:
    """Per dataset: validations that used it and how many name no requirement."""
    return validations.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(F.col("requirement_id").isNull()).alias("unlinked_validations"),
    )


def latest_results(results) -> DataFrame:
    """One result per validation and metric: the one with the highest ``result_no``.

    Few results share both, so combining them before the shuffle would only fill and spill hash tables.
    """
    others = [c for c in results.columns if c not in ("validation_id", "metric_name", "result_no")]
    return parted_by(results, "validation_id").groupBy("validation_id", "metric_name").agg(
        F.max("result_no").alias("result_no"), *[F.max_by(c, "result_no").alias(c) for c in others])


def root_causes(results, validations, datasets) -> DataFrame:
    """One row per failed result: the gap to its threshold, why it failed and what to do."""
    failed = results.where(~F.col("passed"))
    owner = validations.select("validation_id", "dataset_id").join(
        datasets.select("dataset_id", "sensitive_attribute"), "dataset_id", "left")
    joined = failed.join(owner.select("validation_id", "sensitive_attribute"), "validation_id", "left")
    args = F.col("principle"), F.col("metric_name")
    return joined.select(
        "validation_id", "result_no", "principle", "metric_name", "metric_value", "threshold",
        F.round(F.abs(F.col("metric_value") - F.col("threshold")), 4).alias("gap"),
        M.root_cause(*args, F.col("metric_value"), F.col("threshold"), F.col("sensitive_attribute")).alias("description"),
        M.advice(*args, F.col("sensitive_attribute")).alias("recommendation"),
    )


def cause_details(results) -> DataFrame:
    """Affected feature and group breakdown stored in the JSON details of failed results."""
    return results.where(~F.col("passed")).select(
        "validation_id", "metric_name",
        F.get_json_object("details", "$.affected_feature").alias("affected_feature"),
        F.get_json_object("details", "$.group_metrics").alias("group_breakdown"),
    )


def behaviour_sentences(results) -> DataFrame:
    """One sentence per result that has a value."""
    sentence = M.behaviour(F.col("principle"), F.col("metric_name"), F.col("metric_value"), F.col("passed"))
    return results.select("validation_id", "result_no", sentence.alias("sentence")).where("sentence IS NOT NULL")


def behaviour_patterns(validations, results) -> DataFrame:
    """The sentences of a validation's latest results joined in result order.

    There is one latest result per metric, so a text has as many sentences as
    the validation has metrics.
    """
    latest = latest_results(results)
    sentence = M.behaviour(F.col("principle"), F.col("metric_name"), F.col("metric_value"), F.col("passed"))
    rows = latest.select("validation_id", F.struct("result_no", sentence.alias("sentence")).alias("item"))
    texts = rows.groupBy("validation_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("item")), lambda x: x["sentence"]), " ").alias("text"))
    return validations.select("validation_id").join(texts, "validation_id", "left").select(
        "validation_id",
        F.when(F.col("text").isNull(), NO_RESULTS).when(F.col("text") == "", NO_PATTERN)
        .otherwise(F.col("text")).alias("behavior_pattern"),
    )


def trace_export(traces, patterns=None) -> DataFrame:
    """The eight columns of the matrix export."""
    rows = traces
    if patterns is not None:
        rows = rows.join(patterns, "validation_id", "left")
    else:
        rows = rows.withColumn("behavior_pattern", F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        blank("requirement_name").alias("Requirement"), blank("principle").alias("Principle"),
        blank("dataset_name").alias("Dataset"), blank("model_name").alias("Model"),
        F.col("metrics_passed").alias("Metrics Passed"), F.col("metrics_total").alias("Total Metrics"),
        F.col("status").alias("Status"), blank("behavior_pattern").alias("Behavior Pattern"),
    )
