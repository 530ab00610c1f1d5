"""Suite history, run comparison, trends and verdicts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import constants as C
from probity.operators.trace import latest_results, only, suite_validations

LOWER_IS_BETTER = "difference|disparity"


def newest_suites(suites, models, limit=50, project_id=None) -> DataFrame:
    """The newest suites of each project (all of them with ``limit=None``)."""
    joined = suites.join(
        only(models, "project_id", project_id).select("model_id", "project_id", F.col("name").alias("model_name")), "model_id")
    if limit is None:
        return joined
    order = Window.partitionBy("project_id").orderBy(F.desc("started_at"), F.desc("suite_id"))
    return joined.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def suite_history(suites, models, datasets, results, limit=50, project_id=None) -> DataFrame:
    """Per suite and principle: whether it ran, its results and how many passed."""
    chosen = newest_suites(suites, models, limit, project_id)
    parts = suite_validations(chosen).select("suite_id", "principle", "validation_id")
    wanted = parts.select("validation_id")
    counts = results.join(wanted, "validation_id", "left_semi").groupBy("validation_id").agg(
        F.count(F.lit(1)).alias("metrics_count"), F.count_if("passed").alias("passed_count"))
    filled = parts.join(counts, "validation_id", "left")
    everything = chosen.select(
        "project_id", "suite_id", "model_name", "dataset_id", "status", "overall_passed", "started_at",
        F.explode(F.array(*[F.lit(p) for p in ("fairness", "transparency", "privacy")])).alias("principle"))
    names = datasets.select("dataset_id", F.col("name").alias("dataset_name"))
    return everything.join(filled, ["suite_id", "principle"], "left").join(names, "dataset_id", "left").select(
        "project_id", "suite_id", "model_name", F.coalesce("dataset_name", F.lit("Unknown")).alias("dataset_name"),
        "status", "overall_passed", "started_at", "principle",
        F.col("validation_id").isNotNull().alias("completed"),
        F.coalesce("metrics_count", F.lit(0)).alias("metrics_count"),
        F.coalesce("passed_count", F.lit(0)).alias("passed_count"),
    )


def suite_metrics(suites, results) -> DataFrame:
    """(suite, principle, metric) with the latest value; unnamed and empty metrics left out.

    The principle is that of the suite's slot the validation sits in.
    """
    parts = suite_validations(suites).select("suite_id", F.col("principle").alias("slot"), "validation_id")
    latest = latest_results(results.where(F.col("metric_name").isNotNull() & F.col("metric_value").isNotNull()))
    return parts.join(latest, "validation_id").select(
        "suite_id", F.col("slot").alias("principle"), "metric_name", F.col("metric_value").alias("value"), "threshold", "passed")


def metric_maps(metrics) -> DataFrame:
    """The metrics of each suite and principle as one map, for display of chosen suites."""
    entry = F.struct("metric_name", F.struct("value", "threshold", "passed"))
    return metrics.groupBy("suite_id", "principle").agg(F.map_from_entries(F.collect_list(entry)).alias("metrics"))


def suite_results(suites, validations, results) -> DataFrame:
    """Every result of every suite with the validation it came from; a slot without results keeps one row."""
    parts = suite_validations(suites).select("suite_id", F.col("principle").alias("slot"), "validation_id")
    states = validations.select("validation_id", F.col("status").alias("validation_status"))
    rows = results.select("validation_id", "metric_name", "metric_value", "threshold", "passed")
    return parts.join(states, "validation_id", "left").join(rows, "validation_id", "left").select(
        "suite_id", F.col("slot").alias("principle"), "validation_id",
        F.coalesce("validation_status", F.lit("not_run")).alias("validation_status"),
        "metric_name", "metric_value", "threshold", "passed")


def latest_pairs(suites) -> DataFrame:
    """The newest suite of each model (run B) with the one before it (run A).

    The rank limit is applied in every task before the shuffle, so a model with
    very many suites sends only a few rows.
    """
    order = Window.partitionBy("model_id").orderBy(F.desc("started_at"), F.desc("suite_id"))
    newest = suites.select("model_id", "suite_id", F.row_number().over(order).alias("rank")).where("rank <= 2")
    pick = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("suite_id")))
    return newest.groupBy("model_id").agg(pick(2).alias("run_a"), pick(1).alias("run_b")).where("run_a IS NOT NULL").select(
        "run_a", "run_b")


def compare_runs(metrics, pairs) -> DataFrame:
    """All metrics of either run with B - A where both have it and whether that is better."""
    # Each pair stands under both of its suites, so the metrics are read once and the sides meet in one aggregate.
    sides = pairs.select("run_a", "run_b", F.inline(F.array(*[
        F.struct(F.lit(c).alias("_side"), F.col(c).alias("suite_id")) for c in ("run_a", "run_b")])))
    of = lambda run: F.max(F.when(F.col("_side") == run, F.col("value")))
    joined = sides.join(metrics.select("suite_id", "principle", "metric_name", "value"), "suite_id").groupBy(
        "run_a", "run_b", "principle", "metric_name").agg(of("run_a").alias("value_a"), of("run_b").alias("value_b"))
    delta = F.col("value_b") - F.col("value_a")
    lower = F.col("metric_name").rlike(LOWER_IS_BETTER)
    return joined.withColumn("delta", delta).withColumn(
        "improved", F.when(F.col("delta") == 0, None).when(lower, F.col("delta") < 0).otherwise(F.col("delta") > 0))


def metric_trend(suites, metrics, names) -> DataFrame:
    """One row per run with fairness metrics and one column per metric, for models with two runs or more."""
    runs = metrics.where(F.col("principle") == "fairness").groupBy("suite_id").pivot("metric_name", list(names)).agg(
        F.first("value"))
    dated = runs.join(suites.select("suite_id", "model_id", "started_at"), "suite_id")
    several = dated.groupBy("model_id").agg(F.count(F.lit(1)).alias("runs")).where("runs >= 2").select("model_id")
    return dated.join(several, "model_id", "left_semi")


def suite_verdict(parts) -> DataFrame:
    """Whether a suite passes: (suite_id, fairness_passed, privacy_passed, transparency_status); a part not run passes."""
    transparency = F.coalesce(F.col("transparency_status").isin("completed", "skipped"), F.lit(True))
    return parts.select(
        "suite_id",
        (F.coalesce("fairness_passed", F.lit(True)) & F.coalesce("privacy_passed", F.lit(True)) & transparency).alias("overall_passed"))


def validators_to_run(selected=None):
    """Validator names in running order; none selected means all."""
    wanted = {v.lower() for v in selected} if selected else set(C.PRINCIPLES)
    return [v for v in ("fairness", "transparency", "privacy", "accountability") if v in wanted]


def requirement_links(requirements, position="requirement_id", keys=("project_id",)) -> DataFrame:
    """The requirement linked per principle: the last one given."""
    return requirements.groupBy(*keys, "principle").agg(F.max_by("requirement_id", position).alias("requirement_id"))
