"""The whole audit of a scored dataset: fairness, transparency, privacy, accountability."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators import explain, fairness, privacy_report
from probity.operators.history import suite_verdict, validators_to_run

#: States of a run that came to an end.
FINISHED = ("completed", "passed", "failed")


@dataclass
class SuiteConfig:
    """What to audit and how; ``scorer`` adds a ``score`` column to a DataFrame of features."""

    suite_id: str
    id_column: str
    y_pred: str
    sensitive: str
    y_true: str = None
    features: tuple = ()
    scorer: object = None
    validators: tuple = ()
    thresholds: dict = field(default_factory=dict)
    fairness_metrics: tuple = None
    rules: DataFrame = None
    explained_rows: int = None
    #: The rows the model was trained on, if they are kept apart, and whether local surrogates are made (of so many rows, or all).
    training: DataFrame = None
    with_surrogates: bool = False
    surrogate_rows: int = None
    #: Run records (suite_id, status, ...) of any number of suites.
    runs: DataFrame = None
    privacy: dict = field(default_factory=dict)


def _rows(df, suite_id, principle, name, value, threshold, passed, details):
    return df.select(
        F.lit(f"{suite_id}-{principle}").alias("validation_id"), F.lit(principle).alias("principle"), name.alias("metric_name"),
        value.cast("double").alias("metric_value"), threshold.cast("double").alias("threshold"), passed.alias("passed"),
        details.cast("string").alias("details"))


def audit_suite(df, config) -> dict:
    """Result rows of every validator asked for and the verdict of the suite.

    Each validator reads only its own columns of ``df``; nothing is cached here.
    """
    run = validators_to_run(config.validators)
    parts, reports, transparency = [], {}, None
    nothing = F.lit(None)
    if "fairness" in run:
        groups = fairness.group_metrics(fairness.prepare_predictions(df, config.y_pred, config.sensitive, config.y_true))
        report = fairness.fairness_report(groups, config.thresholds, config.fairness_metrics, config.rules)
        reports["fairness"] = report
        parts.append(fairness.result_rows(f"{config.suite_id}-fairness", report, groups))
    if "transparency" in run:
        found = explain.transparency_report(
            df, config.id_column, config.features, config.scorer, config.y_true, config.y_pred, rows=config.explained_rows,
            with_surrogates=config.with_surrogates, surrogate_rows=config.surrogate_rows, training=config.training)
        transparency = "completed" if found["status"] == "completed" else "skipped"
        if transparency == "completed":
            reports["transparency"] = found
            parts.append(_rows(found["checks"], config.suite_id, "transparency", F.col("check"), nothing, nothing,
                               F.col("passed"), F.col("details")))
            parts.append(_rows(found["importance"], config.suite_id, "transparency",
                               F.concat(F.lit("importance_"), "feature"), F.col("importance"), nothing, F.lit(True), nothing))
    if "privacy" in run:
        checks = privacy_report.privacy_checks(df, config.id_column, config.privacy)
        reports["privacy"] = checks
        parts.append(_rows(checks, config.suite_id, "privacy", F.col("check"), F.col("measured"), F.col("required"),
                           F.col("passed"), F.col("detail")))
    if "accountability" in run:
        # Passed only if a run of this suite is on record and came to an end.
        runs = df.sparkSession.range(0) if config.runs is None else config.runs.where(
            (F.col("suite_id").cast("string") == F.lit(str(config.suite_id))) & F.col("status").isin(*FINISHED))
        recorded = runs.agg((F.count(F.lit(1)) > 0).alias("there"))
        parts.append(_rows(recorded, config.suite_id, "accountability", F.lit("audit_trail_exists"), F.col("there").cast("double"), F.lit(1.0),
                           F.col("there"), nothing))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    of = lambda p: F.bool_and(F.when(F.col("principle") == p, F.col("passed")))
    outcome = rows.agg(of("fairness").alias("fairness_passed"), of("privacy").alias("privacy_passed")).select(
        F.lit(config.suite_id).alias("suite_id"), "fairness_passed", "privacy_passed",
        F.lit(transparency).cast("string").alias("transparency_status"))
    return {"rows": rows, "verdict": suite_verdict(outcome), "reports": reports}
