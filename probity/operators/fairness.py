"""Group fairness of binary predictions.

One aggregate per sensitive group (``group_metrics``) is the only pass over the
data; every metric, rule, report and chart series is computed from its rows.
Spark combines the counts map-side, so a group holding most of the rows costs
no more than a small one.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import constants as C
from probity.functions import rates as R
from probity.functions.checks import require_columns

REPORT_COLUMNS = ("position", "metric_name", "value", "threshold", "comparison", "passed", "description")


def prepare_predictions(df, y_pred, sensitive, y_true=None) -> DataFrame:
    """Columns sensitive, y_true, y_pred; without a target y_true is y_pred."""
    has_target = y_true is not None and y_true in df.columns
    require_columns(df, [y_pred, sensitive])
    return df.select(
        F.col(sensitive).cast("string").alias("sensitive"),
        F.col(y_true if has_target else y_pred).cast("int").alias("y_true"),
        F.col(y_pred).cast("int").alias("y_pred"),
    )


def excluded_rows(df, y_true="y_true", y_pred="y_pred", sensitive="sensitive") -> DataFrame:
    """Rows left out of the metrics because a value is missing."""
    missing = F.col(sensitive).isNull() | F.col(y_true).isNull() | F.col(y_pred).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(missing).alias("rows_excluded"))


def group_metrics(df, y_true="y_true", y_pred="y_pred", sensitive="sensitive") -> DataFrame:
    """Rows, confusion counts and rates for every sensitive group."""
    require_columns(df, [y_true, y_pred, sensitive])
    counts = (
        df.select(y_true, y_pred, F.col(sensitive).cast("string").alias("group"))
        .na.drop()
        .groupBy("group")
        .agg(*R.confusion_sums(y_true, y_pred))
    )
    return counts.select(
        "*",
        R.base_metric("selection_rate").alias("selection_rate"),
        R.base_metric("accuracy_score").alias("accuracy"),
        R.base_metric("true_positive_rate").alias("tpr"),
        R.base_metric("false_positive_rate").alias("fpr"),
        R.base_metric("true_negative_rate").alias("tnr"),
        R.base_metric("false_negative_rate").alias("fnr"),
        R.base_metric("precision_score").alias("precision"),
    )


def confusion_matrices(groups) -> DataFrame:
    """Confusion matrix and derived rates per group."""
    return groups.select(
        "group", "tn", "fp", "fn", "tp", "accuracy", "tpr", "fpr", "tnr", "fnr", "precision"
    )


def sample_sizes(groups) -> DataFrame:
    return groups.select("group", "n")


def _between_groups():
    """The six built-in metrics over the extremes of the group rates."""
    sel_lo, sel_hi = F.col("selection_rate_min"), F.col("selection_rate_max")
    tpr_lo, tpr_hi = F.col("tpr_min"), F.col("tpr_max")
    fpr_lo, fpr_hi = F.col("fpr_min"), F.col("fpr_max")
    tpr_ratio = F.try_divide(tpr_lo, tpr_hi)
    fpr_ratio = F.try_divide(fpr_lo, fpr_hi)
    return {
        "demographic_parity_ratio": (F.try_divide(sel_lo, sel_hi), ">="),
        "demographic_parity_difference": (sel_hi - sel_lo, "<="),
        # An undefined TPR ratio makes the metric undefined; an undefined FPR
        # ratio (no false positives anywhere) leaves the TPR ratio to decide.
        "equalized_odds_ratio": (F.when(tpr_ratio.isNotNull(), F.least(tpr_ratio, fpr_ratio)), ">="),
        "equalized_odds_difference": (F.greatest(tpr_hi - tpr_lo, fpr_hi - fpr_lo), "<="),
        "equal_opportunity_difference": (tpr_hi - tpr_lo, "<="),
        "disparate_impact_ratio": (
            F.when(sel_hi > 0, sel_lo / sel_hi).when(sel_hi.isNotNull(), F.lit(1.0)), ">="
        ),
    }


# Opening words of each metric's description.
DESCRIPTIONS = {
    "demographic_parity_ratio": "Selection rate ratio",
    "demographic_parity_difference": "Selection rate difference",
    "equalized_odds_ratio": "Equalized odds ratio",
    "equalized_odds_difference": "Equalized odds difference",
    "equal_opportunity_difference": "True Positive Rate difference",
    "disparate_impact_ratio": "Disparate impact ratio",
}


# Undefined metrics are shown as nan.
def _shown(column):
    return F.when(F.col(column).isNull(), "nan").otherwise(F.format_string("%.3f", column))


def builtin_metrics(groups, thresholds=None, selected=None) -> DataFrame:
    """Built-in metrics in the order asked for; unknown names are ignored.

    A threshold of 0 is honoured. An undefined metric has a null value and
    does not pass.
    """
    limits = {**C.FAIRNESS_THRESHOLDS, **(thresholds or {})}
    names = [m for m in (selected or C.FAIRNESS_THRESHOLDS) if m in C.FAIRNESS_THRESHOLDS]
    formulas = _between_groups()
    extremes = groups.agg(*[
        fn(c).alias(f"{c}_{suffix}")
        for c in ("selection_rate", "tpr", "fpr")
        for fn, suffix in ((F.min, "min"), (F.max, "max"))
    ])
    if not names:
        extremes, names = extremes.limit(0), list(C.FAIRNESS_THRESHOLDS)
    rows = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("metric_name"),
            formulas[name][0].alias("value"),
            F.lit(float(limits[name])).alias("threshold"),
            F.lit(formulas[name][1]).alias("comparison"),
            F.lit(DESCRIPTIONS[name]).alias("label"),
        )
        for position, name in enumerate(names)
    ]
    passed = R.meets(F.col("value"), F.col("comparison"), F.col("threshold"))
    return (
        extremes.select(F.inline(F.array(*rows)))
        .withColumn("passed", passed)
        .withColumn(
            "description",
            F.concat(
                "label", F.lit(": "), _shown("value"), F.lit(". "),
                F.when(F.col("passed"), "Passed").otherwise("Failed"),
                F.when(F.col("metric_name") == "disparate_impact_ratio", " 80% rule").otherwise(""),
                F.lit(" threshold of "), F.format_string("%.2f", "threshold"), F.lit("."),
            ),
        )
        .select(*REPORT_COLUMNS)
    )


RULE_SCHEMA = (
    "position int, name string, base_metric string, aggregation string, "
    "comparison string, default_threshold double"
)


def rules_frame(spark, rules) -> DataFrame:
    """Custom rules given as dictionaries, as a table."""
    rows = [
        (
            i,
            rule.get("name"),
            rule.get("base_metric"),
            rule.get("aggregation"),
            rule.get("comparison", ">="),
            float(rule.get("default_threshold", C.RULE_DEFAULT_THRESHOLD)),
        )
        for i, rule in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def check_rules(rules) -> DataFrame:
    """Rules with trimmed texts and an ``error`` (null when the rule is valid)."""
    trimmed = rules.withColumns({
        c: F.trim(F.coalesce(F.col(c), F.lit("")))
        for c in ("name", "base_metric", "aggregation")
    }).withColumn("comparison", F.trim(F.coalesce(F.col("comparison"), F.lit(">="))))
    finite = ~F.isnan("default_threshold") & (F.abs("default_threshold") < F.lit(math.inf))
    prefix = F.concat(F.lit("Custom rule '"), F.col("name"), F.lit("': "))
    return trimmed.withColumn(
        "error",
        F.when(F.col("name") == "", "Custom rule must include a non-empty 'name'")
        .when(
            ~F.col("base_metric").isin(*C.BASE_METRICS),
            F.concat(prefix, F.lit("unsupported base_metric '"), F.col("base_metric"), F.lit("'")),
        )
        .when(
            ~F.col("aggregation").isin(*C.RULE_AGGREGATIONS),
            F.concat(prefix, F.lit("unsupported aggregation '"), F.col("aggregation"), F.lit("'")),
        )
        .when(
            ~F.col("comparison").isin(*C.RULE_COMPARISONS),
            F.concat(prefix, F.lit("unsupported comparison '"), F.col("comparison"), F.lit("'")),
        )
        .when(
            ~F.coalesce(finite, F.lit(False)),
            F.concat(prefix, F.lit("default_threshold must be finite")),
        ),
    )


def duplicate_rules(rules) -> DataFrame:
    """Names used more than once within a project and principle."""
    return (
        rules.groupBy("project_id", "principle", F.trim("name").alias("name"))
        .agg(F.count(F.lit(1)).alias("uses"))
        .where("uses > 1")
    )


def rules_in_effect(stored, project_id, spark=None, given=None) -> DataFrame:
    """Rules of the request if there are any, else those stored for the project, newest first, ties by what they say."""
    if given:
        return rules_frame(spark, given)
    newest = Window.orderBy(F.desc("created_at"), "name", "base_metric", "aggregation", "comparison", "default_threshold")
    return (
        stored.where((F.col("project_id") == project_id) & (F.col("principle") == "fairness"))
        .select(
            (F.row_number().over(newest) - 1).alias("position"),
            "name", "base_metric", "aggregation", "comparison", "default_threshold",
        )
    )


def base_metric_values(groups) -> DataFrame:
    """(group, base_metric, group_value) of the nine base metrics."""
    values = F.array(*[
        F.struct(F.lit(m).alias("base_metric"), R.base_metric(m).alias("group_value"))
        for m in C.BASE_METRICS
    ])
    return groups.select("group", F.inline(values))


def base_metric_extremes(groups) -> DataFrame:
    """Lowest and highest group value of each of the nine base metrics."""
    return base_metric_values(groups).groupBy("base_metric").agg(F.min("group_value").alias("low"), F.max("group_value").alias("high"))


def custom_metrics(groups, rules, thresholds=None, first_position=0) -> DataFrame:
    """Every rule evaluated on the groups; a bad rule becomes a failed row of value 0."""
    overrides = {k: float(v) for k, v in (thresholds or {}).items() if v is not None}
    limit = F.col("default_threshold")
    if overrides:
        pairs = [F.lit(x) for item in overrides.items() for x in item]
        limit = F.coalesce(F.element_at(F.create_map(*pairs), F.col("name")), limit)
    checked = check_rules(rules).withColumn("limit", limit)
    finite = ~F.isnan("limit") & (F.abs("limit") < F.lit(math.inf))
    checked = checked.withColumn(
        "error",
        F.coalesce("error", F.when(
            ~finite,
            F.concat(F.lit("Custom rule '"), F.col("name"), F.lit("': threshold override must be finite")),
        )),
    )
    # The right side has one row per base metric, nine at most.
    joined = checked.join(F.broadcast(base_metric_extremes(groups)), "base_metric", "left")
    ok = F.col("error").isNull()
    value = R.aggregate_groups(F.col("aggregation"), F.col("low"), F.col("high"))
    joined = joined.withColumn("value", F.when(ok, value).otherwise(F.lit(0.0)))
    passed = ok & R.meets(F.col("value"), F.col("comparison"), F.col("limit"))
    return joined.withColumn("passed", passed).select(
        (F.col("position") + F.lit(first_position)).alias("position"),
        F.when(F.col("name") == "", "unknown_custom_rule").otherwise(F.col("name")).alias("metric_name"),
        "value",
        F.when(ok, F.col("limit")).otherwise(F.col("default_threshold")).alias("threshold"),
        "comparison",
        "passed",
        F.when(
            ok,
            F.concat(
                F.format_string("Custom rule '%s': %s(%s) = ", "name", "aggregation", "base_metric"),
                _shown("value"), F.lit(". "),
                F.when(F.col("passed"), "Passed").otherwise("Failed"),
                F.format_string(" threshold %s %.2f.", "comparison", "limit"),
            ),
        ).otherwise(F.concat(F.lit("Custom rule error: "), "error")).alias("description"),
    )


def fairness_report(groups, thresholds=None, selected=None, rules=None) -> DataFrame:
    """Built-in metrics, then custom rules, one row each, in order."""
    known = [m for m in (selected or C.FAIRNESS_THRESHOLDS) if m in C.FAIRNESS_THRESHOLDS]
    if not known and rules is None:
        raise ValueError(f"No supported fairness metrics selected. Choose from: {list(C.FAIRNESS_THRESHOLDS)}")
    if rules is None:
        return builtin_metrics(groups, thresholds, known)
    custom = custom_metrics(groups, rules, thresholds, first_position=len(known))
    if not known:
        return custom
    return builtin_metrics(groups, thresholds, known).unionByName(custom)


def overall_verdict(report) -> DataFrame:
    """Counts of passed metrics and whether all of them pass."""
    return report.agg(
        F.count(F.lit(1)).alias("metrics"),
        F.count_if("passed").alias("metrics_passed"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("overall_passed"),
    )


def fairness_summary(groups) -> DataFrame:
    """The three ratios at default thresholds and whether all pass, in one row; ``summary_groups`` has the groups."""
    ratios = ["demographic_parity_ratio", "equalized_odds_ratio", "disparate_impact_ratio"]
    report = builtin_metrics(groups, selected=ratios)
    pick = [F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in ratios]
    return report.agg(*pick, F.bool_and("passed").alias("overall_fair"))


def summary_groups(groups) -> DataFrame:
    """What the summary says of each group: its sample size and selection rate."""
    return groups.select("group", F.col("n").alias("sample_size"), "selection_rate")


def by_group(groups) -> DataFrame:
    """The group values behind each built-in metric, as (metric, part, group, value)."""
    sources = {
        "demographic_parity_ratio": ["selection_rate"],
        "demographic_parity_difference": ["selection_rate"],
        "equalized_odds_ratio": ["tpr", "fpr"],
        "equalized_odds_difference": ["tpr", "fpr"],
        "equal_opportunity_difference": ["tpr"],
        "disparate_impact_ratio": ["selection_rate"],
    }
    rows = [
        F.struct(F.lit(m).alias("metric_name"), F.lit(c).alias("part"), F.col(c).alias("value"))
        for m, columns in sources.items() for c in columns
    ]
    return groups.select("group", F.inline(F.array(*rows)))


def result_rows(validation_id, report, groups) -> DataFrame:
    """Stored result rows: one per metric plus one, always passed, for the matrices.

    Details hold the description and the number of groups. The values and
    matrices of the groups are rows of their own (``group_value_rows``), so any
    number of groups is stored whole.
    """
    metrics = report.select(
        "metric_name", F.col("value").alias("metric_value"), "threshold", "passed", F.to_json(F.struct("description")).alias("details"))
    matrix_row = groups.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("groups"))).alias("details")).select(
        F.lit("group_confusion_matrices").alias("metric_name"),
        F.lit(None).cast("double").alias("metric_value"),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(True).alias("passed"),
        "details",
    )
    return metrics.unionByName(matrix_row).select(
        F.lit(validation_id).alias("validation_id"), F.lit("fairness").alias("principle"), "*"
    )


def group_value_rows(validation_id, groups, rules=None) -> DataFrame:
    """What is stored beside the result rows: (validation_id, metric_name, part, group, value) of every group,
    matrices and the base metrics of usable custom rules included."""
    cells = [F.struct(F.lit("group_confusion_matrices").alias("metric_name"), F.lit(c).alias("part"), F.col(c).cast("double").alias("value"))
             for c in ("tn", "fp", "fn", "tp")]
    matrices = groups.select("group", F.inline(F.array(*cells)))
    rows = by_group(groups).unionByName(matrices)
    if rules is not None:
        usable = check_rules(rules).where("error IS NULL").select(F.col("name").alias("metric_name"), "base_metric")
        rows = rows.unionByName(base_metric_values(groups).join(usable, "base_metric").select(
            "group", "metric_name", F.col("base_metric").alias("part"), F.col("group_value").alias("value")))
    return rows.select(F.lit(validation_id).alias("validation_id"), "metric_name", "part", "group", "value")


def chart_series(groups, report) -> DataFrame:
    """Long rows (chart, series, label, value) for the usual fairness charts."""
    def bar(chart, series, value):
        return F.struct(
            F.lit(chart).alias("chart"), F.lit(series).alias("series"),
            F.col("group").alias("label"), value.cast("double").alias("value"),
        )

    bars = groups.select(F.inline(F.array(
        bar("selection_rate", "selection_rate", F.col("selection_rate")),
        bar("tpr_fpr", "tpr", F.col("tpr")),
        bar("tpr_fpr", "fpr", F.col("fpr")),
        *[bar("confusion", c, F.col(c)) for c in ("tn", "fp", "fn", "tp")],
    )))
    line = groups.agg((F.min("selection_rate") / 0.8).alias("value")).select(
        F.lit("selection_rate").alias("chart"), F.lit("parity_line").alias("series"),
        F.lit("all").alias("label"), "value",
    )
    radar = report.select(
        F.lit("radar").alias("chart"), F.lit("metric").alias("series"),
        F.col("metric_name").alias("label"),
        F.when(F.col("value").isNotNull(), F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0))).alias("value"),
    )
    return bars.unionByName(line).unionByName(radar)


def fairness_from_predictions(df, y_pred, sensitive, y_true=None, thresholds=None, selected=None, rules=None):
    """Fairness of a dataset that already stores predictions: (report, groups)."""
    groups = group_metrics(prepare_predictions(df, y_pred, sensitive, y_true))
    return fairness_report(groups, thresholds, selected, rules), groups
