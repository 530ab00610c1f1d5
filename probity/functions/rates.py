"""Column expressions over the counts tp, fp, fn and tn."""

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn")


def confusion_sums(y_true, y_pred, weight=None):
    """Aggregates giving n, tp, fp, fn and tn of two 0/1 columns; with ``weight``, a whole number of rows that a row stands for."""
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    cells = {"tp": t & p, "fp": ~t & p, "fn": t & ~p, "tn": ~t & ~p}
    if weight is not None:
        none = F.lit(0).cast("bigint")
        return [F.coalesce(F.sum(weight), none).alias("n")] + [
            F.coalesce(F.sum(F.when(cells[c], F.col(weight))), none).alias(c) for c in COUNTS]
    return [F.count(F.lit(1)).alias("n")] + [F.count_if(cells[c]).alias(c) for c in COUNTS]


def ratio_or_zero(num, den) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def base_metric(name) -> Column:
    """One of the nine base metrics as an expression over the four counts."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    parts = {
        "accuracy_score": (tp + tn, tp + fp + fn + tn),
        "precision_score": (tp, tp + fp),
        "recall_score": (tp, tp + fn),
        "f1_score": (2 * tp, 2 * tp + fp + fn),
        "selection_rate": (tp + fp, tp + fp + fn + tn),
        "true_positive_rate": (tp, tp + fn),
        "false_positive_rate": (fp, fp + tn),
        "true_negative_rate": (tn, fp + tn),
        "false_negative_rate": (fn, tp + fn),
    }
    return ratio_or_zero(*parts[name])


def aggregate_groups(aggregation, low, high) -> Column:
    """Between-group value of a custom rule from the lowest and highest group."""
    return F.when(
        aggregation == "min_ratio", F.when(high > 0, low / high).otherwise(F.lit(1.0))
    ).when(aggregation == "max_difference", high - low)


def meets(value, comparison, threshold) -> Column:
    """Whether ``value comparison threshold`` holds; undefined values do not."""
    outcome = (
        F.when(comparison == ">=", value >= threshold)
        .when(comparison == "<=", value <= threshold)
        .when(comparison == ">", value > threshold)
        .when(comparison == "<", value < threshold)
        .when(comparison == "==", value == threshold)
    )
    return F.coalesce(outcome, F.lit(False))
