"""Texts of causes, advice and behaviour as Column expressions."""

from pyspark.sql import functions as F

UNKNOWN_SENSITIVE = "unknown attribute"
SOME_SENSITIVE = "the sensitive attribute"


def fixed(column, digits=3):
    """A number with fixed decimals, N/A when missing."""
    return F.when(column.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", column.cast("double")))


def plain(column):
    return F.coalesce(column.cast("string"), F.lit("None"))


def say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def first_of(array, count):
    """The first entries of an array, all of them without a count."""
    return F.slice(array, 1, count) if count is not None else F.col(array) if isinstance(array, str) else array


def has(column, *words):
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(column), F.lit(w))
    return found


# Fixed formats: the sentences below are compared word for word by users.

def root_cause(principle, metric, value, threshold, sensitive):
    """Why a failed result failed."""
    who = F.coalesce(sensitive, F.lit(UNKNOWN_SENSITIVE))
    measured = say("Metric ", metric, " = ", fixed(value), " vs threshold ", fixed(threshold), ".")
    fairness = (
        F.when(has(metric, "parity", "impact"), say(
            "The model's selection/approval rate differs across groups defined by '", who, "'. ", measured,
            " This indicates unequal treatment of demographic groups."))
        .when(has(metric, "opportunity"), say(
            "True positive rates differ across groups defined by '", who, "'. ", measured,
            " The model is better at correctly identifying positive outcomes for some groups."))
        .when(has(metric, "odds"), say(
            "Error rates (both false positives and false negatives) differ across groups defined by '", who, "'. ",
            measured))
        .otherwise(say("Fairness metric '", metric, "' failed: value ", plain(value), " vs threshold ", plain(threshold), "."))
    )
    privacy = (
        F.when(has(metric, "pii"), "Personally Identifiable Information (PII) was detected in the dataset.")
        .when(has(metric, "anonymity"), say(
            "k-Anonymity check failed: some groups have fewer than ", plain(threshold),
            " identical records, making individuals potentially identifiable."))
        .when(has(metric, "diversity"), say(
            "l-Diversity check failed: some equivalence classes have fewer than ", plain(threshold),
            " distinct sensitive values, risking attribute disclosure."))
        .otherwise(say("Privacy metric '", metric, "' failed."))
    )
    transparency = say(
        "Explainability metric '", metric, "' = ", plain(value), ". The model may not be sufficiently interpretable.")
    other = say("Metric '", metric, "' failed: value ", plain(value), " vs threshold ", plain(threshold), ".")
    return _by_principle(principle, fairness, privacy, transparency, other)


def advice(principle, metric, sensitive):
    """What to do about a failed result."""
    who = F.coalesce(sensitive, F.lit(SOME_SENSITIVE))
    fairness = (
        F.when(has(metric, "parity", "impact"), say(
            "Consider applying fairness constraints (e.g., reweighing, threshold adjustment) targeting '", who,
            "' to achieve demographic parity."))
        .when(has(metric, "opportunity"), say(
            "Retrain the model with equalized-opportunity constraints on '", who,
            "' to balance true positive rates across groups."))
        .when(has(metric, "odds"), say(
            "Apply calibration or post-processing to equalize error rates across groups defined by '", who, "'."))
        .otherwise(say("Review and address fairness for metric '", metric, "'."))
    )
    privacy = (
        F.when(has(metric, "pii"), "Remove or anonymize columns containing PII before deploying the model.")
        .when(has(metric, "anonymity"), "Generalize or suppress quasi-identifier columns to increase k-anonymity.")
        .when(has(metric, "diversity"), "Apply data perturbation or generalization to improve l-diversity.")
        .otherwise(say("Address privacy concern for metric '", metric, "'."))
    )
    transparency = F.lit(
        "Consider using a simpler, more interpretable model or adding SHAP/LIME explanation layers to improve transparency.")
    other = say("Investigate and remediate the failure in metric '", metric, "'.")
    return _by_principle(principle, fairness, privacy, transparency, other)


def behaviour(principle, metric, value, passed):
    """What a result says about the model; null without a value."""
    shown = say(metric, ": ", fixed(value), " — ")
    outcome = F.when(passed, "passed.").otherwise("failed.")
    fairness = (
        F.when(has(metric, "parity", "impact"), F.when(passed, say(shown, "model shows acceptable group parity."))
               .otherwise(say(shown, "model exhibits disparity between demographic groups.")))
        .when(has(metric, "opportunity", "odds"), F.when(passed, say(shown, "model errors are balanced across groups."))
              .otherwise(say(shown, "model error rates differ significantly across groups.")))
        .otherwise(say(shown, outcome))
    )
    privacy = F.when(passed, say(metric, ": privacy check passed.")).otherwise(
        say(metric, ": privacy risk detected (value=", plain(value), ")."))
    transparency = say(metric, ": explainability metric ", fixed(value), ".")
    other = say(metric, ": ", plain(value), " — ", outcome)
    return F.when(value.isNotNull(), _by_principle(principle, fairness, privacy, transparency, other))


def _by_principle(principle, fairness, privacy, transparency, other):
    return (
        F.when(principle == "fairness", fairness).when(principle == "privacy", privacy)
        .when(principle == "transparency", transparency).otherwise(other)
    )
