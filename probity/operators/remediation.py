"""Remediation steps for failed checks and the checklists made of them.

The steps of a suite and principle are built as one array: there is one latest
result per metric, so the array has as many steps as a validation has metrics.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.messages import first_of, fixed, say
from probity.operators.trace import latest_results, suite_validations

NAMED_COLUMNS = 5
FAILED = "array<struct<result_no:bigint,metric_name:string,metric_value:double,threshold:double>>"
STEPS = "array<struct<id:string,text:string,link:string,done:boolean>>"

# Closing step and help link per principle.
RERUN = {
    "fairness": ("fair-revalidate", "Re-run fairness validation to confirm all fairness metrics pass."),
    "privacy": ("priv-revalidate", "Re-run privacy validation to verify all privacy checks pass."),
    "transparency": ("trans-revalidate", "Re-run transparency validation after remediation updates."),
}
LINKS = {p: f"/knowledge-base#{p}" for p in RERUN}


def _step(step_id, text, link):
    return F.struct(
        (F.lit(step_id) if isinstance(step_id, str) else step_id).alias("id"),
        (F.lit(text) if isinstance(text, str) else text).alias("text"),
        F.lit(link).alias("link"), F.lit(False).alias("done"))


def _failed_metrics(results):
    """The failed latest results of each validation in result order."""
    latest = latest_results(results.select(
        "validation_id", "metric_name", "result_no", "metric_value", "threshold", "passed"))
    item = F.struct("result_no", "metric_name", "metric_value", "threshold")
    return latest.where(~F.col("passed")).groupBy("validation_id").agg(
        F.array_sort(F.collect_list(item)).alias("failed"))


def _metric_steps(prefix, opening, ending, link):
    return F.transform("failed", lambda f: _step(
        F.concat(F.lit(f"{prefix}-"), f["metric_name"]),
        say(opening, f["metric_name"], "' (value=", fixed(f["metric_value"]), ", threshold=", fixed(f["threshold"]), "); ", ending),
        link))


def _fairness():
    return _metric_steps(
        "fair", "Fix failed fairness metric '", "apply bias mitigation and reassess group impacts.", LINKS["fairness"])


def _transparency():
    none = F.array().cast(STEPS)
    metrics = _metric_steps(
        "trans", "Fix transparency metric '", "improve explainability artifacts/model-card quality.", LINKS["transparency"])
    warning = F.when(F.coalesce("facts.warning", F.lit("")) != "", F.array(_step(
        "trans-warning", say("Address transparency warning: ", F.col("facts.warning")), LINKS["transparency"])))
    return F.concat(F.coalesce(metrics, none), F.coalesce(warning, none))


def _privacy(kinds, named):
    """Steps from the privacy report; what the report doesn't hold is left out."""
    facts, link = F.col("facts"), LINKS["privacy"]
    k, l = facts["k_anonymity"], facts["l_diversity"]  # noqa: E741

    def part(struct, name):
        return facts[struct][name] if name in kinds[struct].fieldNames() else F.lit(None).cast("double")

    def missed(struct, flag):
        return facts[struct].isNotNull() & ~F.coalesce(facts[struct][flag], F.lit(False))

    offers = [
        F.when(F.size(facts["pii_detected"]) > 0, _step("priv-pii", say(
            "Mask/remove detected PII columns: ", F.array_join(first_of(facts["pii_detected"], named), ", "), "."), link)),
        F.when(missed("k_anonymity", "satisfies_k"), _step("priv-k-anonymity", say(
            "Increase k-anonymity: actual min k=", fixed(part("k_anonymity", "actual_min_k"), 0), ", required k=",
            fixed(k["k_value"], 0), "."), link)),
        F.when(missed("l_diversity", "satisfies_l"), _step("priv-l-diversity", say(
            "Increase l-diversity: actual min l=", fixed(part("l_diversity", "actual_min_l"), 0), ", required l=",
            fixed(l["l_value"], 0), "."), link)),
    ]
    if "differential_privacy" in kinds:
        dp = facts["differential_privacy"]
        offers.append(F.when(missed("differential_privacy", "budget_satisfied"), _step("priv-dp", say(
            "Mitigate DP budget issue: measured ε=", fixed(dp["measured_epsilon"], 4), " exceeds target ε=",
            fixed(dp["target_epsilon"], 4), "."), link)))
    names = F.lit("")
    if "failed_identifiers" in kinds["hipaa"].fieldNames():
        listed = first_of(facts["hipaa"]["failed_identifiers"], named)
        names = F.when(F.size(listed) > 0, say(" Failed checks: ", F.array_join(listed, ", "), ".")).otherwise("")
    offers.append(F.when(missed("hipaa", "overall_passed"), _step("priv-hipaa", say(
        "Resolve HIPAA Safe Harbor violations by de-identifying flagged identifiers.", names), link)))
    return F.array_compact(F.array(*offers))


def step_lists(suites, results, artifacts, principles=None, named=NAMED_COLUMNS) -> DataFrame:
    """(suite, principle, steps) of the principles asked for; a suite without failures has none.

    Suites, results and artifacts are read once for all principles. ``artifacts`` is as in
    ``reports.sections``, with measured values if there are any; the first ``named`` columns
    or identifiers are listed in a text (all with None).
    """
    wanted = [p for p in RERUN if p in set(principles or RERUN)]
    if not wanted:
        raise ValueError(f"choose principles from {list(RERUN)}")
    kinds = {f.name: f.dataType for f in artifacts.schema["facts"].dataType.fields}
    slots = suite_validations(suites).where(F.col("principle").isin(*wanted)).select("suite_id", "principle", "validation_id")
    if wanted == ["privacy"]:
        joined = slots.withColumn("failed", F.lit(None).cast(FAILED))
    else:
        joined = slots.join(_failed_metrics(results), "validation_id", "left")
    if wanted == ["fairness"]:
        joined = joined.withColumn("facts", F.lit(None).cast(artifacts.schema["facts"].dataType))
    else:
        joined = joined.join(artifacts.select(F.col("run_id").alias("validation_id"), "facts"), "validation_id", "left")
    builders = {"fairness": _fairness, "privacy": lambda: _privacy(kinds, named), "transparency": lambda: _transparency()}
    steps, closing = F.lit(None).cast(STEPS), F.lit(None).cast(STEPS)
    for p in wanted:
        step_id, text = RERUN[p]
        steps = F.when(F.col("principle") == p, builders[p]().cast(STEPS)).otherwise(steps)
        closing = F.when(F.col("principle") == p, F.array(_step(step_id, text, LINKS[p])).cast(STEPS)).otherwise(closing)
    # Exploding an array of one makes the steps be built once, not again in the filter.
    known = F.explode(F.array(F.coalesce(steps, F.array().cast(STEPS))))
    return joined.select("suite_id", "principle", known.alias("steps")).where(F.size("steps") > 0).withColumn(
        "steps", F.concat("steps", closing))


def numbered_steps(lists) -> DataFrame:
    """One row per step, numbered from 1 per suite and principle."""
    rows = lists.select("suite_id", "principle", F.posexplode("steps").alias("position", "step"))
    return rows.select(
        "suite_id", "principle", (F.col("position") + 1).alias("number"), F.col("step.id").alias("step_id"), "step.text", "step.link")


def checklists(lists, user_id) -> DataFrame:
    """The step lists as a user's checklists."""
    return lists.select(F.lit(user_id).alias("user_id"), "suite_id", "principle", "steps")


def refresh_checklists(existing, fresh, refreshed) -> DataFrame:
    """Fresh checklists replace a user's own for the ``refreshed`` (user_id, suite_id).

    A refreshed suite keeps no list of a principle without steps left, also if it has none at all.
    """
    covered = refreshed.select("user_id", "suite_id").distinct()
    untouched = existing.join(covered, ["user_id", "suite_id"], "left_anti")
    old = existing.select("user_id", "suite_id", "principle", F.lit(True).alias("existed"))
    renewed = fresh.join(old, ["user_id", "suite_id", "principle"], "left").withColumn(
        "change", F.when(F.col("existed"), "replaced").otherwise("inserted")).drop("existed")
    return renewed.unionByName(untouched.withColumn("change", F.lit("kept")))


def set_step(lists, step_id, done=True) -> DataFrame:
    """Marks the named step of every checklist."""
    return lists.withColumn("steps", F.transform("steps", lambda s: F.when(
        s["id"] == step_id, s.withField("done", F.lit(done))).otherwise(s)))


def with_all_done(lists) -> DataFrame:
    return lists.withColumn("all_done", F.forall("steps", lambda s: s["done"]))
