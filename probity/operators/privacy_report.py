"""The privacy audit of one dataset: checks, advice, metric rows and risk."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions import constants as C
from probity.functions.checks import datetime_columns, numeric_columns, string_columns
from probity.operators import anonymity, anonymize, hipaa, noise, pii

CHECK_SCHEMA = "check string, passed boolean, measured double, required double, failed_count bigint, detail string"
LOW_K = 3
RISK_HIGH, RISK_MEDIUM = 70, 30


def _check(row, name, passed, measured=None, required=None, failed=None, detail=None):
    none = F.lit(None)
    return row.select(
        F.lit(name).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        (none if measured is None else measured).cast("double").alias("measured"),
        (none if required is None else F.lit(required)).cast("double").alias("required"),
        (none if failed is None else failed).cast("bigint").alias("failed_count"),
        (none if detail is None else detail).cast("string").alias("detail"),
    )


def _failure(spark, name, reason):
    return spark.createDataFrame([(name, False, None, None, None, reason)], CHECK_SCHEMA)


def privacy_checks(df, order_by, requirements) -> DataFrame:
    """One row per check asked for.

    ``requirements`` may hold ``pii_detection`` (on unless False),
    ``custom_pii_patterns``, ``custom_pii_column_names``, ``k_anonymity``
    {k, quasi_identifiers}, ``k_anonymity_configs`` [..], ``l_diversity``
    {l, quasi_identifiers, sensitive_attribute}, ``differential_privacy``
    {quasi_identifiers, target_epsilon} and ``hipaa``. A check with wrong
    arguments fails with the reason in ``detail``; personal-data detection that
    cannot run is a warning and does not fail the audit.
    """
    spark = df.sparkSession
    parts = []

    def attempt(name, build, warn_only=False):
        try:
            parts.append(build())
        except (KeyError, ValueError) as exc:
            reason = f"missing {exc}" if isinstance(exc, KeyError) else str(exc)
            row = _failure(spark, name, reason)
            parts.append(row.withColumn("passed", F.lit(True)) if warn_only else row)

    def pii_check():
        report = pii.pii_report(
            df, order_by, custom_patterns=requirements.get("custom_pii_patterns"),
            custom_tokens=requirements.get("custom_pii_column_names"))
        found = report.agg(F.count_if("is_pii").alias("n"))
        return _check(found, "pii_detection", F.col("n") == 0, F.col("n"), 0, F.col("n"))

    def k_check():
        wanted = requirements["k_anonymity"]
        row = anonymity.k_anonymity(df, wanted["quasi_identifiers"], wanted["k"])
        return _check(row, "k_anonymity", F.col("satisfies_k"), F.col("actual_min_k"), wanted["k"],
                      F.col("violating_groups"), F.col("error"))

    def k_configs_check():
        configs = [(c["quasi_identifiers"], c["k"]) for c in requirements["k_anonymity_configs"]]
        rows = anonymity.k_anonymity_configs(df, configs)
        return rows.select(
            F.concat(F.lit("k_anonymity_config_"), (F.col("position") + 1).cast("string")).alias("check"),
            F.col("satisfies_k").alias("passed"), F.col("actual_min_k").cast("double").alias("measured"),
            F.col("k_value").cast("double").alias("required"), F.col("violating_groups").alias("failed_count"),
            F.col("quasi_identifiers").alias("detail"))

    def l_check():
        wanted = requirements["l_diversity"]
        row = anonymity.l_diversity(df, wanted["quasi_identifiers"], wanted["sensitive_attribute"], wanted["l"])
        return _check(row, "l_diversity", F.col("satisfies_l"), F.col("actual_min_l"), wanted["l"],
                      F.col("violating_groups"), F.col("error"))

    def dp_check():
        wanted = requirements["differential_privacy"]
        target = float(wanted.get("target_epsilon", 1.0))
        row = noise.privacy_budget(df, wanted["quasi_identifiers"], target)
        return _check(row, "differential_privacy", F.col("budget_satisfied"), F.col("measured_epsilon"), target)

    def hipaa_check():
        row = hipaa.hipaa_verdict(hipaa.hipaa_report(df))
        return _check(row, "hipaa", F.col("overall_passed"), F.col("passed_checks"), len(C.HIPAA_IDENTIFIERS),
                      F.col("failed_checks"))

    if requirements.get("pii_detection", True):
        attempt("pii_detection", pii_check, warn_only=True)
    for key, build in (
        ("k_anonymity", k_check), ("k_anonymity_configs", k_configs_check),
        ("l_diversity", l_check), ("differential_privacy", dp_check),
    ):
        if key in requirements:
            attempt(key, build)
    if requirements.get("hipaa"):
        attempt("hipaa", hipaa_check)
    if not parts:
        return spark.createDataFrame([], CHECK_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def privacy_verdict(checks) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if("passed").alias("checks_passed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("overall_passed"),
    )


def _risk_parts():
    """Aggregates: checks that count, and the weight of the failed ones."""
    counted = ~F.col("check").startswith("k_anonymity_config")
    low = (F.col("check") == "k_anonymity") & (F.col("measured") < LOW_K)
    failed = F.when(~F.col("passed"), 1.0).otherwise(0.0) + F.when(low, 0.5).otherwise(0.0)
    return F.count_if(counted), F.sum(F.when(counted, failed))


def _risk(total, failed):
    share = F.coalesce(F.try_divide(failed, F.col(total)), F.lit(0.0))
    return F.least(F.lit(100.0), F.floor(share * 100)).cast("double")


def risk_score(checks) -> DataFrame:
    """0 to 100 by the share of failed checks; groups below 3 rows weigh half a failure more."""
    total, failed = _risk_parts()
    totals = checks.agg(total.alias("total"), failed.alias("failed"))
    return totals.select(_risk("total", "failed").alias("risk_score")).withColumn(
        "risk_level",
        F.when(F.col("risk_score") >= RISK_HIGH, "High").when(F.col("risk_score") >= RISK_MEDIUM, "Medium").otherwise("Low"),
    )


def metric_rows(checks) -> DataFrame:
    """(metric, value) rows as they are logged for a privacy run."""
    flag = F.when(F.col("passed"), 1.0).otherwise(0.0)

    def row(metric, value):
        return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    nothing = F.array().cast("array<struct<metric:string,value:double>>")
    per_check = (
        F.when(F.col("check") == "pii_detection", F.array(row("pii_detected_count", F.col("measured"))))
        .when(F.col("check") == "k_anonymity", F.array(row("k_anonymity_satisfied", flag)))
        .when(F.col("check") == "l_diversity", F.array(row("l_diversity_satisfied", flag)))
        .when(F.col("check") == "differential_privacy", F.array(
            row("dp_measured_epsilon", F.col("measured")), row("dp_budget_satisfied", flag)))
        .when(F.col("check") == "hipaa", F.array(
            row("hipaa_passed", flag), row("hipaa_checks_passed", F.col("measured"))))
        .otherwise(nothing)
    )
    # A handful of rows per audit: gathered into one row, the checks run once.
    total, failed = _risk_parts()
    gathered = checks.agg(
        F.flatten(F.collect_list(per_check)).alias("rows"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"),
        total.alias("total"), failed.alias("failed"))
    overall = row("overall_passed", F.when(F.col("all_passed"), 1.0).otherwise(0.0))
    return gathered.select(F.inline(F.concat("rows", F.array(overall, row("privacy_risk_score", _risk("total", "failed"))))))


# Extra advice per kind of personal data.
PII_ADVICE = {
    "email": "  → Consider masking: john@email.com -> j***@***.com",
    "phone_us": "  → Consider masking last 4 digits: 555-123-4567 -> 555-123-****",
    "ssn": "  → CRITICAL: Remove this column immediately or use tokenization",
    "credit_card": "  → CRITICAL: Remove this column immediately or use tokenization",
}


def pii_recommendations(report) -> DataFrame:
    """Lines of advice (column, position, line) for the flagged columns."""
    more = F.create_map(*[F.lit(x) for item in PII_ADVICE.items() for x in item])
    first = F.format_string(
        "Column '%s': Remove or anonymize (%s, confidence: %.0f%%)", "column_name", "pii_type", F.col("confidence") * 100)
    lines = F.array_compact(F.array(first, F.try_element_at(more, F.col("pii_type"))))
    return report.where("is_pii").select("column_name", F.posexplode(lines).alias("position", "line"))


def check_recommendations(df, checks, requirements) -> DataFrame:
    """Lines of advice (check, position, line) for the failed group checks."""
    wanted_k, wanted_l = requirements.get("k_anonymity"), requirements.get("l_diversity")
    out = checks.sparkSession.createDataFrame([], "check string, position int, line string")
    failed = checks.where(~F.col("passed") & F.col("measured").isNotNull())
    if wanted_k:
        qis = list(wanted_k["quasi_identifiers"])
        lines = F.array(
            F.format_string("Dataset fails %.0f-anonymity (minimum group size: %.0f, violating groups: %d)",
                            "required", "measured", "failed_count"),
            F.lit(f"  → Consider generalizing these columns: {', '.join(qis)}"),
        )
        out = out.unionByName(failed.where("check = 'k_anonymity'").select(
            "check", F.posexplode(lines).alias("position", "line")))
        advice = anonymize.generalisation_advice(df, qis).where("position = 0")
        order = F.create_map(*[F.lit(x) for i, c in enumerate(qis) for x in (c, i + 2)])
        per_column = advice.select(
            order[F.col("column")].alias("position"),
            F.format_string("  → %s: %s - %s", "column", "method", "description").alias("line"))
        out = out.unionByName(per_column.withColumn("check", F.lit("k_anonymity")).join(failed, "check", "left_semi").select(
            "check", "position", "line"))
    configs = failed.where(F.col("check").startswith("k_anonymity_config_"))
    out = out.unionByName(configs.select("check", F.lit(0).alias("position"), F.format_string(
        "k-anonymity config #%s failed (k=%.0f, min group size=%.0f)",
        F.regexp_extract("check", r"(\d+)$", 1), "required", "measured").alias("line")))
    if wanted_l:
        lines = F.array(
            F.format_string(f"Dataset fails %.0f-diversity for '{wanted_l['sensitive_attribute']}' (minimum diversity: %.0f)",
                            "required", "measured"),
            F.lit("  → Some groups have insufficient diversity in sensitive attribute"),
            F.lit("  → Consider: (1) Further generalizing quasi-identifiers, (2) Suppressing low-diversity groups, "
                  "or (3) Adding synthetic records"),
        )
        out = out.unionByName(failed.where("check = 'l_diversity'").select(
            "check", F.posexplode(lines).alias("position", "line")))
    return out


def preset_requirements(preset, quasi_identifiers, sensitive_attribute=None):
    """The requirements of a preset for the caller's columns."""
    if preset not in C.PRIVACY_PRESETS:
        raise ValueError(f"Unknown template: {preset}")
    limits = C.PRIVACY_PRESETS[preset]
    wanted = {"pii_detection": True, "k_anonymity": {"k": limits["k"], "quasi_identifiers": list(quasi_identifiers)}}
    if "l" in limits:
        wanted["l_diversity"] = {
            "l": limits["l"], "quasi_identifiers": list(quasi_identifiers), "sensitive_attribute": sensitive_attribute}
    return wanted


def privacy_summary(df, order_by, report=None) -> DataFrame:
    """One row of privacy-relevant facts about a dataset."""
    report = pii.pii_report(df, order_by) if report is None else report
    texts = string_columns(df)
    missing = [(F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))) for c in df.columns]
    facts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*missing).alias("missing"))
    total = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    unique = F.lit(0)
    if texts:
        high = pii.distinct_counts(pii.text_values(df, texts)).where(F.col("unique_count") / total > C.PII_UNIQUE_RATIO)
        unique = high.agg(F.count(F.lit(1)).alias("n")).scalar()
    flagged = report.agg(F.count_if("is_pii").alias("n")).scalar()
    return facts.select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), flagged.alias("pii_count"),
        unique.alias("high_cardinality_columns"),
        F.size(F.filter("missing", lambda m: m > 0)).alias("columns_with_missing_values"),
        F.aggregate("missing", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("missing_value_count"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(texts)).alias("categorical_columns"),
        F.lit(len(datetime_columns(df))).alias("datetime_columns"),
    )
