"""Requirements suggested by a dataset or by a model's predictions."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions import constants as C
from probity.functions.checks import numeric_columns, string_columns
from probity.functions.ordering import rank_unique
from probity.operators.pii import normalise_name
from probity.operators.prep import encode_first_appearance

PROXY_CORRELATION = 0.5
PROXY_ROWS = 10
CHECK_SCHEMA = "position int, check_id string, status string, value double, threshold double, reason string, metadata string"


def mode_limits(mode):
    return C.ELICITATION_MODES.get(mode, C.ELICITATION_MODES["normal"])


def default_specification(principle):
    """The default rules of a principle as JSON text."""
    rules = ", ".join(f'{{"metric":"{m}","operator":"{o}","value":{v}}}' for m, o, v in C.DEFAULT_SPECS.get(principle, ()))
    return f'{{"rules":[{rules}]}}'


def pii_name_columns(columns):
    return [c for c in columns if any(s in normalise_name(c) for s in C.PII_NAME_SIGNALS)]


def class_counts(df, columns) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def imbalance_ratios(df, columns) -> DataFrame:
    """1 - share of the smallest class per column; 1.0 with fewer than two classes."""
    return _imbalance(class_counts(df, columns))


def _imbalance(counts):
    share = F.min("n").cast("double") / F.sum("n").cast("double")
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("classes"),
        F.when(F.count(F.lit(1)) < 2, F.lit(1.0)).otherwise(1 - share).alias("imbalance"))


def class_moments(df, attributes) -> DataFrame:
    """(column, value, code, n, moments) per class of every attribute, from one pass over the table.

    ``moments`` has for every numeric column its name, the rows of the class that have a value,
    their mean and their population variance. Classes of texts are coded in value order, numbers code themselves.
    """
    numeric = numeric_columns(df)
    pairs = F.array(*[F.struct(
        F.lit(a).alias("column"), F.col(a).cast("string").alias("value"), (F.col(a) if a in numeric else F.lit(None)).cast("double").alias("number"))
        for a in attributes])
    kept = df.select(*[F.col(f"`{c}`").cast("double").alias(f"m{i}") for i, c in enumerate(numeric)], F.inline(pairs)).where("value IS NOT NULL")
    classes = kept.groupBy("column", "value", "number").agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.lit(c).alias("other"), F.count(f"m{i}").alias("rows"), F.avg(f"m{i}").alias("mean"), F.var_pop(f"m{i}").alias("variance")).alias(f"s{i}")
        for i, c in enumerate(numeric)])
    gathered = classes.select("column", "value", "number", "n", (
        F.array(*[f"s{i}" for i in range(len(numeric))]) if numeric else F.array().cast(
            "array<struct<other:string,rows:bigint,mean:double,variance:double>>")).alias("moments"))
    # Attributes follow one another; where each begins doesn't matter to a correlation.
    ranked = rank_unique(gathered, ["column", "value"])
    return ranked.select("column", "value", F.coalesce("number", F.col("code").cast("double")).alias("code"), "n", "moments")


def proxy_matrix(classes) -> DataFrame:
    """(attribute, column, correlation, shared_rows, is_proxy): Pearson correlation of every attribute with every
    numeric column, over rows that have both, put together from the moments of the classes."""
    rows = classes.select(F.col("column").alias("attribute"), "code", F.inline("moments")).where("other <> attribute")
    per_pair = ["attribute", "other"]
    n = F.col("rows").cast("double")
    middle = rows.groupBy(*per_pair).agg(
        (F.sum(n * F.col("code")) / F.sum(n)).alias("x"), (F.sum(n * F.coalesce("mean", F.lit(0.0))) / F.sum(n)).alias("y"))
    # One row per attribute and numeric column.
    placed = rows.join(F.broadcast(middle), per_pair).where("rows > 0")
    dx, dy = F.col("code") - F.col("x"), F.col("mean") - F.col("y")
    sums = placed.groupBy(*per_pair).agg(
        F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * (F.col("variance") + dy * dy)).alias("yy"),
        F.sum("rows").alias("shared_rows"))
    every = middle.select(*per_pair).join(F.broadcast(sums), per_pair, "left")
    strong = (F.col("shared_rows") >= PROXY_ROWS) & (F.abs("correlation") > PROXY_CORRELATION)
    return every.select(
        "attribute", F.col("other").alias("column"), F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("correlation"),
        F.coalesce("shared_rows", F.lit(0).cast("bigint")).alias("shared_rows")).withColumn("is_proxy", F.coalesce(strong, F.lit(False)))


def proxy_correlations(df, sensitive) -> DataFrame:
    """Pearson correlation of each numeric column with the (coded) sensitive column, over rows that have both."""
    return proxy_matrix(class_moments(df, [sensitive])).select("column", "correlation", "shared_rows", "is_proxy")


def _literal(spark, position, check_id, status, value=None, threshold=None, reason="", metadata=None):
    return spark.createDataFrame([(
        position, check_id, status, None if value is None else float(value),
        None if threshold is None else float(threshold), reason, json.dumps(metadata or {}, separators=(",", ":")))], CHECK_SCHEMA)


def _count_check(spark, position, check_id, count, limit, what):
    over = count > limit
    verb = "exceeded" if over else "is within"
    return _literal(spark, position, check_id, "triggered" if over else "not_triggered", count, limit,
                    f"{what} {count} {verb} threshold {limit}.")


def _limit_check(rows, position, check_id, value, threshold, over, over_reason, within_reason, skip=None, skip_reason=None, metadata=None):
    status = F.when(over, "triggered").otherwise("not_triggered")
    reason = F.when(over, over_reason).otherwise(within_reason)
    shown, limit = F.round(value, 4), F.lit(float(threshold))
    if skip is not None:
        status, reason = F.when(skip, "skipped").otherwise(status), F.when(skip, skip_reason).otherwise(reason)
        shown, limit = F.when(~skip, shown), F.when(~skip, limit)
    return rows.select(
        position.alias("position"), check_id.alias("check_id"), status.alias("status"), shown.alias("value"),
        limit.alias("threshold"), reason.alias("reason"), (F.lit("{}") if metadata is None else metadata).alias("metadata"))


def dataset_checks(df, sensitive_attributes=(), mode=None, most_attributes=None) -> DataFrame:
    """The elicitation checks of a dataset in order."""
    spark, limits = df.sparkSession, mode_limits(mode)
    pii = pii_name_columns(df.columns)
    out = _literal(
        spark, 0, "dataset_pii_detection", "triggered" if pii else "not_triggered", len(pii), None,
        f"Detected potential PII columns: {', '.join(pii)}" if pii else "No PII-like column names detected.",
        {"pii_columns": pii} if pii else None)
    chosen = list(sensitive_attributes)[:most_attributes]
    if not chosen:
        out = out.unionByName(_literal(
            spark, 1, "dataset_sensitive_attributes_available", "skipped",
            reason="Dataset has no configured sensitive attributes."))
    present = [a for a in chosen if a in df.columns]
    for i, a in enumerate(chosen):
        if a not in present:
            out = out.unionByName(_literal(
                spark, 1 + i, f"dataset_sensitive_attr_{a}", "skipped",
                reason=f"Sensitive attribute '{a}' is not present in dataset columns."))
    if present:
        limit = limits["imbalance_threshold"]
        order = F.create_map(*[F.lit(x) for i, a in enumerate(chosen) for x in (a, 1 + i)])
        value = F.col("imbalance")
        # An attribute without any value still gets its row, as wholly imbalanced.
        listed = spark.createDataFrame([(a,) for a in present], "column string")
        classes = class_moments(df, present)
        place = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
        # Both readings of the classes are small: one row per attribute.
        proxies = proxy_matrix(classes).where("is_proxy").groupBy(F.col("attribute").alias("column")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct(place[F.col("column")].alias("i"), F.col("column").alias("c")))), lambda x: x["c"]).alias("proxies"))
        ratios = listed.join(_imbalance(classes), "column", "left").join(F.broadcast(proxies), "column", "left").withColumns({
            "imbalance": F.coalesce("imbalance", F.lit(1.0)), "proxies": F.coalesce("proxies", F.array().cast("array<string>"))})
        over = value > limit
        also = F.when(F.size("proxies") > 0, F.concat(F.lit(" Columns that may stand in for it: "), F.array_join("proxies", ", "), F.lit("."))).otherwise("")
        out = out.unionByName(_limit_check(
            ratios, order[F.col("column")], F.concat(F.lit("dataset_imbalance_"), "column"), value, limit, over,
            F.concat(F.format_string(f"Imbalance %.2f exceeded threshold {limit:.2f} for '%s'.", value, "column"), also),
            F.format_string(f"Imbalance %.2f is within threshold {limit:.2f} for '%s'.", value, "column"),
            metadata=F.when(over, F.to_json(F.struct(F.col("proxies").alias("proxy_variables")))).otherwise("{}")))
    out = out.unionByName(_count_check(
        spark, 4, "dataset_feature_count", len(df.columns), limits["dataset_feature_count_threshold"], "Feature count"))
    return out.unionByName(_literal(
        spark, 5, "dataset_accountability_baseline", "triggered",
        reason="Baseline accountability recommendation is always added."))


def dataset_suggestions(checks, dataset_name) -> DataFrame:
    """One draft requirement per triggered dataset check, with a description and the principle's rules; the columns that
    look personal are added to the specification."""
    kind = F.col("check_id")
    pii = kind == "dataset_pii_detection"
    attribute = F.regexp_replace(kind, "^dataset_imbalance_", "")
    imbalance = kind.startswith("dataset_imbalance_")
    many = kind == "dataset_feature_count"
    whole = F.col("value").cast("int").cast("string")
    told = F.from_json("metadata", "pii_columns array<string>, proxy_variables array<string>")
    proxies = told["proxy_variables"]
    rows = checks.where("status = 'triggered'").select(
        "position", "check_id",
        F.when(pii, "privacy").when(imbalance, "fairness").when(many, "transparency").otherwise("accountability").alias("principle"),
        F.when(pii, F.lit(f"Privacy Protection — {dataset_name}"))
        .when(imbalance, F.concat(F.lit("Fairness — Demographic Parity on '"), attribute, F.lit("'")))
        .when(many, F.concat(F.lit("Transparency — Explainability for "), whole, F.lit("-Feature Model")))
        .otherwise(F.lit(f"Accountability — Audit Trail for '{dataset_name}'")).alias("name"),
        F.when(pii, F.concat(whole, F.lit(" column(s) look personal: "), F.array_join(told["pii_columns"], ", "), F.lit(
            ". Train only on data without them in which every row shares its quasi-identifiers with four others.")))
        .when(imbalance, F.concat(
            F.lit("The groups of '"), attribute, F.lit("' are uneven (imbalance "), F.format_string("%.1f%%", F.col("value") * 100),
            F.lit("). Selection and error rates must stay within four fifths of each other."),
            F.when(F.size(proxies) > 0, F.concat(F.lit(" Also watch "), F.array_join(proxies, ", "), F.lit("."))).otherwise("")))
        .when(many, F.concat(whole, F.lit(" columns make a model hard to follow: explain it as a whole and row by row, and keep a model card.")))
        .otherwise(F.lit("Every validation leaves a record of the model, the data, the measured values and the outcome.")).alias("description"),
        F.col("reason").alias("elicitation_reason"),
        _confidence(F.when(pii, 0.90).when(imbalance, F.least(F.lit(0.95), 0.60 + F.col("value"))).when(many, 0.80).otherwise(1.0)).alias("confidence_score"),
        F.when(pii, F.to_json(F.struct(told["pii_columns"].alias("pii_columns")))).alias("_more"),
    )
    return _finish(rows)


def _confidence(value):
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)


def _finish(rows):
    specs = F.create_map(*[F.lit(x) for p in C.PRINCIPLES for x in (p, default_specification(p))])
    # Further fields are put in before the specification's closing brace.
    whole = specs[F.col("principle")]
    added = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(","), F.substring("_more", F.lit(2), F.length("_more")))
    return rows.withColumns({
        "specification": F.coalesce(added, whole), "elicited_automatically": F.lit(True), "status": F.lit("draft")}).drop("_more")


def prediction_imbalance(scored, prediction="prediction") -> DataFrame:
    """Number of predicted classes and the gap between the largest and smallest share."""
    counts = scored.where(F.col(prediction).isNotNull()).groupBy(prediction).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("classes"),
        ((F.max("n") - F.min("n")).cast("double") / F.sum("n").cast("double")).alias("imbalance"))


def attribute_rates(scored, attributes, prediction="prediction") -> DataFrame:
    """Mean prediction per attribute and group, all attributes in one pass."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes])
    return scored.select(F.col(prediction).cast("double").alias("p"), F.inline(pairs)).where("group IS NOT NULL").groupBy(
        "attribute", "group").agg(F.avg("p").alias("rate"))


def disparate_impacts(rates) -> DataFrame:
    """Lowest over highest group rate per attribute, with the two groups; 1.0 when nobody is selected."""
    order = F.struct("rate", "group")
    return rates.groupBy("attribute").agg(
        F.count("rate").alias("groups"),
        F.when(F.max("rate") > 0, F.min("rate") / F.max("rate")).otherwise(F.lit(1.0)).alias("disparate_impact"),
        F.min(order).alias("lowest"), F.max(order).alias("highest"))


def model_checks(scored, features, sensitive_attributes=(), mode=None, prediction="prediction", most_attributes=None) -> DataFrame:
    """The elicitation checks of a model's predictions in order."""
    spark, limits = scored.sparkSession, mode_limits(mode)
    gap_limit, impact_limit = limits["prediction_imbalance_threshold"], limits["disparate_impact_threshold"]
    gap = F.col("imbalance")
    out = _limit_check(
        prediction_imbalance(scored, prediction), F.lit(0), F.lit("model_prediction_imbalance"), gap, gap_limit, gap > gap_limit,
        F.format_string(f"Prediction imbalance %.2f exceeded threshold {gap_limit:.2f}.", gap),
        F.format_string(f"Prediction imbalance %.2f is within threshold {gap_limit:.2f}.", gap),
        F.col("classes") < 2, "Predictions contain fewer than 2 classes, imbalance check skipped.")
    chosen = list(sensitive_attributes)[:most_attributes]
    present = [a for a in chosen if a in scored.columns]
    for i, a in enumerate(chosen):
        if a not in present:
            out = out.unionByName(_literal(
                spark, 1 + i, f"model_disparate_impact_{a}", "skipped", reason=f"Sensitive attribute '{a}' not found in dataset."))
    if present:
        order = F.create_map(*[F.lit(x) for i, a in enumerate(chosen) for x in (a, 1 + i)])
        # Attributes with a single group are passed over.
        impacts = disparate_impacts(attribute_rates(scored, present, prediction)).where("groups >= 2")
        value = F.col("disparate_impact")
        out = out.unionByName(_limit_check(
            impacts, order[F.col("attribute")], F.concat(F.lit("model_disparate_impact_"), "attribute"), value, impact_limit,
            value < impact_limit,
            F.format_string(f"Disparate impact %.3f is below threshold {impact_limit:.2f} for '%s'.", value, "attribute"),
            F.format_string(f"Disparate impact %.3f is within threshold {impact_limit:.2f} for '%s'.", value, "attribute"),
            metadata=F.to_json(F.struct(
                "groups", *[F.struct(F.col(f"{side}.group").alias("group"), F.round(F.col(f"{side}.rate"), 4).alias("rate")).alias(side)
                            for side in ("lowest", "highest")]))))
    count, limit = len(features), limits["model_feature_count_threshold"]
    verb = "exceeding" if count > limit else "within"
    out = out.unionByName(_literal(
        spark, 4, "model_feature_count", "triggered" if count > limit else "not_triggered", count, limit,
        f"Model inference used {count} features, {verb} threshold {limit}."))
    triggered = out.where("status = 'triggered'").agg(F.count(F.lit(1)).alias("n"))
    baseline = triggered.where("n = 0").select(
        F.lit(5).alias("position"), F.lit("model_baseline_monitoring").alias("check_id"), F.lit("triggered").alias("status"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"),
        F.lit("No high-risk checks triggered; baseline monitoring recommendation added.").alias("reason"), F.lit("{}").alias("metadata"))
    return out.unionByName(baseline)


#: What a suggestion of baseline monitoring asks for in place of the principle's rules.
BASELINE_RULES = ("audit_trail_exists", "mlflow_run_logged")


def model_suggestions(checks) -> DataFrame:
    """One draft requirement per triggered model check, with a description and a specification."""
    kind, value = F.col("check_id"), F.col("value")
    gap, many = kind == "model_prediction_imbalance", kind == "model_feature_count"
    impact = kind.startswith("model_disparate_impact_")
    attribute = F.regexp_replace(kind, "^model_disparate_impact_", "")
    whole = value.cast("int").cast("string")
    side = "struct<group:string,rate:double>"
    told = F.from_json("metadata", f"struct<lowest:{side},highest:{side}>")
    rate = lambda of: F.concat(told[of]["group"], F.format_string(" (%.1f%%)", told[of]["rate"] * 100))
    rows = checks.where("status = 'triggered' AND check_id <> 'model_feature_compatibility'").select(
        "position", "check_id",
        F.when(gap | impact, "fairness").when(many, "transparency").otherwise("accountability").alias("principle"),
        F.when(gap, "Fairness — Prediction Imbalance Detected")
        .when(impact, F.concat(F.lit("Fairness — Disparate Impact on '"), attribute, F.lit("'")))
        .when(many, F.concat(F.lit("Transparency — "), whole, F.lit("-Feature Model Explainability")))
        .otherwise("Baseline Monitoring — No Immediate Model Risks Triggered").alias("name"),
        F.when(gap, F.concat(F.lit("The shares of the predicted classes lie "), F.format_string("%.1f", value * 100),
                             F.lit(" points apart. Check selection and error rates of every group.")))
        .when(impact, F.concat(F.lit("Positive predictions range from "), rate("lowest"), F.lit(" to "), rate("highest"),
                               F.lit(": the lowest rate is "), F.format_string("%.3f", value), F.lit(" of the highest.")))
        .when(many, F.concat(F.lit("The model uses "), whole, F.lit(" features: its decisions need explanations, as a whole and one by one.")))
        .otherwise("Nothing was found at these thresholds. Keep the audit trail and repeat the checks as data change.").alias("description"),
        F.col("reason").alias("elicitation_reason"),
        _confidence(F.when(gap, F.least(F.lit(0.92), 0.65 + value)).when(impact, F.least(F.lit(0.95), 0.80 + (0.80 - value)))
                    .when(many, 0.85).otherwise(0.70)).alias("confidence_score"),
        F.lit(None).cast("string").alias("_more"),
    )
    out = _finish(rows)
    rules = ", ".join(f'{{"metric":"{m}","operator":"==","value":1.0}}' for m in BASELINE_RULES)
    return out.withColumn("specification", F.when(
        F.col("check_id") == "model_baseline_monitoring", f'{{"rules":[{rules}],"elicitation_outcome":"no_risk_triggers"}}').otherwise(F.col("specification")))


def model_elicitation(df, order_by, predict, target=None, sensitive_attributes=(), expected_features=None, mode=None) -> DataFrame:
    """The elicitation checks of a model on raw data, in order.

    Every column but ``target`` and ``order_by`` is a feature. Texts become codes in order of first
    appearance by ``order_by``, missing values 0. A model that expects another number of
    features is refused. ``predict`` adds the column ``prediction`` to the encoded features; groups are
    those of the raw attributes. Without features, or without rows, only that is reported.
    """
    spark = df.sparkSession
    features = [c for c in df.columns if c not in (target, order_by)]
    empty = ("model_feature_matrix_non_empty", "not_triggered")
    if not features:
        return _literal(spark, 0, *empty, reason="No features left after preprocessing.")
    if expected_features is not None and len(features) != expected_features:
        raise ValueError(f"Model and dataset feature mismatch: model expects {expected_features} features, dataset provides {len(features)} features.")
    present = [a for a in sensitive_attributes if a in df.columns]
    raw = df.withColumns({f"_raw_{a}": F.col(a) for a in present}) if present else df
    texts = [f for f in features if f in string_columns(df)]
    encoded = encode_first_appearance(raw, order_by, texts).select(
        order_by, *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features], *[f"_raw_{a}" for a in present])
    scored = predict(encoded).select("prediction", *[F.col(f"_raw_{a}").alias(a) for a in present])
    limit = None if expected_features is None else float(expected_features)
    fits = _literal(spark, 0, "model_feature_compatibility", "triggered", len(features), limit, "Feature compatibility check passed.")
    checks = fits.unionByName(model_checks(scored, features, sensitive_attributes, mode).withColumn("position", F.col("position") + 1))
    rows = df.agg(F.count(F.lit(1)).alias("rows")).select("rows").scalar()
    return checks.where(rows > 0).unionByName(
        _literal(spark, 0, *empty, reason="No features left after preprocessing.").where(rows == 0))


def rule_errors(rules) -> DataFrame:
    """Stored rules (requirement_id, principle, position, metric, operator, value) that cannot be used, and why."""
    supported = F.create_map(*[
        x for p, ms in C.SUPPORTED_RULE_METRICS.items() for x in (F.lit(p), F.array(*[F.lit(m) for m in ms]))])
    known = F.coalesce(F.array_contains(supported[F.col("principle")], F.col("metric")), F.lit(False))
    number = (F.col("position") + 1).cast("string")
    error = (
        F.when(~known, F.concat(
            F.lit("Unsupported metric '"), F.coalesce("metric", F.lit("None")), F.lit("' for principle '"), "principle", F.lit("'")))
        .when(~F.coalesce(F.col("operator").isin(*C.RULE_OPERATORS), F.lit(False)), F.concat(
            F.lit("Unsupported operator '"), F.coalesce("operator", F.lit("None")), F.lit("' in rule #"), number))
        .when(F.col("value").isNull(), F.concat(F.lit("Rule #"), number, F.lit(" is missing a value")))
    )
    return rules.withColumn("error", error).where("error IS NOT NULL")
