"""Requirement templates: listing, baseline rules, use in projects, derived settings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions import constants as C
from probity.functions import template_catalog as catalog

ITEM = "struct<metric:string,operator:string,value:double,principle:string,description:string>"
TEMPLATE_SCHEMA = (
    "template_id string, name string, description string, domain string, principles array<string>, "
    f"recommended_datasets array<string>, reference string, items array<{ITEM}>"
)


def built_in(spark) -> DataFrame:
    """The built-in templates as version 1, active."""
    return spark.createDataFrame(catalog.template_rows(), TEMPLATE_SCHEMA).withColumns({
        "version": F.lit(1), "is_active": F.lit(True)})


def list_templates(templates, domain=None, principle=None, search=None) -> DataFrame:
    """Active templates by domain, principle and name; order by template_id to read them."""
    out = templates.where("is_active")
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if principle is not None:
        out = out.where(F.array_contains("principles", principle))
    if search:
        out = out.where(F.contains(F.lower("name"), F.lit(search.lower())))
    return out


def with_baseline(templates) -> DataFrame:
    """Templates with the baseline rules of their principles that they do not have yet."""
    baseline = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("metric", "operator", "value", "principle", "description"), rule)])
        for rule in catalog.rule_rows(catalog.BASELINE_RULES)])
    present = F.transform("items", lambda i: F.lower(i["metric"]))
    # Baseline rules follow the order of the template's own principles.
    missing = F.flatten(F.transform("principles", lambda p: F.filter(
        baseline, lambda r: (r["principle"] == F.lower(p)) & ~F.array_contains(present, r["metric"]))))
    return templates.withColumn("items", F.concat("items", missing))


def upsert(current, incoming, key, compared) -> DataFrame:
    """The next snapshot: new rows at version 1, changed rows one version up, the rest as they are.

    ``change`` says inserted, updated or kept.
    """
    old = current.select(*[F.col(c).alias(f"_old_{c}") if c != key else F.col(c) for c in current.columns]).withColumn("_in_old", F.lit(True))
    new = incoming.withColumn("_in_new", F.lit(True))
    joined = new.join(old, key, "full_outer")
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    change = (
        F.when(F.col("_in_old").isNull(), "inserted")
        .when(F.col("_in_new").isNull(), "kept").when(differs, "updated").otherwise("kept"))
    taken = F.col("change") != "kept"
    columns = [c for c in incoming.columns if c not in (key, "version")]
    return joined.withColumn("change", change).select(
        key, *[F.when(taken, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in columns],
        F.when(F.col("change") == "inserted", 1).when(
            F.col("change") == "updated", F.coalesce("_old_version", F.lit(1)) + 1).otherwise(F.col("_old_version")).alias("version"),
        "change")


def apply_to_projects(choices, templates) -> DataFrame:
    """One requirement per rule of the template chosen for each project (project_id, template_id)."""
    items = choices.join(templates, "template_id").select("*", F.posexplode("items").alias("position", "item"))
    item = F.col("item")
    known = F.col("item")["principle"].isin(*C.PRINCIPLES)
    rule = F.struct(item["metric"].alias("metric"), F.coalesce(item["operator"], F.lit(">=")).alias("operator"),
                    F.coalesce(item["value"], F.lit(0.0)).alias("value"), F.coalesce(item["description"], F.lit("")).alias("description"))
    return items.select(
        "project_id", "template_id", "position",
        F.concat(F.coalesce(item["metric"], F.lit("Unknown")), F.lit(" ("), "template_id", F.lit(")")).alias("name"),
        F.trim(F.concat(F.coalesce(item["description"], F.lit("")), F.lit(". Source template: "), "name", F.lit(". Reference: "),
                        F.coalesce("reference", F.lit("")))).alias("description"),
        F.when(known, item["principle"]).otherwise("fairness").alias("principle"),
        F.to_json(F.struct(F.array(rule).alias("rules"))).alias("specification"),
        F.lit("active").alias("status"), F.lit(1).alias("version"), F.lit(False).alias("elicited_automatically"),
        F.concat(F.lit("Applied from template: "), "name").alias("elicitation_reason"), F.lit(1.0).alias("confidence_score"))


def customise(templates, overrides=(), remove=(), add=(), suffix="custom", name=None) -> DataFrame:
    """Clones with rule fields overridden by index, rules removed by index and rules appended."""
    changed = F.transform("items", lambda item, i: _overridden(item, i, overrides))
    kept = F.filter(changed, lambda item, i: ~i.isin(*remove)) if remove else changed
    fields = ("metric", "operator", "value", "principle", "description")
    extra = F.array(*[
        F.struct(*[F.lit(rule.get(f)).cast("double" if f == "value" else "string").alias(f) for f in fields]) for rule in add
    ]) if add else F.array().cast(f"array<{ITEM}>")
    return templates.withColumns({
        "items": F.concat(kept, extra),
        "template_id": F.concat("template_id", F.lit(f"-{suffix}")),
        "name": F.concat("name", F.lit(" (Custom)")) if name is None else F.lit(name),
        "version": F.lit(1), "is_active": F.lit(True)})


def _overridden(item, index, overrides):
    for change in overrides:
        here = index == change["index"]
        for field in ("value", "operator", "metric", "description", "principle"):
            if field in change:
                new = F.lit(change[field]).cast("double" if field == "value" else "string")
                item = F.when(here, item.withField(field, new)).otherwise(item)
    return item


def validation_settings(templates, keys=("template_id",)) -> DataFrame:
    """Validators, fairness metrics, privacy checks, k and l that a template asks for."""
    rows = templates.select(*keys, "principles", F.posexplode_outer("items").alias("position", "item")).select(
        *keys, "principles", "position", F.lower("item.metric").alias("metric"), F.lower("item.principle").alias("principle"),
        F.col("item.value").alias("value"))
    metric, value = F.col("metric"), F.col("value")
    fairness = metric.isin(*C.FAIRNESS_THRESHOLDS)
    is_k, is_l = metric.isin(*C.TEMPLATE_K_METRICS), metric.isin(*C.TEMPLATE_L_METRICS)
    pii = F.contains(metric, F.lit("pii"))
    implied = F.array_compact(F.array(
        F.when(F.col("principle").isin(*C.PRINCIPLES), F.col("principle")),
        F.when(fairness, "fairness"), F.when(metric.isin(*C.TEMPLATE_TRANSPARENCY_METRICS), "transparency"),
        F.when(pii | is_k | is_l, "privacy"), F.when(metric == "audit_trail_required", "accountability")))
    named = F.filter(F.transform("principles", lambda p: F.lower(p)), lambda p: p.isin(*C.PRINCIPLES))
    at = lambda cond: F.max_by(F.when(cond, F.greatest(F.lit(1), F.round(value).cast("int"))),
                               F.when(cond & value.isNotNull(), F.col("position")))
    # All sets below are of fixed names.
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(named, F.coalesce(
            implied, F.array().cast("array<string>"))))))).alias("validators"),
        F.array_sort(F.collect_set(F.when(fairness, metric))).alias("metrics"),
        F.array_sort(F.collect_set(F.when(pii, "pii_detection").when(is_k, "k_anonymity").when(is_l, "l_diversity"))).alias("checks"),
        at(is_k).alias("k"), at(is_l).alias("l"))
    default = lambda names: F.array_sort(F.array(*[F.lit(n) for n in names]))
    return grouped.select(
        *keys, "validators",
        F.when(F.size("metrics") > 0, F.col("metrics")).otherwise(default(C.DEFAULT_FAIRNESS_SELECTION)).alias("fairness_metrics"),
        F.when(F.size("checks") > 0, F.col("checks")).otherwise(default(C.DEFAULT_PRIVACY_SELECTION)).alias("privacy_checks"),
        F.coalesce("k", F.lit(5)).alias("k"), F.coalesce("l", F.lit(2)).alias("l"))


def template_thresholds(templates, keys=("template_id",)) -> DataFrame:
    """Fairness thresholds of a template: its last value per metric, else the default."""
    items = templates.select(*keys, F.posexplode_outer("items").alias("position", "item")).select(
        *keys, "position", F.lower("item.metric").alias("metric"), F.col("item.value").alias("value"))
    return _thresholds(items, keys, "position")


def requirement_thresholds(rules, keys=("project_id",), order="requirement_id") -> DataFrame:
    """Thresholds of chosen, not archived requirements (one rule per row): fairness metrics, k and l; the last one wins."""
    alive = rules.where(F.coalesce(F.col("status") != "archived", F.lit(True)))
    known = _thresholds(alive.select(*keys, order, "metric", "value"), keys, order)
    kind = F.when(F.col("metric").isin("k_anonymity_k", "k_value"), "k").when(F.col("metric").isin("l_diversity_l", "l_value"), "l")
    groups = alive.withColumn("metric", kind).where("metric IS NOT NULL AND value IS NOT NULL").groupBy(*keys, "metric").agg(
        F.max_by("value", order).alias("threshold"))
    return known.unionByName(groups)


def _thresholds(items, keys, order):
    known = items.where(F.col("metric").isin(*C.FAIRNESS_THRESHOLDS) & F.col("value").isNotNull())
    given = known.groupBy(*keys, "metric").agg(F.max_by("value", order).alias("given"))
    defaults = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(v).alias("default")) for m, v in C.FAIRNESS_THRESHOLDS.items()])
    base = items.select(*keys).distinct().select(*keys, F.inline(defaults))
    return base.join(given, [*keys, "metric"], "left").select(
        *keys, "metric", F.coalesce("given", "default").alias("threshold"))
