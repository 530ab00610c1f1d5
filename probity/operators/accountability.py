"""Run records, model lineage, audit logs and notifications."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.text import clean_metric_name

MAX_ERROR = 2000
RUN_SCHEMA = (
    "run_id string, model_id string, model_name string, requirement_id string, principle string, dataset string, "
    "status string, started_at timestamp, completed_at timestamp, metrics map<string,double>, error string"
)


def run_records(starts, metrics, ends) -> DataFrame:
    """Runs as recorded: one row per start with its metrics and how it ended.

    ``metrics`` holds (run_id, metric, value, logged_at); the latest value of a
    metric counts, and a missing name is the empty one. A run without an end is
    ``running``; errors are cut short.
    """
    name = F.coalesce(clean_metric_name("metric"), F.lit(""))
    latest = metrics.withColumn("metric", name).groupBy("run_id", "metric").agg(
        F.max_by("value", "logged_at").alias("value"))
    merged = latest.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    ended = ends.select(
        "run_id", "completed_at", F.substring("error", 1, MAX_ERROR).alias("error"),
        F.when(F.col("error").isNotNull(), "error").when(F.col("passed"), "passed").otherwise("failed").alias("status"))
    # Size estimates do not see how long the error texts are, so these must not be broadcast.
    return starts.join(merged, "run_id", "left").join(ended.hint("merge"), "run_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("running")))


def run_history(runs, model_id=None, requirement_id=None, principle=None, status=None, limit=100) -> DataFrame:
    """Matching runs, newest first."""
    out = runs
    for column, value in (("model_id", model_id), ("requirement_id", requirement_id), ("principle", principle), ("status", status)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def register_versions(current, incoming) -> DataFrame:
    """The version registry with later registrations winning per model."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    others = [c for c in both.columns if c not in ("model_id", "registered_at")]
    return both.groupBy("model_id").agg(
        F.max("registered_at").alias("registered_at"), *[F.max_by(c, "registered_at").alias(c) for c in others])


def model_lineage(versions, runs) -> DataFrame:
    """Per registered model: its runs, passed and failed, and the principles checked."""
    counts = runs.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        # Principles are a handful of fixed names.
        F.array_join(F.sort_array(F.collect_set("principle")), ",").alias("principles"),
    )
    return versions.join(counts, "model_id", "left").withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("total_runs", "passed", "failed")
    }).withColumn("principles", F.coalesce("principles", F.lit("")))


def in_period(df, column, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def audit_report(runs, start=None, end=None) -> DataFrame:
    """Counts by status, principle and model in one pass, as (kind, name, runs)."""
    chosen = in_period(runs, "started_at", start, end)
    sets = [[F.col("status")], [F.col("principle")], [F.col("model_name")]]
    grouped = chosen.groupingSets(sets, F.col("status"), F.col("principle"), F.col("model_name")).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.grouping(c).alias(f"g_{c}") for c in ("status", "principle", "model_name")])
    kind = F.when(F.col("g_status") == 0, "status").when(F.col("g_principle") == 0, "principle").otherwise("model")
    name = F.when(F.col("g_status") == 0, F.col("status")).when(F.col("g_principle") == 0, F.col("principle")).otherwise(
        F.col("model_name"))
    return grouped.select(kind.alias("kind"), name.alias("name"), "runs")


def audit_report_summary(report) -> DataFrame:
    """Total runs, models checked and the share that passed."""
    of = lambda kind: F.when(F.col("kind") == kind, F.col("runs"))
    return report.agg(
        F.coalesce(F.sum(of("status")), F.lit(0)).alias("total_runs"),
        F.count_if(F.col("kind") == "model").alias("models_checked"),
        F.coalesce(F.sum(F.when(F.col("name") == "passed", of("status"))), F.lit(0)).alias("passed_runs"),
    ).withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed_runs").cast("double"), F.col("total_runs").cast("double")), F.lit(0.0)))


def first_runs(runs, start=None, end=None, limit=10) -> DataFrame:
    """The first recorded runs of the period."""
    return in_period(runs, "started_at", start, end).orderBy("started_at", "run_id").limit(limit)


def audit_log(logs, users, action=None, resource_type=None, user_id=None, start=None, end=None, skip=0, limit=50) -> DataFrame:
    """Log entries with the user's e-mail, newest first, a page at a time."""
    out = logs
    for column, value in (("action", action), ("resource_type", resource_type), ("user_id", user_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    out = in_period(out, "event_time", start, end)
    page = out.orderBy(F.desc("event_time"), F.desc("audit_id")).offset(skip).limit(limit)
    # The page is cut before the join; a user has one row.
    return page.join(users.select("user_id", F.col("email").alias("user_email")), "user_id", "left").orderBy(
        F.desc("event_time"), F.desc("audit_id"))


def audit_totals(logs, as_of) -> DataFrame:
    """Entries overall, on the day of ``as_of`` and in the seven days before it."""
    midnight = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    when = F.col("event_time").cast("timestamp")
    return logs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(when >= midnight).alias("today"),
        F.count_if(when >= midnight - F.expr("INTERVAL 7 DAYS")).alias("last_7_days"),
    )


def audit_breakdown(logs) -> DataFrame:
    """Entries by action and by resource type in one pass, as (kind, name, entries)."""
    sets = [[F.col("action")], [F.col("resource_type")]]
    grouped = logs.groupingSets(sets, F.col("action"), F.col("resource_type")).agg(
        F.count(F.lit(1)).alias("entries"), F.grouping("action").alias("g"))
    return grouped.select(
        F.when(F.col("g") == 0, "action").otherwise("resource_type").alias("kind"),
        F.when(F.col("g") == 0, F.col("action")).otherwise(F.col("resource_type")).alias("name"), "entries")


def platform_stats(users, projects, models, datasets, validations) -> DataFrame:
    """Row counts of the main tables and validations by state, as (statistic, value)."""
    def count(df, name, condition=None):
        n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return df.agg(n.alias("value")).select(F.lit(name).alias("statistic"), "value")

    state = validations.agg(
        F.count(F.lit(1)).alias("total_validations"),
        *[F.count_if(F.col("status") == s).alias(n) for n, s in (
            ("validations_passed", "completed"), ("validations_failed", "failed"), ("validations_running", "running"))])
    names = state.columns
    parts = [
        count(users, "total_users"), count(projects, "total_projects", F.col("deleted_at").isNull()),
        count(models, "total_models"), count(datasets, "total_datasets"),
    ]
    out = state.select(F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in names])))
    for p in parts:
        out = out.unionByName(p)
    return out


def recent_activity(logs, limit=20) -> DataFrame:
    return logs.orderBy(F.desc("event_time"), F.desc("audit_id")).limit(limit)


def list_users(users, skip=0, limit=50) -> DataFrame:
    return users.orderBy(F.desc("created_at"), F.desc("user_id")).offset(skip).limit(limit)


def list_notifications(notes, user_id=None, unread_only=False, limit=50) -> DataFrame:
    out = notes if user_id is None else notes.where(F.col("user_id") == user_id)
    out = out.where(~F.col("is_read")) if unread_only else out
    return out.orderBy(F.desc("created_at"), F.desc("notification_id")).limit(limit)


def unread_counts(notes) -> DataFrame:
    return notes.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("notifications"), F.count_if(~F.col("is_read")).alias("unread"))


def mark_read(notes, user_id, ids=None) -> DataFrame:
    """Marks a user's notifications read: all of them, a list of ids, or a DataFrame of ids."""
    mine = F.col("user_id") == user_id
    if ids is None:
        return notes.withColumn("is_read", F.col("is_read") | mine)
    if isinstance(ids, DataFrame):
        named = ids.select("notification_id").distinct().withColumn("_named", F.lit(True))
        return notes.join(named, "notification_id", "left").withColumn(
            "is_read", F.col("is_read") | (mine & F.col("_named").isNotNull())).drop("_named")
    return notes.withColumn("is_read", F.col("is_read") | (mine & F.col("notification_id").isin(*ids)))
