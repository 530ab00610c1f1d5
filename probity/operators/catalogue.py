"""Projects and their assets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live(projects) -> DataFrame:
    return projects.where(F.col("deleted_at").isNull())


def accessible(projects, user_id, role) -> DataFrame:
    """Projects a user may see: their own, or all for an admin."""
    return projects if role == "admin" else projects.where(F.col("owner_id") == user_id)


def with_access(projects, users) -> DataFrame:
    """(user, project) pairs of owners and how many projects each user may see."""
    total = projects.agg(F.count(F.lit(1)).alias("n")).scalar()
    own = projects.groupBy(F.col("owner_id").alias("user_id")).agg(F.count(F.lit(1)).alias("owned"))
    return users.join(own, "user_id", "left").select(
        "user_id", "role",
        F.when(F.col("role") == "admin", total).otherwise(F.coalesce("owned", F.lit(0))).alias("visible_projects"))


def project_counts(projects, models, datasets, requirements) -> DataFrame:
    """Live projects with the number of their models, datasets and requirements."""
    out = live(projects)
    for df, name in ((models, "model_count"), (datasets, "dataset_count"), (requirements, "requirement_count")):
        out = out.join(df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name)), "project_id", "left")
    return out.withColumns({
        n: F.coalesce(n, F.lit(0)) for n in ("model_count", "dataset_count", "requirement_count")})


def newest_page(df, column, key, skip=0, limit=100) -> DataFrame:
    return df.orderBy(F.desc(column), F.desc(key)).offset(skip).limit(limit)


def one_project(counts, project_id) -> DataFrame:
    return counts.where(F.col("project_id") == project_id)


def soft_delete(projects, project_ids, when) -> DataFrame:
    """Projects with the named ones (a DataFrame of project_id, or a list) marked deleted."""
    if isinstance(project_ids, DataFrame):
        named = project_ids.select("project_id").distinct().withColumn("_gone", F.lit(True))
        marked = projects.join(named, "project_id", "left")
        gone = F.col("_gone").isNotNull()
    else:
        marked, gone = projects, F.col("project_id").isin(*project_ids)
    return marked.withColumn(
        "deleted_at", F.when(gone & F.col("deleted_at").isNull(), F.lit(when).cast("timestamp")).otherwise(F.col("deleted_at"))
    ).select(*projects.columns)


def repeated_names(df, keys, name="name", ignore_case=False) -> DataFrame:
    """Names used more than once within the keys."""
    label = F.lower(F.trim(name)) if ignore_case else F.col(name)
    return df.groupBy(*keys, label.alias("name")).agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def name_conflicts(candidates, existing, keys, name="name", ignore_case=False) -> DataFrame:
    """Candidates whose name is taken already."""
    fold = (lambda c: F.lower(F.trim(c))) if ignore_case else F.col
    taken = existing.select(*keys, fold(name).alias("_name")).distinct()
    return candidates.withColumn("_name", fold(name)).join(taken, [*keys, "_name"], "left_semi").drop("_name")


# What a name may be used for once: the keys within which it is unique, and whether case and outer blanks count.
NAME_KEYS = {
    "datasets": (("project_id",), True),
    "custom_rules": (("project_id", "principle"), False),
    "validation_presets": (("project_id", "user_id"), False),
}


def refused_names(kind, candidates, existing) -> DataFrame:
    """New assets of a kind whose name is taken, with the reason; an unnamed one is not refused here."""
    keys, ignore_case = NAME_KEYS[kind]
    word = {"datasets": "Dataset with name", "custom_rules": "Custom rule", "validation_presets": "Preset"}[kind]
    where = " in this project" if kind == "datasets" else ""
    taken = name_conflicts(candidates, existing, list(keys), ignore_case=ignore_case)
    return taken.withColumn("reason", F.concat(F.lit(f"{word} '"), F.trim("name") if ignore_case else F.col("name"), F.lit(f"' already exists{where}")))


def newest_assets(df, project_id=None, column="created_at", key=None) -> DataFrame:
    """Assets, newest first; ``key`` (their id) decides between equal times, so that pages don't change."""
    chosen = df if project_id is None else df.where(F.col("project_id") == project_id)
    return chosen.orderBy(F.desc(column), *([F.desc(key)] if key else []))


def ranked_assets(lists, newest) -> DataFrame:
    """(kind, project_id, rank, asset_id, name, listed_at) of the ``newest`` assets of every kind and project.

    ``lists`` gives by kind a table and its (id, name, time) columns. Ranks are cut in each task before the shuffle.
    """
    out = None
    for kind, (df, key, name, at) in lists.items():
        rows = df.select(
            F.lit(kind).alias("kind"), F.col("project_id").cast("string").alias("project_id"), F.col(key).cast("string").alias("asset_id"),
            F.col(name).alias("name"), F.col(at).cast("timestamp").alias("listed_at"), F.col(key).alias("_key"))
        order = Window.partitionBy("project_id").orderBy(F.desc("listed_at"), F.desc("_key"))
        page = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= newest).drop("_key")
        out = page if out is None else out.unionByName(page)
    return out


def dashboard_totals(counts) -> DataFrame:
    """Projects, models and datasets over all listed projects."""
    return counts.agg(
        F.count(F.lit(1)).alias("total_projects"),
        F.coalesce(F.sum("model_count"), F.lit(0)).alias("total_models"),
        F.coalesce(F.sum("dataset_count"), F.lit(0)).alias("total_datasets"),
        F.coalesce(F.sum(F.col("model_count") + F.col("dataset_count")), F.lit(0)).alias("total_assets"),
        F.count_if(F.col("deleted_at").isNull()).alias("active_projects"),
    )


def readiness(counts, as_of) -> DataFrame:
    """Progress of each project and the age of its last change in words."""
    has_models, has_data = F.col("model_count") > 0, F.col("dataset_count") > 0
    minutes = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))) / 60)

    def ago(n, word):
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return counts.select(
        "project_id", "name",
        F.when(has_models & has_data, 100).when(has_models | has_data, 50).otherwise(0).alias("progress"),
        F.when(has_models & has_data, "Ready").when(has_models | has_data, "In Progress").otherwise("Not Started").alias("status"),
        F.when(minutes < 60, ago(minutes, "minute")).when(hours < 24, ago(hours, "hour")).otherwise(ago(days, "day")).alias("last_updated"),
    )
