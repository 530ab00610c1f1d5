"""Differential-privacy estimate and Laplace noise."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.checks import numeric_columns, require_columns

NOISE_FLOOR = 1e-6
HASH_BITS = 52


def column_epsilons(df, quasi_identifiers, approximate=False) -> DataFrame:
    """Sensitivity and epsilon estimate of each quasi-identifier.

    Numeric columns: (max - min) / sample deviation. Others: sensitivity 1 and
    distinct values per row. A column of sensitivity 0 adds nothing.
    """
    require_columns(df, quasi_identifiers)
    numeric = [c for c in quasi_identifiers if c in numeric_columns(df)]
    other = [c for c in quasi_identifiers if c not in numeric]
    parts = []
    if numeric:
        wide = df.agg(*[
            F.struct(F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("std")).alias(c)
            for c in numeric for v in [F.col(c).cast("double")]
        ])
        rows = wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c)["low"].alias("low"), F.col(c)["high"].alias("high"),
                     F.col(c)["std"].alias("std")) for c in numeric
        ])))
        sensitivity = F.coalesce(F.col("high") - F.col("low"), F.lit(1.0))
        sigma = F.greatest(F.coalesce("std", F.lit(0.0)), F.lit(NOISE_FLOOR))
        parts.append(rows.select("column", sensitivity.alias("sensitivity"), (sensitivity / sigma).alias("epsilon")))
    if other:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in other])
        values = df.select(F.inline(pairs))
        if approximate:
            counts = values.groupBy("column").agg(
                F.approx_count_distinct("value").alias("distinct"), F.count(F.lit(1)).alias("rows"))
        else:
            counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(
                F.count("value").alias("distinct"), F.sum("n").alias("rows"))
        parts.append(counts.select(
            "column", F.lit(1.0).alias("sensitivity"),
            (F.col("distinct").cast("double") / F.col("rows").cast("double")).alias("epsilon")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("epsilon", F.when(F.col("sensitivity") == 0, F.lit(0.0)).otherwise(F.col("epsilon")))


def privacy_budget(df, quasi_identifiers, target_epsilon=1.0, approximate=False) -> DataFrame:
    """One row: the measured epsilon and whether it keeps to the target."""
    if not quasi_identifiers:
        return df.sparkSession.range(1).select(
            F.lit(0.0).alias("measured_epsilon"), F.lit(float(target_epsilon)).alias("target_epsilon"),
            F.lit(True).alias("budget_satisfied"))
    total = column_epsilons(df, quasi_identifiers, approximate).agg(F.sum("epsilon").alias("epsilon"))
    return total.select(
        F.round("epsilon", 6).alias("measured_epsilon"),
        F.lit(float(target_epsilon)).alias("target_epsilon"),
        (F.col("epsilon") <= target_epsilon).alias("budget_satisfied"),
    )


def noise_scales(df, quasi_identifiers, target_epsilon=1.0) -> DataFrame:
    """The scale used per numeric column: the budget is shared among the quasi-identifiers."""
    numeric = [c for c in quasi_identifiers if c in numeric_columns(df)]
    share = target_epsilon / max(len(quasi_identifiers), 1)
    return column_epsilons(df, numeric).where("sensitivity > 0").select(
        "column", "sensitivity", (F.col("sensitivity") / F.lit(share)).alias("scale"))


def uniform(id_columns, salt):
    """A number in (0, 1) fixed by the row's key and the salt."""
    return uniform_of(F.concat_ws(":", *[F.col(c).cast("string") for c in id_columns], F.lit(str(salt))))


def uniform_of(text):
    """A number in (0, 1) fixed by a text."""
    whole = F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")
    return (whole + 0.5) / F.lit(float(1 << HASH_BITS))


def laplace_noise(df, quasi_identifiers, id_columns, target_epsilon=1.0, seed=42) -> DataFrame:
    """Numeric quasi-identifiers with Laplace noise.

    The draw depends on the row's key, the column and the seed only, so a task
    run again after a failure adds the same noise. Keep the seed secret.
    """
    require_columns(df, [*quasi_identifiers, *id_columns])
    numeric = [c for c in quasi_identifiers if c in numeric_columns(df)]
    scales = noise_scales(df, quasi_identifiers, target_epsilon) if numeric else None
    out = {}
    for c in numeric:
        scale = scales.where(F.col("column") == c).select("scale").scalar()
        u = uniform(id_columns, f"{c}:{seed}") - 0.5
        draw = -F.signum(u) * F.log(1 - 2 * F.abs(u))
        out[c] = F.col(c).cast("double") + F.coalesce(scale, F.lit(0.0)) * draw
    return df.withColumns(out) if out else df
