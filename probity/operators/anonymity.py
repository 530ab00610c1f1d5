"""k-anonymity and l-diversity of quasi-identifier groups.

Group sizes and distinct sensitive values are partial aggregates, so a group
holding a large share of the rows is combined map-side before any shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.checks import require_columns
from probity.operators.prep import incomplete_count

NO_ROWS = "No complete rows after removing missing values in quasi-identifiers"


def group_sizes(df, quasi_identifiers) -> DataFrame:
    """Rows per combination of quasi-identifiers, incomplete rows left out."""
    if not quasi_identifiers:
        raise ValueError("Must provide at least one quasi-identifier")
    require_columns(df, quasi_identifiers)
    return df.select(*quasi_identifiers).na.drop().groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("size"))


def k_anonymity(df, quasi_identifiers, k=5) -> DataFrame:
    """One row: smallest group, groups below k, rows left out, and the verdict.

    Without any complete row the check is not satisfied and ``error`` says why.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    sizes = group_sizes(df, quasi_identifiers)
    excluded = incomplete_count(df, quasi_identifiers).select("rows_excluded").scalar()
    return sizes.agg(
        F.min("size").alias("actual_min_k"),
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(F.col("size") < k).alias("violating_groups"),
    ).select(
        F.lit(k).alias("k_value"),
        F.coalesce(F.col("actual_min_k") >= k, F.lit(False)).alias("satisfies_k"),
        "actual_min_k", "total_groups", "violating_groups",
        excluded.alias("rows_with_missing_values"),
        F.when(F.col("total_groups") == 0, NO_ROWS).alias("error"),
    )


def violating_groups(df, quasi_identifiers, k=5, limit=10) -> DataFrame:
    """The first groups smaller than k in the order of the quasi-identifiers."""
    return group_sizes(df, quasi_identifiers).where(F.col("size") < k).orderBy(*quasi_identifiers).limit(limit)


def size_distribution(df, quasi_identifiers) -> DataFrame:
    """How many groups there are of each size."""
    return group_sizes(df, quasi_identifiers).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def k_anonymity_configs(df, configs) -> DataFrame:
    """One result per (quasi-identifiers, k), all group-bys in one pass by grouping sets."""
    if not configs:
        raise ValueError("k_anonymity_configs must be a non-empty list")
    columns = sorted({c for qis, _ in configs for c in qis})
    require_columns(df, columns)
    for qis, k in configs:
        if not qis or k < 1:
            raise ValueError("every configuration needs quasi-identifiers and k >= 1")
    sets = [list(s) for s in dict.fromkeys(tuple(sorted(set(qis))) for qis, _ in configs)]
    names = ["+".join(s) for s in sets]
    grouped = df.select(*columns).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("size"), F.grouping_id().alias("set_id"),
        *[F.grouping(c).alias(f"_g_{c}") for c in columns],
    )
    complete = F.lit(True)
    for c in columns:
        complete = complete & ((F.col(f"_g_{c}") == 1) | F.col(c).isNotNull())
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    ids = {name: sum(bit[c] for c in columns if c not in s) for name, s in zip(names, sets)}
    ok = complete

    def result(position, qis, k):
        mine = F.col("set_id") == ids["+".join(sorted(set(qis)))]
        return F.struct(
            F.lit(position).alias("position"), F.lit(",".join(qis)).alias("quasi_identifiers"), F.lit(k).alias("k_value"),
            F.min(F.when(mine & ok, F.col("size"))).alias("actual_min_k"),
            F.count_if(mine & ok).alias("total_groups"),
            F.count_if(mine & ok & (F.col("size") < k)).alias("violating_groups"),
            F.coalesce(F.sum(F.when(mine & ~ok, F.col("size"))), F.lit(0)).alias("rows_with_missing_values"),
        ).alias(f"c{position}")

    wide = grouped.agg(*[result(i, qis, k) for i, (qis, k) in enumerate(configs)])
    rows = wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(configs))])))
    return rows.withColumn("satisfies_k", F.coalesce(F.col("actual_min_k") >= F.col("k_value"), F.lit(False)))


def group_diversity(df, quasi_identifiers, sensitive) -> DataFrame:
    """Distinct sensitive values per group, counted without collecting a group."""
    require_columns(df, [*quasi_identifiers, sensitive])
    pairs = df.select(*quasi_identifiers, F.col(sensitive).alias("_sensitive")).na.drop().distinct()
    return pairs.groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("diversity"))


def l_diversity(df, quasi_identifiers, sensitive, l=2) -> DataFrame:  # noqa: E741
    """One row: smallest diversity, groups below l, and the verdict."""
    if not quasi_identifiers:
        raise ValueError("Must provide at least one quasi-identifier")
    if l < 1:
        raise ValueError(f"l must be at least 1, got {l}")
    return group_diversity(df, quasi_identifiers, sensitive).agg(
        F.min("diversity").alias("actual_min_l"),
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(F.col("diversity") < l).alias("violating_groups"),
    ).select(
        F.lit(l).alias("l_value"),
        F.coalesce(F.col("actual_min_l") >= l, F.lit(False)).alias("satisfies_l"),
        "actual_min_l", "total_groups", "violating_groups",
        F.when(F.col("total_groups") == 0, NO_ROWS).alias("error"),
    )


def undiverse_groups(df, quasi_identifiers, sensitive, l=2, limit=5) -> DataFrame:  # noqa: E741
    return (
        group_diversity(df, quasi_identifiers, sensitive).where(F.col("diversity") < l)
        .orderBy(*quasi_identifiers).limit(limit).withColumn("required_diversity", F.lit(l))
    )
