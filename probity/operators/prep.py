"""Data preparation: encodings, alignment, label rules, splits and samples."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.checks import numeric_columns, require_columns, string_columns
from probity.functions.lookup import looked_up, looked_up_all
from probity.functions.ordering import rank_by_position, rank_unique, shuffle_key, split_by_share
from probity.operators.profile import medians

# Words that mark a positive text label, and the benchmark label words.
POSITIVE_WORDS = r"(?i)>|high|yes|true|1|approved"
ADULT_POSITIVE = r"(?i)>50k"
BANK_POSITIVE = ("yes", "y", "1", "true")
GERMAN_POSITIVE = ("bad", "1", "yes")
COMPAS_HIGH_DECILE = 7


def model_features(df, target=None, sensitive=None) -> DataFrame:
    """Without a target only the sensitive column is dropped, else only the target."""
    drop = target if target is not None and target in df.columns else sensitive
    return df.drop(*([drop] if drop else []))


def complete_rows(df, columns) -> DataFrame:
    require_columns(df, columns)
    return df.na.drop(subset=list(columns))


def incomplete_count(df, columns) -> DataFrame:
    require_columns(df, columns)
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(missing).alias("rows_excluded"))


def first_appearance_codes(df, columns, order_by) -> DataFrame:
    """(column, value, rows, total, code): codes in the order values first appear by ``order_by``; how many rows have the value, and any."""
    if dict(df.dtypes)[order_by] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("order_by must be an integer column")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    firsts = (
        df.select(order_by, F.inline(pairs)).where("value IS NOT NULL")
        .groupBy("column", "value").agg(F.min(order_by).cast("bigint").alias("first_position"), F.count(F.lit(1)).alias("rows"))
    )
    return rank_by_position(firsts, ["column"], "first_position", "value", "rows")


def encode_first_appearance(df, order_by, columns=None, null_code=-1) -> DataFrame:
    """String columns replaced by first-appearance codes, missing values by ``null_code``.

    The codes of all columns come from one pass. Frequent values are looked up
    where the rows are; only rows with a rare value are shuffled.
    """
    columns = string_columns(df) if columns is None else columns
    if not columns:
        return df
    codes = first_appearance_codes(df, columns, order_by)
    out = looked_up_all(df, {
        c: (codes.where(F.col("column") == c).select(F.col("value").alias(c), "rows", "total", F.col("code").alias(f"_c_{c}")), f"_c_{c}")
        for c in columns}, order_by)
    return out.select(*[
        F.coalesce(F.col(f"_c_{c}"), F.lit(null_code)).cast("bigint").alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def alphabetical_codes(df, column) -> DataFrame:
    """(value, rows, code) with codes in value order."""
    return rank_unique(df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")), "value")


def encode_alphabetical(df, column) -> DataFrame:
    codes = alphabetical_codes(df, column).select(F.col("value").alias(column), "rows", F.col("code").alias("_c"))
    return looked_up(df, codes, [column]).select(*[
        F.coalesce(F.col("_c"), F.lit(-1)).cast("bigint").alias(c) if c == column else F.col(c)
        for c in df.columns
    ])


def keyword_target(column):
    """1 where the text holds a positive word, else 0; missing text is 0."""
    return F.coalesce(F.col(column).cast("string").rlike(POSITIVE_WORDS), F.lit(False)).cast("int")


def binarise_predictions(df, column, score_threshold=None) -> DataFrame:
    """Predictions as 0/1.

    By default values are cut to integers first and, only if some are then
    outside {0, 1}, compared with 0.5. ``score_threshold`` thresholds the raw
    score instead.
    """
    if score_threshold is not None:
        return df.withColumn(column, (F.col(column) > F.lit(score_threshold)).cast("int"))
    whole = F.col(column).cast("int")
    stray = df.agg(F.coalesce(F.bool_or(~whole.isin(0, 1)), F.lit(False)).alias("stray")).scalar()
    return df.withColumn(column, F.when(stray, (whole > 0.5).cast("int")).otherwise(whole))


def non_binary_targets(df, column) -> DataFrame:
    """The first ten target values outside {0, 1} with the count of such rows."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(0, 1))
    total = bad.agg(F.count(F.lit(1)).alias("c")).scalar()
    return (
        bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("value").limit(10).withColumn("rows_total", total)
    )


def align_by_name(df, features, strict=False) -> DataFrame:
    """Columns in the model's order; missing ones are 0.0 unless ``strict``."""
    if strict:
        require_columns(df, features)
    return df.select(*[F.col(f) if f in df.columns else F.lit(0.0).alias(f) for f in features])


def align_by_position(df, count) -> DataFrame:
    """The first ``count`` columns, padded with zeros when there are fewer."""
    pads = [F.lit(0.0).alias(f"__pad_feature_{i}") for i in range(count - len(df.columns))]
    return df.select(*df.columns[:count], *pads)


def finite_or_zero(value):
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(math.inf)), F.lit(0.0)).otherwise(value)


def numeric_matrix(df, order_by, drop=()) -> DataFrame:
    """Every remaining column as a finite double; text becomes first-appearance codes.

    A missing text is a value of its own, as 'nan'.
    """
    kept = df.drop(*[c for c in drop if c != order_by])
    texts = [c for c in string_columns(kept) if c != order_by]
    filled = kept.withColumns({c: F.coalesce(F.col(c), F.lit("nan")) for c in texts})
    coded = encode_first_appearance(filled, order_by, texts)
    return coded.select(order_by, *[
        finite_or_zero(F.col(c).try_cast("double")).alias(c) for c in coded.columns if c != order_by
    ])


def above_both_medians(df, first, second):
    """1 where both columns exceed their medians (missing values count as 0)."""
    filled = df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in (first, second)})
    middle = medians(filled, [first, second])
    cut = {c: middle.where(F.col("column") == c).select("median").scalar() for c in (first, second)}
    return filled.withColumn("label", ((F.col(first) > cut[first]) & (F.col(second) > cut[second])).cast("int"))


def benchmark_label(df, key) -> DataFrame:
    """Adds the 0/1 ``label`` of a benchmark dataset; see ``LABEL_DROPS`` for columns to leave out."""
    if key == "adult_income":
        return df.withColumn("label", F.coalesce(F.trim("income").rlike(ADULT_POSITIVE), F.lit(False)).cast("int"))
    if key == "bank_marketing":
        answer = "deposit" if "deposit" in df.columns else "y"
        return df.withColumn("label", F.coalesce(F.lower(F.col(answer).cast("string")).isin(*BANK_POSITIVE), F.lit(False)).cast("int"))
    if key == "compas":
        decile = F.coalesce(F.col("DecileScore").try_cast("double"), F.lit(0.0))
        return df.withColumn("label", (decile >= COMPAS_HIGH_DECILE).cast("int"))
    if key == "diabetes_readmission":
        return df.withColumn("label", F.coalesce(F.upper("readmitted") != "NO", F.lit(True)).cast("int"))
    if key == "german_credit":
        return _german_label(df)
    raise ValueError(f"Unknown dataset key: {key}")


def _german_label(df):
    """The stated label if it has two classes, else a proxy from duration and amount."""
    if "kredit" in df.columns:
        bad = (F.coalesce(F.col("kredit").try_cast("double"), F.lit(2.0)).cast("int") == 2).cast("int")
        if df.agg(F.count_distinct(bad).alias("classes")).first()["classes"] > 1:
            return df.withColumn("label", bad)
        if {"laufzeit", "hoehe"} <= set(df.columns):
            return above_both_medians(df, "laufzeit", "hoehe")
    if "Risk" in df.columns:
        return df.withColumn("label", F.coalesce(F.lower("Risk").isin(*GERMAN_POSITIVE), F.lit(False)).cast("int"))
    if {"Credit amount", "Duration"} <= set(df.columns):
        return above_both_medians(df, "Credit amount", "Duration")
    raise ValueError("Could not infer German Credit target column")


# Columns that give a benchmark label away or identify a person.
LABEL_DROPS = {
    "adult_income": ["income"],
    "bank_marketing": ["deposit", "y"],
    "compas": [
        "DecileScore", "RawScore", "ScoreText", "LastName", "FirstName", "MiddleName",
        "DateOfBirth", "Screening_Date", "Case_ID", "AssessmentID", "Person_ID",
    ],
    "diabetes_readmission": ["readmitted", "encounter_id", "patient_nbr"],
    "german_credit": ["kredit", "Risk"],
}


def stratified_split(df, label, id_column, train_share=0.8, seed=42) -> DataFrame:
    """Adds ``split`` (train / test), repeatable and exact within every class."""
    marked = split_by_share(df, id_column, train_share, seed, stratum=label)
    return marked.withColumn("split", F.when(F.col("in_first"), "train").otherwise("test")).drop("in_first")


def sample_rows(df, id_column, count, seed=42) -> DataFrame:
    """``count`` rows without replacement, the same ones for the same seed."""
    return df.orderBy(shuffle_key(id_column, seed), id_column).limit(count)


def feature_columns(df, exclude=()):
    return [c for c in numeric_columns(df) if c not in exclude]
