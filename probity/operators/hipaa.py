"""The 18 Safe Harbor identifier categories, by column name and by value."""

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import constants as C
from probity.functions.checks import string_columns
from probity.operators.pii import first_values, found, text_values

MAX_SAMPLES = 5
SAMPLE_CHARS = 60


def _joined(patterns):
    return "|".join(f"(?:{p})" for p in patterns)


VALUE_PATTERNS = {h[0]: h[3] for h in C.HIPAA_IDENTIFIERS if h[3]}


def _matches(identifier, digit):
    hit = F.lit(False)
    for p in VALUE_PATTERNS[identifier]:
        hit = hit | found(F.col("value"), identifier, p, digit)
    return hit


def flagged_by_name(columns):
    """(identifier, column) pairs whose lower-cased name matches a pattern."""
    return [
        (identifier, column)
        for identifier, _, patterns, _ in C.HIPAA_IDENTIFIERS
        for column in columns
        if re.search(_joined(patterns), column.lower().strip())
    ]


def flagged_by_value(df, order_by=None, sample_size=None) -> DataFrame:
    """(identifier, column, hits) of text columns with matching values; all values unless sampled."""
    texts = string_columns(df)
    values = text_values(df, texts) if sample_size is None else first_values(df, texts, order_by, sample_size)
    hits = F.array(*[
        F.struct(F.lit(i).alias("identifier"), F.count_if(_matches(i, F.col("digit"))).alias("hits"))
        for i in VALUE_PATTERNS
    ])
    return values.withColumn("digit", F.col("value").rlike("[0-9]")).groupBy("column").agg(hits.alias("found")).select("column", F.inline("found")).where("hits > 0")


def hipaa_report(df, order_by=None, sample_size=None) -> DataFrame:
    """One row per category: the flagged columns and whether it passes."""
    spark = df.sparkSession
    categories = spark.createDataFrame(
        [(i, h[0], h[1]) for i, h in enumerate(C.HIPAA_IDENTIFIERS)], "position int, identifier string, label string")
    flagged = spark.createDataFrame(flagged_by_name(df.columns), "identifier string, column string")
    if string_columns(df):
        by_value = flagged_by_value(df, order_by, sample_size).select("identifier", "column")
        flagged = flagged.unionByName(by_value)
    # At most one entry per column of the table.
    columns = flagged.groupBy("identifier").agg(F.sort_array(F.collect_set("column")).alias("columns"))
    return categories.join(columns, "identifier", "left").select(
        "position", "identifier", "label", F.col("columns").isNull().alias("passed"),
        F.coalesce(F.array_join("columns", ", "), F.lit("")).alias("flagged_columns"),
    )


def hipaa_samples(df, order_by, limit=MAX_SAMPLES) -> DataFrame:
    """The first flagged values of each category, as ``column: value`` cut short, no text twice."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    kinds = F.array_compact(F.array(*[F.when(_matches(i, F.col("digit")), F.lit(i)) for i in VALUE_PATTERNS]))
    values = text_values(df, string_columns(df), keys).withColumn("digit", F.col("value").rlike("[0-9]"))
    hits = values.select(
        F.explode(kinds).alias("identifier"), "position", *keys,
        F.concat("column", F.lit(": "), F.substring("value", 1, SAMPLE_CHARS)).alias("sample"),
    )
    firsts = hits.groupBy("identifier", "position", "sample").agg(F.min(F.struct(*keys)).alias("key"))
    order = Window.partitionBy("identifier").orderBy("position", "key", "sample")
    return firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        "identifier", "rank", "sample")


def hipaa_verdict(report) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        F.bool_and("passed").alias("overall_passed"),
    )
