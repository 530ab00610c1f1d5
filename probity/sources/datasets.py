"""Datasets under audit: scans, the normalised copy, anonymised and matrix exports."""

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.text import guard_cells
from probity.operators.anonymize import anonymise
from probity.operators.profile import registration_profile
from probity.operators.trace import trace_export


def read_dataset(spark, path, schema=None, order_by=None, max_rows=None, multi_line=False) -> DataFrame:
    """A CSV or Parquet dataset; CSV types are inferred unless a schema is given.

    Give the schema for large CSV files: inferring it reads them twice.
    ``max_rows`` keeps the first rows by ``order_by``. ``multi_line``: quoted
    cells may hold line breaks (a file is then read by one task); without it a
    record torn by one is an error, never two rows.
    """
    if str(path).rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("mode", "FAILFAST")
        df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if max_rows is None:
        return df
    if order_by is None:
        raise ValueError("max_rows needs order_by: rows of a DataFrame have no order of their own")
    return df.orderBy(order_by).limit(max_rows)


def check_dataset(df, target=None, sensitive=()):
    """Rejects a dataset without columns or rows, or without a named column."""
    if not df.columns:
        raise ValueError("Dataset has no columns")
    missing = [c for c in [*( [target] if target else []), *sensitive] if c not in df.columns]
    if missing:
        raise ValueError(f"Columns not found in dataset: {missing}")
    if df.limit(1).count() == 0:
        raise ValueError("Dataset is empty")
    return df


def normalise(df, path, as_csv=False, mode="overwrite", for_spreadsheet=False):
    """Writes the copy later stages read: Parquet, or CSV if wanted; values change only ``for_spreadsheet`` (formula guard)."""
    if as_csv:
        (guard_cells(df) if for_spreadsheet else df).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).parquet(path)


def export_anonymised(df, strategies, path, mode="overwrite", for_spreadsheet=False) -> DataFrame:
    """Writes the anonymised rows as CSV and returns them; cells are guarded only ``for_spreadsheet``."""
    out = anonymise(df, strategies)
    (guard_cells(out) if for_spreadsheet else out).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return out


def export_trace_matrix(traces, path, patterns=None, mode="overwrite"):
    """Writes the matrix as CSV with every cell quoted and inner quotes doubled."""
    trace_export(traces, patterns).write.mode(mode).option("header", True).option("quoteAll", True).option(
        "escape", '"').csv(path)


def dataset_record(df, name, project_id, path, target=None, sensitive=(), profiled=True, value_counts=False) -> DataFrame:
    """The row a dataset is registered with, its profile (see ``registration_profile``) included unless not wanted."""
    if profiled:
        facts = registration_profile(df, value_counts)
    else:
        facts = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("profile_data", F.lit(None).cast("string"))
    return facts.select(
        F.lit(project_id).alias("project_id"), F.lit(name).alias("name"), F.lit(str(path)).alias("file_path"), "row_count",
        F.lit(len(df.columns)).alias("column_count"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.array(*[F.lit(c) for c in sensitive]).cast("array<string>").alias("sensitive_attributes"),
        F.lit(target).cast("string").alias("target_column"), "profile_data")


def files_in(spark, folder) -> DataFrame:
    """(filename) of the files in a folder; contents are not read."""
    listing = spark.read.format("binaryFile").load(os.path.join(folder, "*"))
    return listing.select(F.element_at(F.split("path", "/"), -1).alias("filename"))
