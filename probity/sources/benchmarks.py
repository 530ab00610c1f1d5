"""The catalogue of benchmark datasets and what can be loaded from it."""

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.constants import BENCHMARK_DATASETS
from probity.sources.datasets import check_dataset, dataset_record, files_in, read_dataset

CATALOGUE_SCHEMA = (
    "dataset_key string, name string, filename string, target_column string, sensitive_attributes array<string>, "
    "key_features array<string>, domain string, reference string"
)


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(list(BENCHMARK_DATASETS), CATALOGUE_SCHEMA)


def catalogue_with_files(spark, folder) -> DataFrame:
    """The catalogue and whether each file lies in the folder."""
    present = files_in(spark, folder).select("filename", F.lit(True).alias("present"))
    return catalogue(spark).join(present, "filename", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def load_benchmark(spark, folder, key, project_id, schema=None):
    """(rows, registration row with the profile and the counts of small domains) of one benchmark dataset."""
    entry = next((e for e in BENCHMARK_DATASETS if e[0] == key), None)
    if entry is None:
        raise ValueError(f"Unknown dataset key: {key}")
    _, name, filename, target, sensitive, _, _, _ = entry
    path = os.path.join(folder, filename)
    df = read_dataset(spark, path, schema)
    here = [c for c in sensitive if c in df.columns]
    check_dataset(df, sensitive=here)
    return df, dataset_record(df, name, project_id, path, target if target in df.columns else None, here, value_counts=True)


def load_all(spark, folder, project_id):
    """(loaded datasets by key, failures by key); one failing does not stop the others."""
    loaded, failures = {}, {}
    for key, *_ in BENCHMARK_DATASETS:
        try:
            loaded[key] = load_benchmark(spark, folder, key, project_id)
        except Exception as exc:  # noqa: BLE001
            failures[key] = str(exc)
    return loaded, failures


def load_plan(choices, templates, known, existing, files) -> DataFrame:
    """What becomes of each dataset a project's template recommends.

    ``choices`` holds (project_id, template_id), ``existing`` (project_id, name)
    of datasets already there and ``files`` the file names at hand. The outcome
    is loaded, skipped_existing, missing_files or failed.
    """
    wanted = choices.join(templates.select("template_id", F.posexplode("recommended_datasets").alias("position", "dataset_key")), "template_id")
    facts = (
        wanted.join(known.select("dataset_key", "name", "filename"), "dataset_key", "left")
        .join(existing.select("project_id", "name").distinct().withColumn("there", F.lit(True)), ["project_id", "name"], "left")
        .join(files.select("filename").distinct().withColumn("present", F.lit(True)), "filename", "left")
    )
    outcome = (
        F.when(F.col("name").isNull(), "failed").when(F.col("there"), "skipped_existing")
        .when(F.col("present"), "loaded").otherwise("missing_files"))
    return facts.withColumn("outcome", outcome).select(
        "project_id", "template_id", "position", "dataset_key", "outcome",
        F.when(F.col("outcome") == "failed", F.concat(F.lit("Unknown dataset key: "), "dataset_key"))
        .when(F.col("outcome") == "missing_files", F.col("filename")).when(F.col("outcome") == "loaded", F.col("name"))
        .otherwise(F.col("dataset_key")).alias("detail"))
