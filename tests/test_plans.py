"""Properties of the physical plans that keep the queries scalable."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from probity.functions import partitioning
from probity.operators import fairness as fair
from probity.operators import history
from probity.sources.tables import table, view

QUERIES = entry.queries()
# Joins of a single row with a handful of rows, where the key is a constant.
ONE_ROW_JOINS = {"pii_custom_patterns", "privacy_recommendations"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ONE_ROW_JOINS - {"train_model_zoo"}))
def test_no_cross_join(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_flagship_reads_six_columns_and_shuffles_groups_once(spark, small):
    text = plan(QUERIES["fairness_report"](spark, small))
    columns = set(re.findall(r"(\w+):\w+", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", text))))
    assert columns == {"o_custkey", "o_orderstatus", "o_totalprice", "c_custkey", "c_nationkey", "c_mktsegment"}
    assert len(re.findall("Exchange hashpartitioning", text)) == 1
    assert "partial_count" in text


def test_filters_reach_the_scan(spark, small):
    text = plan(QUERIES["audit_log_page"](spark, small))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,error\)", text)
    assert "TakeOrderedAndProject" in text
    one = view(spark, small, "g_requirements").where("project_id = 3 AND status = 'active'").select("requirement_id")
    assert "p_retailprice" not in plan(one)


@pytest.mark.parametrize("name", ["history_suites", "top_values_orders", "pii_samples", "history_compare_runs"])
def test_ranks_are_cut_before_the_shuffle(spark, small, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, small))


def test_group_counts_are_combined_before_the_shuffle(spark):
    # One group holds nearly every row; each task sends one row per group.
    df = spark.range(0, 200000, 1, 8).select(
        F.when(F.col("id") % 1000 == 0, "rare").otherwise("hot").alias("sensitive"),
        (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") % 3 == 0).cast("int").alias("y_pred"))
    groups = fair.group_metrics(df)
    text = plan(groups)
    assert text.count("HashAggregate") == 2 and "partial_count" in text
    assert {r["group"]: r["n"] for r in groups.collect()} == {"hot": 199800, "rare": 200}


def test_newest_suites_of_a_hot_model(spark):
    suites = spark.range(5000).select(
        F.col("id").alias("suite_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("model_id"), F.col("id").alias("started_at"))
    # Model 0 has two thirds of the suites, every other model has one.
    assert [tuple(r) for r in history.latest_pairs(suites).collect()] == [(4997, 4999)]


def test_large_inputs_are_not_dealt_out(spark, small, monkeypatch):
    df = table(spark, small, "documents").select("text")
    assert "RepartitionByExpression" in partitioning.spread_small(df)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(partitioning, "BYTES_PER_CORE", 1)
    assert partitioning.spread_small(df) is df


def test_rows_of_an_iterative_fit_are_packed_into_few_tasks(spark):
    rows = spark.range(0, 1000, 1, 300).select("id", (F.col("id") % 2).alias("y")).persist()
    assert rows.count() == 1000
    few = partitioning.packed(rows)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, rows.collect()))
    coarse = spark.range(0, 1000, 1, 8).persist()
    assert coarse.count() == 1000 and partitioning.packed(coarse) is coarse


def test_parts_grow_in_number_with_the_input(spark, small, monkeypatch):
    results = view(spark, small, "g_results")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitioning.parted_by(results, "validation_id").rdd.getNumPartitions() == least
    monkeypatch.setattr(partitioning, "BYTES_PER_PART", partitioning.estimated_bytes(results) // 50)
    assert partitioning.parted_by(results, "validation_id").rdd.getNumPartitions() in (50, 51)
    text = plan(QUERIES["trace_history_results"](spark, small))
    assert re.search(r"hashpartitioning\(validation_id#\d+L, 5[01]\), REPARTITION_BY_NUM", text)


def test_rows_are_dealt_out_before_they_are_expanded(spark, small):
    text = plan(QUERIES["shap_global_importance"](spark, small))
    expanded = text[text.index("Generate explode(sequence"):]
    assert re.search(r"Exchange hashpartitioning\(.*, 4\), REPARTITION_BY_NUM", expanded)


def test_latest_results_are_combined_after_the_shuffle(spark, small):
    text = plan(QUERIES["remediation_checklists"](spark, small))
    latest = next(x for x in text.splitlines() if "partial_max_by(" in x)
    below = text[text.index(latest) + len(latest):]
    assert "REPARTITION_BY_NUM" in below.split("FileScan")[0]


def scans_of(text, column):
    return sum(f"{column}:" in schema for schema in re.findall(r"ReadSchema: struct<([^>\n]*)", text))


def test_steps_of_all_principles_read_each_table_once(spark, small):
    # Orders are read once as suites and once for each of the two kinds of artifacts.
    text = plan(QUERIES["remediation_steps"](spark, small))
    assert scans_of(text, "l_discount") == 1 and scans_of(text, "o_orderkey") == 3


def test_compared_runs_read_the_metrics_once(spark, small):
    assert scans_of(plan(QUERIES["history_compare_runs"](spark, small)), "l_discount") == 1


def test_recommendations_are_listed_without_a_shuffle_of_their_own(spark, small):
    text = plan(QUERIES["report_recommendations"](spark, small))
    assert text.count("Exchange hashpartitioning") == plan(QUERIES["report_certificate_checks"](spark, small)).count("Exchange hashpartitioning")
