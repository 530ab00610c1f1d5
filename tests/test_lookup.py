"""Joins and ranks on few values, many nulls and hot ranges."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probity.functions import lookup, ordering
from probity.operators import prep, profile


def skewed(spark, rows=40_000, parts=8):
    """99 % of the rows have one value, a fifth of another column is null, a third has many values."""
    return spark.range(0, rows, 1, parts).select(
        "id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("rare"), (F.col("id") % 3700).cast("string"))).otherwise("hot").alias("a"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).alias("b"),
        F.concat(F.lit("w"), (F.col("id") * 7 % 3000).cast("string")).alias("c"))


def largest_share(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_codes_of_hot_values_and_nulls_stay_spread(spark):
    df = skewed(spark)
    out = prep.encode_first_appearance(df, "id")
    assert largest_share(out) < 0.25
    pdf = df.toPandas().sort_values("id")
    got = out.toPandas().sort_values("id")
    for c in ("a", "b", "c"):
        assert (got[c].to_numpy() == pd.factorize(pdf[c])[0]).all()
    alphabetical = prep.encode_alphabetical(df, "b")
    assert largest_share(alphabetical) < 0.25
    assert {(r["b"]) for r in alphabetical.select("b").distinct().collect()} == set(range(-1, 7))


def test_heavy_keys_are_few(spark):
    values = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") < 10, 10_000).otherwise(1).alias("rows"))
    assert sorted(r["k"] for r in lookup.heavy_keys(values).collect()) == list(range(10))
    every = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("rows"))
    assert lookup.heavy_keys(every).count() == 50 and lookup.heavy_keys(every, share=0.1).count() == 0


@pytest.mark.parametrize("share", [1e-9, 1 / 1024, 2.0])
def test_looked_up_is_a_left_join(spark, share):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "x"), (3, None), (1, "x"), (9, "z")], "k int, s string")
    values = spark.createDataFrame([(1, "x", 10, 2), (2, "y", 20, 1), (3, "q", 30, 0)], "k int, s string, v int, rows int")
    got = sorted(map(tuple, lookup.looked_up(df, values, ["k", "s"], share=share).collect()), key=str)
    assert got == sorted([(1, "x", 10), (2, "y", 20), (None, "x", None), (3, None, None), (1, "x", 10), (9, "z", None)], key=str)


def test_order_statistics_of_many_ranges(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.lognormal(sigma=3, size=30_000), "hot": np.where(rng.random(30_000) < 0.6, 5.0, rng.normal(size=30_000)),
                        "one": 2.0, "hole": np.where(rng.random(30_000) < 0.5, np.nan, rng.integers(0, 9, 30_000))})
    df = spark.createDataFrame(pdf).withColumn("hole", F.nanvl("hole", F.lit(None).cast("double"))).repartition(7)
    fractions = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {(r["column"], r["fraction"]): r["value"] for r in ordering.order_statistics(profile.number_counts(df, list(pdf)), fractions).collect()}
    for c in pdf:
        for f in fractions:
            assert got[c, f] == pytest.approx(np.nanquantile(pdf[c], f), rel=1e-12), (c, f)
    empty = profile.number_counts(df.where("false"), ["x"])
    assert ordering.order_statistics(empty, [0.5]).count() == 0


def test_ranges_are_dealt_out_once(spark):
    """Both readers of the ranges read the same shuffle: else their numbers would not fit together."""
    df = spark.range(1000).select(F.col("id").cast("string").alias("v"))
    ranked = ordering.rank_unique(df, "v")
    assert [r["v"] for r in ranked.orderBy("code").collect()] == sorted(str(i) for i in range(1000))
    for frame in (ranked, ordering.order_statistics(profile.number_counts(spark.range(1000).toDF("x"), ["x"]), [0.5])):
        frame.collect()
        text = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert text.count("Exchange rangepartitioning") - text.count("ReusedExchange") <= 1


def test_profiles_of_long_texts_shuffle_keys_only(spark, small):
    long = spark.createDataFrame([("x" * 500 + str(i // 2),) for i in range(60)] + [("short",)] * 3 + [(None,), ("x" * 64,), ("x" * 65,)], "s string")
    row = profile.column_counts(long).first()
    assert (row["unique_count"], row["null_count"], row["rows"]) == (33, 1, 66)
    top = profile.top_values(long, limit=4).collect()
    assert [(r["value"], r["count"]) for r in top] == [
        ("short", 3), ("x" * 500 + "0", 2), ("x" * 500 + "1", 2), ("x" * 500 + "10", 2)]
    few = spark.createDataFrame([("y" * 300 + str(i % 3), i) for i in range(90)], "s string, k int")
    assert {(r["value"], r["count"]) for r in profile.small_domain_counts(few).collect()} == {("y" * 300 + str(i), 30) for i in range(3)}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for frame in (profile.column_profile(docs), profile.column_counts(docs)):
        plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
        sent = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
        assert sent and not any(re.search(r"\b(text|lang|source)#", columns) for columns in sent)


def test_top_values_when_all_begin_alike(spark, monkeypatch):
    monkeypatch.setattr(profile, "LISTED_KEYS", 3)
    texts = ["p" * 80 + f"{i:03d}" for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r["value"] for r in profile.top_values(df).orderBy("rank").collect()] == texts[:10]


def test_numbers_are_told_apart_exactly(spark):
    df = spark.createDataFrame([(2 ** 60, 0.1), (2 ** 60 + 1, -0.0), (2 ** 60 + 2, 0.0), (None, float("nan")), (None, float("nan"))], "k long, x double")
    rows = {r["column"]: r for r in profile.column_counts(df).collect()}
    assert rows["k"]["unique_count"] == 3 and rows["k"]["null_count"] == 2 and rows["x"]["unique_count"] == 3
    dates = spark.sql("SELECT DATE'2024-01-02' AS d, TIMESTAMP'2024-01-02 03:04:05.6' AS t, CAST(1.50 AS DECIMAL(9,2)) AS m, TRUE AS b, CAST(2.5 AS FLOAT) AS f")
    got = {r["column"]: r["value"] for r in profile.small_domain_counts(dates).collect()}
    assert got == {"d": "2024-01-02", "t": "2024-01-02 03:04:05.6", "m": "1.50", "b": "true", "f": "2.5"}
    assert {r["column"]: r["median"] for r in profile.numeric_stats(dates).collect()} == {"m": 1.5, "f": 2.5}
