import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probity.functions import ordering, text
from probity.operators import prep, profile


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("size", [1, 2, 999, 20000])
def test_medians_are_exact(spark, size):
    rng = np.random.default_rng(size)
    pdf = pd.DataFrame({
        "even": rng.normal(size=size), "hot": np.where(rng.random(size) < 0.4, 7.0, rng.integers(0, 20, size)),
        "wide": rng.lognormal(sigma=4, size=size)})
    got = {r["column"]: r["median"] for r in profile.medians(frame(spark, pdf), list(pdf)).collect()}
    for c in pdf:
        assert got[c] == pytest.approx(pdf[c].median(), abs=1e-12), c


def test_profile_of_missing_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, None, "a")], "k int, empty double, s string")
    rows = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert rows["empty"]["unique_count"] == 0 and rows["empty"]["null_percentage"] == 100.0
    assert rows["empty"]["min"] is None and rows["empty"]["median"] is None
    assert rows["s"]["unique_count"] == 1 and rows["s"]["null_percentage"] == 33.333
    assert rows["k"]["median"] == 2.0 and rows["k"]["std"] == 1.0
    top = {r["value"]: r["count"] for r in profile.top_values(df).collect()}
    assert top == {"a": 2, "<NULL>": 1}
    approximate = {r["column"]: r for r in profile.column_profile(df, approximate=True).collect()}
    assert approximate["k"]["unique_count"] == 3 and approximate["s"]["null_count"] == 1


def test_zeros_of_both_signs_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert profile.column_counts(df).first()["unique_count"] == 2


def test_first_appearance_matches_factorize(spark):
    rng = np.random.default_rng(1)
    values = rng.choice(["x", "y", "z", "w", None], 500)
    pdf = pd.DataFrame({"pos": rng.permutation(10 ** 9 // 500 * np.arange(500)), "v": values})
    ordered = pdf.sort_values("pos")
    want = dict(zip(ordered["pos"], pd.factorize(ordered["v"])[0]))
    got = prep.encode_first_appearance(frame(spark, pdf), "pos").collect()
    assert {r["pos"]: r["v"] for r in got} == want


def test_first_appearance_needs_an_integer_key(spark):
    df = spark.createDataFrame([("a", "b")], "k string, v string")
    with pytest.raises(ValueError):
        prep.encode_first_appearance(df, "k")


def test_rank_with_many_position_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "POSITIONS_PER_BUCKET", 7)
    df = spark.range(1000).select((F.col("id") * 37).alias("pos"), F.format_string("v%05d", "id").alias("value"), F.lit("k").alias("key"))
    got = ordering.rank_by_position(df, ["key"], "pos", "value").orderBy("code").collect()
    assert [r["value"] for r in got] == [f"v{i:05d}" for i in range(1000)]
    assert [r["code"] for r in got] == list(range(1000))


def test_alphabetical_rank_over_ranges(spark):
    values = [f"v{i % 211:03d}" for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    got = ordering.rank_distinct(df, "v").orderBy("v").collect()
    assert [r["v"] for r in got] == sorted(set(values))
    assert [r["code"] for r in got] == list(range(211))


def test_alphabetical_codes_match_categories(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")], "k int, v string")
    got = {r["k"]: r["v"] for r in prep.encode_alphabetical(df, "v").collect()}
    assert got == dict(zip(range(1, 6), pd.Categorical(["b", "a", None, "c", "a"]).codes.tolist()))


def test_split_is_exact_in_every_class_and_repeatable(spark):
    df = spark.range(5003).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise(0).alias("y"))
    out = prep.stratified_split(df, "y", "id")
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for y in (None, 0, 1):
        total = counts[(y, "train")] + counts[(y, "test")]
        assert counts[(y, "train")] == math.floor(total * 0.8)
    again = prep.stratified_split(df.repartition(7), "y", "id")
    assert out.exceptAll(again).count() == 0


def test_keyword_target(spark):
    texts = ["<=50K", ">50K", "HIGH risk", "no", None, "Approved", "2", "1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(prep.keyword_target("t")).collect()] == [0, 1, 1, 0, 0, 1, 0, 1]


def test_binarise_cuts_to_integers_first(spark):
    small = spark.createDataFrame([(0.9,), (1.0,), (0.0,)], "p double")
    assert [r["p"] for r in prep.binarise_predictions(small, "p").collect()] == [0, 1, 0]
    large = spark.createDataFrame([(2.0,), (0.9,), (1.0,)], "p double")
    assert [r["p"] for r in prep.binarise_predictions(large, "p").collect()] == [1, 0, 1]
    assert [r["p"] for r in prep.binarise_predictions(small, "p", score_threshold=0.5).collect()] == [1, 1, 0]


def test_alignment(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    assert prep.align_by_name(df, ["c", "x", "a"]).collect()[0].asDict() == {"c": 3.0, "x": 0.0, "a": 1.0}
    with pytest.raises(ValueError):
        prep.align_by_name(df, ["c", "x"], strict=True)
    assert prep.align_by_position(df, 2).columns == ["a", "b"]
    assert prep.align_by_position(df, 4).columns == ["a", "b", "c", "__pad_feature_0"]


def test_columns_dropped_for_the_model(spark):
    df = spark.createDataFrame([(1, 2, 3)], "x int, t int, s int")
    assert prep.model_features(df, "t", "s").columns == ["x", "s"]
    assert prep.model_features(df, None, "s").columns == ["x", "t"]
    assert prep.model_features(df, "gone", "s").columns == ["x", "t"]


def test_matrix_has_no_missing_or_infinite_values(spark):
    df = spark.createDataFrame(
        [(1, "b", float("inf"), True), (2, None, float("nan"), None), (3, "a", None, False), (4, "b", 5.0, True)],
        "k int, s string, x double, f boolean")
    rows = prep.numeric_matrix(df, "k").orderBy("k").collect()
    assert [r["s"] for r in rows] == [0.0, 1.0, 2.0, 0.0]
    assert [r["x"] for r in rows] == [0.0, 0.0, 0.0, 5.0]
    assert [r["f"] for r in rows] == [1.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("key,schema,rows,want", [
    ("adult_income", "income string", [(" >50K.",), ("<=50K",), (None,)], [1, 0, 0]),
    ("bank_marketing", "deposit string", [("YES",), ("no",), ("True",)], [1, 0, 1]),
    ("compas", "DecileScore string", [("7",), ("6",), ("N/A",), (None,)], [1, 0, 0, 0]),
    ("diabetes_readmission", "readmitted string", [("NO",), (">30",), (None,)], [0, 1, 1]),
    ("german_credit", "kredit int", [(1,), (2,), (None,)], [0, 1, 1]),
    ("german_credit", "Risk string", [("bad",), ("good",)], [1, 0]),
    ("german_credit", "kredit int, laufzeit int, hoehe int", [(1, 10, 10), (1, 20, 20), (1, 30, 5), (1, 5, 30), (1, 40, 40)], [0, 0, 0, 0, 1]),
])
def test_benchmark_labels(spark, key, schema, rows, want):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    assert [r["label"] for r in prep.benchmark_label(df, key).collect()] == want


def test_texts(spark):
    df = spark.createDataFrame([("=1+1",), ("-x",), ("ok",), ("\tq",), (None,)], "s string")
    assert [r[0] for r in df.select(text.guard_cell("s")).collect()] == ["'=1+1", "'-x", "ok", "'\tq", None]
    name = spark.createDataFrame([("loss (%) a-b.c",)], "m string").select(text.clean_metric_name("m")).first()[0]
    assert name == "loss_____a_b_c"
    kept = spark.createDataFrame([([None, "", "  ", " Keep monitoring "],)], "a array<string>").select(text.kept_texts("a")).first()[0]
    assert kept == ["Keep monitoring"]
