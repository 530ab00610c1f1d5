"""Local surrogates against plain weighted least squares over the same perturbed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import explain, surrogates

FEATURES = ["a", "b", "c", "d"]


def scorer(df):
    return df.withColumn("score", 1 / (1 + F.exp(-(F.col("a") - 2 * F.col("b") + 0.3 * F.col("a") * F.col("c")))))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.normal(size=2)), float(rng.integers(0, 3)), 7.0) for i in range(400)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double")


def drawn(spark, data, count, seed=42):
    cuts = surrogates.feature_cuts(data, FEATURES)
    return surrogates.Neighbourhood.drawn(
        surrogates.draws(spark, surrogates.feature_bins(data, FEATURES, cuts), FEATURES, scorer, count, seed), FEATURES)


def plain(near, bins, score, selected, ridge):
    """Weighted ridge regression with an intercept, written out."""
    z = np.vstack([np.ones(len(bins)), near.bins == bins])[:, selected].astype(float)
    every = np.vstack([np.ones(len(bins)), near.bins == bins]).astype(float)
    y = np.append(score, near.scores)
    w = np.sqrt(np.exp(-(len(bins) - every.sum(axis=1)) / (0.75 ** 2 * len(bins))))
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    beta = np.linalg.solve((zc * w[:, None]).T @ zc + ridge * np.eye(len(selected)), (zc * w[:, None]).T @ yc)
    c = np.average(y, weights=w) - np.average(z, axis=0, weights=w) @ beta
    error = yc - zc @ beta
    return beta, c, 1 - (w * error * error).sum() / (w * yc * yc).sum()


def test_bins_are_quartiles_of_the_training_rows(spark, data):
    pdf = data.toPandas()
    cuts = {r["column"]: r["cuts"] for r in surrogates.feature_cuts(data, FEATURES).collect()}
    for f in FEATURES:
        assert np.allclose(cuts[f], np.percentile(pdf[f], [25, 50, 75]))
    rows = surrogates.feature_bins(data, FEATURES, surrogates.feature_cuts(data, FEATURES)).collect()
    for r in rows:
        own = pdf[r["column"]][np.searchsorted(cuts[r["column"]], pdf[r["column"]]) == r["bin"]]
        assert r["size"] == len(own) and r["mean"] == pytest.approx(own.mean()) and r["std"] == pytest.approx(own.std(ddof=0), abs=1e-12)
        assert r["low"] <= own.min() and own.max() <= r["high"]
    assert sum(r["size"] for r in rows) == 4 * len(pdf)


def test_draws_follow_the_bins(spark, data):
    near = drawn(spark, data, 3000)
    assert near.bins.shape == (3000, 4) and not np.isnan(near.scores).any()
    assert np.allclose([(near.bins[:, 0] == b).mean() for b in range(4)], 0.25, atol=0.03)
    assert set(near.bins[:, 3]) == {0}
    again = drawn(spark, data, 3000)
    assert (again.bins == near.bins).all() and (again.scores == near.scores).all()
    assert (drawn(spark, data, 3000, seed=1).bins != near.bins).any()


@pytest.mark.parametrize("count, selection", [(10, "auto"), (2, "auto"), (2, "weights"), (3, "forward")])
def test_surrogates_are_weighted_ridge_fits(spark, data, count, selection):
    near = drawn(spark, data, 500)
    cuts = {r["column"]: r["cuts"] for r in surrogates.feature_cuts(data, FEATURES).collect()}
    rows = {r["id"]: r for r in scorer(data).collect()}
    out = surrogates.local_surrogates(data.where("id < 40"), "id", FEATURES, data, scorer, perturbations=500, num_features=count, selection=selection)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == set(range(40))
    for i, own in got.items():
        own.sort(key=lambda r: r["rank"])
        bins = np.array([np.searchsorted(cuts[f], rows[i][f]) for f in FEATURES])
        score = rows[i]["score"]
        every, _, _ = plain(near, bins, score, list(range(4)), 0.01)
        if selection == "weights" or count > 6:
            want = sorted(range(4), key=lambda j: -abs(every[j]))[:count]
        else:
            want = []
            for _ in range(count):
                best = max((j for j in range(4) if j not in want), key=lambda j: (round(plain(near, bins, score, [*want, j], 1e-9)[2], 9), -j))
                want.append(best)
        assert {r["feature"] for r in own} == {FEATURES[j] for j in want}
        beta, c, r2 = plain(near, bins, score, want, 1.0)
        sign = 1 if score >= 0.5 else -1
        for r in own:
            j = FEATURES.index(r["feature"])
            assert r["weight"] == pytest.approx(sign * beta[want.index(j)], abs=1e-9) and r["bin"] == bins[j]
            assert r["label"] == (score >= 0.5) and r["score"] == pytest.approx(max(score, 1 - score))
            assert r["surrogate"] == pytest.approx(c + beta.sum() if sign == 1 else 1 - c - beta.sum(), abs=1e-9)
            assert r["r2"] == pytest.approx(r2, abs=1e-9)
        assert [abs(r["weight"]) for r in own] == sorted((abs(r["weight"]) for r in own), reverse=True)


def test_forward_selection_sweeps_like_refitting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 7)) @ rng.normal(size=(7, 7))
    y = x @ rng.normal(size=7) + rng.normal(size=200)
    both = np.column_stack([x, y])
    gram = (both - both.mean(axis=0)).T @ (both - both.mean(axis=0))
    left, want = list(range(7)), []
    while left:
        def error(j):
            z = np.column_stack([np.ones(200), x[:, [*want, j]]])
            return np.linalg.lstsq(z, y, rcond=None)[1][0]
        want.append(min(left, key=error))
        left.remove(want[-1])
    assert surrogates.forward_selected(gram[None], 7)[0].tolist() == want
    constant = np.zeros((1, 3, 3))
    constant[0, 2, 2] = 1.0
    assert surrogates.forward_selected(constant, 2).tolist() == [[0, 1]]


def test_missing_values_and_scores(spark, data):
    rows = [(1, None, 0.0, 1.0, 7.0), (2, 0.5, 0.0, None, 7.0), (3, 0.5, 0.0, 1.0, 7.0)]
    some = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    filled = lambda df: scorer(df.withColumn("c", F.coalesce("c", F.lit(0.0))))
    out = surrogates.local_surrogates(some, "id", FEATURES, data, filled, perturbations=200).collect()
    assert {r["id"] for r in out} == {2, 3}  # the first has no score
    assert {(r["feature"], r["bin"]) for r in out if r["id"] == 2 and r["feature"] in ("c", "d")} == {("c", -1), ("d", 0)}
    assert all(abs(r["weight"]) < 1e-12 for r in out if r["feature"] == "d")
    none = surrogates.local_surrogates(some.where("id > 9"), "id", FEATURES, data, filled, perturbations=50)
    assert none.count() == 0 and surrogates.fidelity(none).first()["fidelity"] == 0.0


def test_fidelity_and_report(spark, data):
    out = surrogates.local_surrogates(data, "id", FEATURES, data, scorer, perturbations=300)
    rows = {r["id"]: abs(r["score"] - r["surrogate"]) for r in out.collect()}
    assert surrogates.fidelity(out).first()["fidelity"] == pytest.approx(1 - np.mean(list(rows.values())))
    labelled = scorer(data).withColumns({"prediction": (F.col("score") >= 0.5).cast("int"), "y": F.lit(1)}).drop("score")
    report = explain.transparency_report(labelled, "id", FEATURES, scorer, "y", with_surrogates=True, surrogate_rows=5, rows=5)
    assert report["surrogates"].select("id").distinct().count() == 5


def test_nothing_but_counts_is_shuffled(spark, data):
    out = surrogates.local_surrogates(data, "id", FEATURES, data, scorer, perturbations=50)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text.split("Subquery")[0] and "MapInArrow" in text
