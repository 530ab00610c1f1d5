"""Registered scoring, explanation, elicitation and template queries."""

from pyspark.sql import functions as F

from probity.functions import constants as C
from probity.functions import template_catalog as catalog
from probity.operators import elicit, explain, scoring, surrogates, templates, training, trees
from probity.operators.prep import sample_rows
from probity.plans.registry import register
from probity.sources import benchmarks
from probity.sources.tables import table, view, with_views

FEATURES = ("price", "balance", "nation")
MODEL = scoring.LinearModel(FEATURES, (0.4, -0.2, 0.05), -1.0)
SCORE_SQL = "-1.0::DOUBLE + 0.4 * price + -0.2 * balance + 0.05 * nation"


def loans(spark, directory):
    return view(spark, directory, "loans")


def scored_loans(spark, directory):
    return MODEL.transform(loans(spark, directory))


def probability(df):
    return df.withColumn("score", scoring.sigmoid(MODEL.score()))


SCORED_SQL = f""", scored AS (SELECT *, {SCORE_SQL} AS z, CASE WHEN {SCORE_SQL} >= 0 THEN 1 ELSE 0 END AS prediction,
        1 / (1 + EXP(-({SCORE_SQL}))) AS probability FROM loans)"""


def loans_sql(body):
    return with_views("", "loans") + SCORED_SQL + body


# --- Scoring ------------------------------------------------------------------

@register("score_linear", loans_sql(
    " SELECT row_id, ROUND(z, 6) AS score, prediction, ROUND(probability, 6) AS probability FROM scored"))
def score_linear(spark, directory):
    out = scored_loans(spark, directory)
    return out.select("row_id", F.round("score", 6).alias("score"), "prediction", F.round("probability", 6).alias("probability"))


@register("score_python_model", loans_sql(
    " SELECT row_id, prediction, ROUND(probability, 6) AS probability FROM scored"))
def score_python_model(spark, directory):
    def predict(batch):
        import numpy as np

        z = -1.0 + 0.4 * batch["price"] - 0.2 * batch["balance"] + 0.05 * batch["nation"]
        return batch.assign(prediction=(z >= 0).astype("int32"), probability=1 / (1 + np.exp(-z)))[["prediction", "probability"]]

    df = loans(spark, directory).select("row_id", *FEATURES)
    out = scoring.score_with(df, FEATURES, predict, "prediction int, probability double")
    return out.select("row_id", "prediction", F.round("probability", 6).alias("probability"))


@register("score_softmax", with_views("""
    SELECT row_id, ROUND(EXP(price) / (EXP(price) + EXP(balance) + EXP(1.0)), 6)::DOUBLE AS p0,
           ROUND(EXP(balance) / (EXP(price) + EXP(balance) + EXP(1.0)), 6)::DOUBLE AS p1,
           ROUND(EXP(1.0) / (EXP(price) + EXP(balance) + EXP(1.0)), 6)::DOUBLE AS p2 FROM loans""", "loans"))
def score_softmax(spark, directory):
    p = scoring.softmax(F.array("price", "balance", F.lit(1.0)))
    return loans(spark, directory).withColumn("p", p).select(
        "row_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


@register("score_one_hot", """
    SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS p0,
           CASE WHEN c_nationkey % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS p1, CASE WHEN c_nationkey % 3 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS p2
    FROM customer""")
def score_one_hot(spark, directory):
    p = scoring.one_hot(F.col("c_nationkey") % 3, 3)
    return table(spark, directory, "customer").withColumn("p", p).select(
        "c_custkey", *[F.col("p")[i].alias(f"p{i}") for i in range(3)])


@register("score_evaluation", loans_sql("""
    SELECT segment, COUNT(*) AS "rows", ROUND(AVG(CASE WHEN y_true = prediction THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy,
           ROUND(COALESCE(SUM(y_true * prediction)::DOUBLE / NULLIF(SUM(prediction), 0), 0), 6) AS "precision",
           ROUND(COALESCE(SUM(y_true * prediction)::DOUBLE / NULLIF(SUM(y_true), 0), 0), 6) AS recall,
           ROUND(COALESCE(2.0 * SUM(y_true * prediction)::DOUBLE / NULLIF(SUM(y_true) + SUM(prediction), 0), 0), 6) AS f1
    FROM scored GROUP BY segment"""))
def score_evaluation(spark, directory):
    out = scoring.evaluation(scored_loans(spark, directory), keys=["segment"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@register("class_balance", """SELECT quality AS label, COUNT(*) AS "rows" FROM labels GROUP BY quality""")
def class_balance(spark, directory):
    return scoring.class_balance(table(spark, directory, "labels"), "quality")


@register("train_model_zoo")
def train_model_zoo(spark, directory):
    df = loans(spark, directory).select("row_id", "y_true", *FEATURES)
    _, quality, _ = training.train_zoo(df, FEATURES, "y_true", "row_id")
    return quality


# --- Explanations ---------------------------------------------------------------

BG_SQL = ", bg AS (SELECT price, balance, nation FROM loans ORDER BY MD5(row_id || ':42'), row_id LIMIT 100)"
MEANS_SQL = BG_SQL + ", means AS (SELECT AVG(price) AS mp, AVG(balance) AS mb, AVG(nation) AS mn FROM bg)"
PHI_SQL = "0.4 * (price - mp) AS phi_price, -0.2 * (balance - mb) AS phi_balance, 0.05 * (nation - mn) AS phi_nation"


def linear_values(spark, directory):
    df = loans(spark, directory)
    means = explain.feature_means(explain.background(df, "row_id", FEATURES), FEATURES)
    return explain.linear_shap(df, MODEL, means, keep=["row_id"])


@register("shap_linear", loans_sql(MEANS_SQL + f"""
    SELECT row_id, ROUND(z, 6) AS score, ROUND(-1.0::DOUBLE + 0.4 * mp + -0.2 * mb + 0.05 * mn, 6)::DOUBLE AS base_value,
           ROUND(0.4 * (price - mp), 6)::DOUBLE AS phi_price, ROUND(-0.2 * (balance - mb), 6)::DOUBLE AS phi_balance,
           ROUND(0.05 * (nation - mn), 6)::DOUBLE AS phi_nation, prediction, ROUND(probability, 6)::DOUBLE AS probability FROM scored, means"""))
def shap_linear(spark, directory):
    out = linear_values(spark, directory)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "row_id"])


@register("shap_linear_importance", loans_sql(MEANS_SQL + f"""
    , phi AS (SELECT {PHI_SQL} FROM loans, means)
    SELECT feature, ROUND(v, 6)::DOUBLE AS importance, CAST(ROW_NUMBER() OVER (ORDER BY v DESC, feature) AS INTEGER) AS "rank" FROM (
        SELECT 'price' AS feature, AVG(ABS(phi_price)) AS v FROM phi UNION ALL SELECT 'balance', AVG(ABS(phi_balance)) FROM phi
        UNION ALL SELECT 'nation', AVG(ABS(phi_nation)) FROM phi)"""))
def shap_linear_importance(spark, directory):
    return explain.global_importance(linear_values(spark, directory), FEATURES).withColumn("importance", F.round("importance", 6))


GAME_SQL = loans_sql(BG_SQL + """
    , chosen AS (SELECT row_id, price, balance, nation FROM loans),
    games AS (
        SELECT c.row_id, m.mask, (m.mask & 1) + ((m.mask >> 1) & 1) + ((m.mask >> 2) & 1) AS size,
               1 / (1 + EXP(-(-1.0::DOUBLE + 0.4 * CASE WHEN m.mask & 1 = 1 THEN c.price ELSE b.price END
                   + -0.2 * CASE WHEN m.mask & 2 = 2 THEN c.balance ELSE b.balance END
                   + 0.05 * CASE WHEN m.mask & 4 = 4 THEN c.nation ELSE b.nation END))) AS v
        FROM chosen c CROSS JOIN (SELECT UNNEST(RANGE(8)) AS mask) m CROSS JOIN bg b),
    worth AS (SELECT row_id, mask, size, AVG(v) AS v,
               CASE size WHEN 1 THEN 1.0 / 3 WHEN 2 THEN 1.0 / 6 WHEN 3 THEN 1.0 / 3 END AS gain,
               CASE size WHEN 0 THEN 1.0 / 3 WHEN 1 THEN 1.0 / 6 WHEN 2 THEN 1.0 / 3 END AS loss FROM games GROUP BY row_id, mask, size),
    phi AS (SELECT row_id, MAX(CASE WHEN size = 0 THEN v END) AS base_value, MAX(CASE WHEN size = 3 THEN v END) AS score,
               SUM(v * CASE WHEN mask & 1 = 1 THEN gain ELSE -loss END) AS phi_price,
               SUM(v * CASE WHEN mask & 2 = 2 THEN gain ELSE -loss END) AS phi_balance,
               SUM(v * CASE WHEN mask & 4 = 4 THEN gain ELSE -loss END) AS phi_nation FROM worth GROUP BY row_id)""")


def game_values(spark, directory):
    df = loans(spark, directory)
    sample = explain.background(df, "row_id", FEATURES)
    return explain.shapley_values(df, "row_id", FEATURES, sample, probability)


@register("shap_any_model", GAME_SQL + """
    SELECT row_id, ROUND(base_value, 6)::DOUBLE AS base_value, ROUND(score, 6)::DOUBLE AS score, ROUND(phi_price, 6)::DOUBLE AS phi_price,
           ROUND(phi_balance, 6)::DOUBLE AS phi_balance, ROUND(phi_nation, 6)::DOUBLE AS phi_nation, 'exact' AS method,
           CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM phi""")
def shap_any_model(spark, directory):
    out = game_values(spark, directory)
    return out.withColumns({c: F.round(c, 6) for c in ("base_value", "score", *[f"phi_{f}" for f in FEATURES])})


#: Three small trees: (value, feature, threshold, left, right) by node.
OWN_TREES = (
    {0: (0, 0, 1.2, 1, 2), 1: (0, 1, 3.0, 3, 4), 2: (0.5, -1, 0, -1, -1), 3: (0.05, -1, 0, -1, -1), 4: (0.2, -1, 0, -1, -1)},
    {0: (0, 2, 11.5, 1, 2), 1: (0, 0, 0.9, 3, 4), 2: (0, 0, 1.8, 5, 6), 3: (0.02, -1, 0, -1, -1), 4: (0.25, -1, 0, -1, -1),
     5: (0.1, -1, 0, -1, -1), 6: (0.3, -1, 0, -1, -1)},
    {0: (0, 1, 5.0, 1, 2), 1: (0.08, -1, 0, -1, -1), 2: (0, 1, 8.0, 3, 4), 3: (0.15, -1, 0, -1, -1), 4: (0.2, -1, 0, -1, -1)},
)
TREES_SQL = """CASE WHEN {price} <= 1.2 THEN CASE WHEN {balance} <= 3 THEN 0.05 ELSE 0.2 END ELSE 0.5 END::DOUBLE
    + CASE WHEN {nation} <= 11.5 THEN CASE WHEN {price} <= 0.9 THEN 0.02 ELSE 0.25 END WHEN {price} <= 1.8 THEN 0.1 ELSE 0.3 END::DOUBLE
    + CASE WHEN {balance} <= 5 THEN 0.08 WHEN {balance} <= 8 THEN 0.15 ELSE 0.2 END::DOUBLE"""
_LOGISTIC = GAME_SQL[GAME_SQL.index("1 / (1 + EXP(-(-1.0::DOUBLE + 0.4 * CASE"):GAME_SQL.index(" AS v\n        FROM chosen")]
TREE_GAME_SQL = GAME_SQL.replace(_LOGISTIC, TREES_SQL.format(
    price="CASE WHEN m.mask & 1 = 1 THEN c.price ELSE b.price END", balance="CASE WHEN m.mask & 2 = 2 THEN c.balance ELSE b.balance END",
    nation="CASE WHEN m.mask & 4 = 4 THEN c.nation ELSE b.nation END"))


@register("shap_tree_ensemble", TREE_GAME_SQL + """
    SELECT row_id, ROUND(base_value, 6)::DOUBLE AS base_value, ROUND(score, 6)::DOUBLE AS score, ROUND(phi_price, 6)::DOUBLE AS phi_price,
           ROUND(phi_balance, 6)::DOUBLE AS phi_balance, ROUND(phi_nation, 6)::DOUBLE AS phi_nation,
           CASE WHEN ROUND(score, 6) >= 0.5 THEN 1 ELSE 0 END AS prediction, ROUND(score, 6)::DOUBLE AS probability FROM phi""")
def shap_tree_ensemble(spark, directory):
    df = loans(spark, directory)
    ensemble = trees.TreeEnsemble.of_nodes(FEATURES, OWN_TREES)
    out = trees.tree_shap(df, "row_id", ensemble, explain.background(df, "row_id", FEATURES), threshold=0.5 - 1e-9)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("row_id", "prediction")})


@register("shap_forest", "SELECT o_orderkey AS row_id, TRUE AS adds_up, TRUE AS same_probability, TRUE AS same_class FROM orders JOIN customer ON o_custkey = c_custkey")
def shap_forest(spark, directory):
    """Every loan's values under a trained forest of 200 trees, held against the model's own scores."""
    df = loans(spark, directory).select("row_id", "y_true", *FEATURES)
    model = training.estimators(FEATURES, "y_true")["random_forest"].fit(df)
    ensemble = trees.TreeEnsemble.of_model(model.stages[-1], FEATURES, spark)
    values = trees.tree_shap(scoring.score_pipeline(df, model), "row_id", ensemble, explain.background(df, "row_id", FEATURES),
                             keep={"prediction": "model_class", "probability": "model_probability"})
    total = sum((F.col(f"phi_{f}") for f in FEATURES), F.col("base_value"))
    return values.select(
        "row_id", (F.abs(total - F.col("score")) < 1e-9).alias("adds_up"),
        (F.abs(F.col("probability") - F.col("model_probability")) < 1e-9).alias("same_probability"),
        ((F.col("prediction") == F.col("model_class")) | (F.abs(F.col("probability") - 0.5) < 1e-9)).alias("same_class"))


@register("shap_global_importance", GAME_SQL + """
    SELECT feature, ROUND(v, 6)::DOUBLE AS importance, CAST(ROW_NUMBER() OVER (ORDER BY v DESC, feature) AS INTEGER) AS "rank" FROM (
        SELECT 'price' AS feature, AVG(ABS(phi_price)) AS v FROM phi UNION ALL SELECT 'balance', AVG(ABS(phi_balance)) FROM phi
        UNION ALL SELECT 'nation', AVG(ABS(phi_nation)) FROM phi)""")
def shap_global_importance(spark, directory):
    return explain.global_importance(game_values(spark, directory), FEATURES).withColumn("importance", F.round("importance", 6))


@register("shap_top_features", GAME_SQL + """
    SELECT feature, ROUND(v, 6)::DOUBLE AS importance FROM (
        SELECT 'price' AS feature, AVG(ABS(phi_price)) AS v FROM phi UNION ALL SELECT 'balance', AVG(ABS(phi_balance)) FROM phi
        UNION ALL SELECT 'nation', AVG(ABS(phi_nation)) FROM phi) ORDER BY v DESC, feature LIMIT 2""")
def shap_top_features(spark, directory):
    importance = explain.global_importance(game_values(spark, directory), FEATURES)
    return explain.top_features(importance, 2).select("feature", F.round("importance", 6).alias("importance"))


@register("explain_sample_predictions", loans_sql(MEANS_SQL + """
    , five AS (SELECT * FROM scored, means ORDER BY MD5(row_id || ':42'), row_id LIMIT 5),
    parts AS (SELECT row_id, y_true, prediction, -1.0::DOUBLE + 0.4 * mp + -0.2 * mb + 0.05 * mn AS base_value, 'price' AS feature, price AS value, 0.4 * (price - mp) AS c FROM five
        UNION ALL SELECT row_id, y_true, prediction, -1.0::DOUBLE + 0.4 * mp + -0.2 * mb + 0.05 * mn, 'balance', balance, -0.2 * (balance - mb) FROM five
        UNION ALL SELECT row_id, y_true, prediction, -1.0::DOUBLE + 0.4 * mp + -0.2 * mb + 0.05 * mn, 'nation', nation, 0.05 * (nation - mn) FROM five)
    SELECT row_id, y_true AS true_label, prediction AS predicted_label, y_true = prediction AS correct, ROUND(base_value, 6)::DOUBLE AS base_value,
           CAST(ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY ABS(c) DESC, feature) AS INTEGER) AS "rank", feature,
           ROUND(value, 6)::DOUBLE AS value, ROUND(c, 6)::DOUBLE AS contribution FROM parts"""))
def explain_sample_predictions(spark, directory):
    five = sample_rows(scored_loans(spark, directory), "row_id", 5)
    out = explain.sample_predictions(five, linear_values(spark, directory).select("row_id", "base_value", *[
        f"phi_{f}" for f in FEATURES]), "row_id", FEATURES, "y_true", "prediction")
    return out.withColumns({c: F.round(c, 6) for c in ("base_value", "value", "contribution")})


@register("explain_zero_warning", loans_sql(MEANS_SQL + f"""
    , phi AS (SELECT {PHI_SQL} FROM loans, means)
    SELECT 'shap' AS "method", CASE WHEN MAX(GREATEST(ABS(phi_price), ABS(phi_balance), ABS(phi_nation))) <= 1e-12
           THEN 'All contributions are zero — model may be constant or feature mismatch detected' END AS warning FROM phi
    UNION ALL SELECT 'constant', 'All contributions are zero — model may be constant or feature mismatch detected'"""))
def explain_zero_warning(spark, directory):
    values = explain.long_values(linear_values(spark, directory), "row_id", FEATURES)
    both = values.select(F.lit("shap").alias("method"), "contribution").unionByName(
        values.select(F.lit("constant").alias("method"), (F.col("contribution") * 0).alias("contribution")))
    return explain.zero_warning(both)


def _hash_sql(text):
    return f"((('0x' || SUBSTRING(MD5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


_Z = ("price", "balance", "nation")
#: The perturbed rows, the sums over them per cell of bins, and every row's system with the row itself as one more sample.
SURROGATE_SQL = f"""
    , long AS (""" + " UNION ALL ".join(f"SELECT row_id, '{f}' AS f, {f} AS v FROM loans" for f in _Z) + f"""),
    cuts AS (SELECT f, QUANTILE_CONT(v, [0.25, 0.5, 0.75]) AS q FROM long GROUP BY f),
    binned AS MATERIALIZED (SELECT row_id, long.f, v, q, (q[1] < v)::INT + (q[2] < v)::INT + (q[3] < v)::INT AS bin FROM long JOIN cuts ON long.f = cuts.f),
    bins AS (SELECT f, bin, COUNT(*) AS size, AVG(v) AS mean, STDDEV_POP(v) AS std,
               CASE WHEN bin = 0 THEN MIN(v) ELSE ANY_VALUE(q)[bin] END AS low, CASE WHEN bin = 3 THEN MAX(v) ELSE ANY_VALUE(q)[bin + 1] END AS high
        FROM binned GROUP BY f, bin),
    listed AS (SELECT *, SUM(size) OVER (PARTITION BY f ORDER BY bin) AS upto, SUM(size) OVER (PARTITION BY f) AS total FROM bins),
    asked AS (SELECT n, f, {_hash_sql("n || ':' || f || ':bin:42'")} AS u FROM (SELECT UNNEST(RANGE(1, 5001)) AS n), cuts),
    picked AS MATERIALIZED (SELECT n, l.* FROM asked JOIN listed l ON asked.f = l.f AND l.upto > u * l.total AND l.upto - l.size <= u * l.total),
    tried AS (SELECT n, f, k, mean + std * (SQRT(-2 * LN({_hash_sql("n || ':' || f || ':' || k || ':u:42'")})) * COS(2 * PI() * {_hash_sql("n || ':' || f || ':' || k || ':v:42'")})) AS v,
               low, high FROM picked, (SELECT UNNEST(RANGE(1, 17)) AS k)),
    firsts AS (SELECT n, f, ARG_MIN(v, k) AS v FROM tried WHERE v BETWEEN low AND high GROUP BY n, f),
    drawn AS (SELECT p.n, p.f, p.bin, COALESCE(firsts.v, (p.low + p.high) / 2) AS v FROM picked p LEFT JOIN firsts ON p.n = firsts.n AND p.f = firsts.f),
    draws AS MATERIALIZED (SELECT *, 1 / (1 + EXP(-(-1.0::DOUBLE + 0.4 * price + -0.2 * balance + 0.05 * nation))) AS y FROM (
        SELECT n, """ + ", ".join(f"MAX(CASE WHEN f = '{f}' THEN v END) AS {f}, MAX(CASE WHEN f = '{f}' THEN bin END) AS b{i}" for i, f in enumerate(_Z)) + f"""
        FROM drawn GROUP BY n)),
    own AS MATERIALIZED (SELECT s.row_id, s.probability AS y, """ + ", ".join(
        f"MAX(CASE WHEN f = '{f}' THEN bin END) AS b{i}" for i, f in enumerate(_Z)) + """ FROM scored s JOIN binned b ON s.row_id = b.row_id GROUP BY s.row_id, s.probability),
    weighted AS (SELECT b0, b1, b2, z0, z1, z2, y, EXP(-(3 - z0 - z1 - z2) / (2 * 0.5625 * 3)) AS w FROM (
        SELECT c.*, d.y, (d.b0 = c.b0)::INT::DOUBLE AS z0, (d.b1 = c.b1)::INT::DOUBLE AS z1, (d.b2 = c.b2)::INT::DOUBLE AS z2
        FROM (SELECT DISTINCT b0, b1, b2 FROM own) c, draws d)),
    cells AS MATERIALIZED (SELECT b0, b1, b2, SUM(w) AS s, SUM(w * y) AS t, SUM(w * y * y) AS tt,
        """ + ", ".join(f"SUM(w * z{i}) AS s{i}, SUM(w * z{i} * y) AS t{i}" for i in range(3)) + """,
        SUM(w * z0 * z1) AS s01, SUM(w * z0 * z2) AS s02, SUM(w * z1 * z2) AS s12 FROM weighted GROUP BY b0, b1, b2),
    joined AS (SELECT o.row_id, o.y, o.b0, o.b1, o.b2, s + 1 AS s, t + y AS t, tt + y * y AS tt, """ + ", ".join(
        f"s{i} + 1 AS s{i}, t{i} + y AS t{i}" for i in range(3)) + """, s01 + 1 AS s01, s02 + 1 AS s02, s12 + 1 AS s12
        FROM own o JOIN cells c ON o.b0 = c.b0 AND o.b1 = c.b1 AND o.b2 = c.b2),
    gram AS (SELECT *, """ + ", ".join(f"s{i} - s{i} * s{i} / s AS a{i}{i}, t{i} - s{i} * t / s AS y{i}" for i in range(3)) + """,
        s01 - s0 * s1 / s AS a01, s02 - s0 * s2 / s AS a02, s12 - s1 * s2 / s AS a12, tt - t * t / s AS spread FROM joined)"""

#: All three features: the ridge system by determinants.
THREE_SQL = """
    , det AS (SELECT *, a00 + 1 AS r0, a11 + 1 AS r1, a22 + 1 AS r2 FROM gram),
    solved AS (SELECT *, (y0 * (r1 * r2 - a12 * a12) - a01 * (y1 * r2 - a12 * y2) + a02 * (y1 * a12 - r1 * y2)) / d AS w0,
        (r0 * (y1 * r2 - a12 * y2) - y0 * (a01 * r2 - a12 * a02) + a02 * (a01 * y2 - y1 * a02)) / d AS w1,
        (r0 * (r1 * y2 - y1 * a12) - a01 * (a01 * y2 - y1 * a02) + y0 * (a01 * a12 - r1 * a02)) / d AS w2
        FROM (SELECT *, r0 * (r1 * r2 - a12 * a12) - a01 * (a01 * r2 - a12 * a02) + a02 * (a01 * a12 - r1 * a02) AS d FROM det)),
    ready AS (SELECT *, (t - w0 * s0 - w1 * s1 - w2 * s2) / s AS c, CASE WHEN y >= 0.5 THEN 1 ELSE 0 END AS label,
        1 - (spread - 2 * (w0 * y0 + w1 * y1 + w2 * y2) + w0 * w0 * a00 + w1 * w1 * a11 + w2 * w2 * a22
             + 2 * (w0 * w1 * a01 + w0 * w2 * a02 + w1 * w2 * a12)) / spread AS fit FROM solved)"""


@register("explain_local_surrogates", loans_sql(SURROGATE_SQL + THREE_SQL + """
    SELECT row_id, label, ROUND(ABS(1 - label - y), 6)::DOUBLE AS score, ROUND(ABS(1 - label - (c + w0 + w1 + w2)), 6)::DOUBLE AS surrogate,
           ROUND(CASE label WHEN 1 THEN c ELSE 1 - c END, 6)::DOUBLE AS intercept, ROUND(fit, 6)::DOUBLE AS r2,
           CAST(ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY ABS(w) DESC) AS INTEGER) AS "rank", feature, bin,
           ROUND((2 * label - 1) * w, 6)::DOUBLE AS weight
    FROM (SELECT *, UNNEST(['price', 'balance', 'nation']) AS feature, UNNEST([b0, b1, b2]) AS bin, UNNEST([w0, w1, w2]) AS w FROM ready)"""))
def explain_local_surrogates(spark, directory):
    out = surrogates_of(spark, directory)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "surrogate", "intercept", "r2", "weight")})


def surrogates_of(spark, directory, **options):
    df = loans(spark, directory)
    return surrogates.local_surrogates(df, "row_id", FEATURES, df, probability, **options)


#: One feature chosen by the fit it gives, then its ridge weight.
@register("explain_surrogate_feature", loans_sql(SURROGATE_SQL + """
    , gains AS (SELECT row_id, y, s, t, feature, bin, a, b, m FROM (
        SELECT row_id, y, s, t, UNNEST(['price', 'balance', 'nation']) AS feature, UNNEST([b0, b1, b2]) AS bin, UNNEST([a00, a11, a22]) AS a,
               UNNEST([y0, y1, y2]) AS b, UNNEST([s0, s1, s2]) AS m, UNNEST([1, 2, 3]) AS place FROM gram)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY b * b / a DESC, place) = 1)
    SELECT row_id, feature, bin, ROUND(CASE WHEN y >= 0.5 THEN b / (a + 1) ELSE -b / (a + 1) END, 6)::DOUBLE AS weight FROM gains"""))
def explain_surrogate_feature(spark, directory):
    out = surrogates_of(spark, directory, num_features=1)
    return out.select("row_id", "feature", "bin", F.round("weight", 6).alias("weight"))


@register("explain_fidelity", loans_sql(SURROGATE_SQL + THREE_SQL + """
    SELECT ROUND(GREATEST(0, LEAST(1, 1 - AVG(ABS(y - (c + w0 + w1 + w2))))), 6)::DOUBLE AS fidelity FROM ready"""))
def explain_fidelity(spark, directory):
    return surrogates.fidelity(surrogates_of(spark, directory)).select(F.round("fidelity", 6).alias("fidelity"))


@register("explain_model_card", loans_sql("""
    SELECT ROUND(AVG(CASE WHEN y_true = prediction THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy,
           ROUND(SUM(y_true * prediction)::DOUBLE / SUM(prediction), 6) AS "precision", ROUND(SUM(y_true * prediction)::DOUBLE / SUM(y_true), 6) AS recall,
           COUNT(*) AS evaluation_rows, (SELECT COUNT(*) FROM loans) AS training_rows, 3 AS features FROM scored"""))
def explain_model_card(spark, directory):
    scored = scored_loans(spark, directory)
    card = explain.model_card(loans(spark, directory), scored, FEATURES, "y_true", "prediction", {"framework": "linear"})
    return card.select(
        *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")], "evaluation_rows", "training_rows",
        F.size("features").alias("features"))


@register("explain_transparency_checks", loans_sql("""
    SELECT 'global_explanation' AS "check", FALSE AS passed, 'Documented 3 features (required: 5)' AS details
    UNION ALL SELECT 'local_explanation', COUNT(*) > 0, 'Successfully generated local SHAP explanation' FROM scored
    UNION ALL SELECT 'model_card', COUNT(*) > 0, 'Model card generated successfully' FROM scored"""))
def explain_transparency_checks(spark, directory):
    report = explain.transparency_report(
        scored_loans(spark, directory), "row_id", FEATURES, probability, "y_true", "prediction")
    return report["checks"]


# --- Elicitation -------------------------------------------------------------------

@register("elicit_imbalance", """
    SELECT c AS "column", COUNT(*) AS classes, ROUND(1 - MIN(n)::DOUBLE / SUM(n), 6)::DOUBLE AS imbalance FROM (
        SELECT 'o_orderstatus' AS c, o_orderstatus AS v, COUNT(*) AS n FROM orders GROUP BY o_orderstatus
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, COUNT(*) FROM orders GROUP BY o_custkey) GROUP BY c""")
def elicit_imbalance(spark, directory):
    out = elicit.imbalance_ratios(table(spark, directory, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])
    return out.withColumn("imbalance", F.round("imbalance", 6))


@register("elicit_proxies", """
    WITH source AS (
        SELECT DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS code, c_mktsegment, c_custkey, c_nationkey, c_acctbal,
               LENGTH(c_mktsegment) AS name_length FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT 'c_custkey' AS "column", ROUND(CORR(code, c_custkey), 6)::DOUBLE AS correlation, COUNT(*) AS shared_rows, ABS(CORR(code, c_custkey)) > 0.5 AS is_proxy FROM source
    UNION ALL SELECT 'c_nationkey', ROUND(CORR(code, c_nationkey), 6), COUNT(*), ABS(CORR(code, c_nationkey)) > 0.5 FROM source
    UNION ALL SELECT 'c_acctbal', ROUND(CORR(code, c_acctbal), 6), COUNT(*), ABS(CORR(code, c_acctbal)) > 0.5 FROM source
    UNION ALL SELECT 'name_length', ROUND(CORR(code, name_length), 6), COUNT(*), ABS(CORR(code, name_length)) > 0.5 FROM source""")
def elicit_proxies(spark, directory):
    df = table(spark, directory, "customer").withColumn("name_length", F.length("c_mktsegment"))
    df = df.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    out = elicit.proxy_correlations(df, "c_mktsegment")
    return out.withColumn("correlation", F.round("correlation", 6))


def dataset_checks_sql(source, attributes, numeric, limit, columns, most_columns):
    """The checks of ``source``; ``attributes`` is {name: is text}, ``numeric`` the numeric columns in order."""
    parts = []
    for position, (a, text) in enumerate(attributes.items(), 1):
        code = f"DENSE_RANK() OVER (ORDER BY {a}) - 1" if text else f"{a}::DOUBLE"
        pairs = " UNION ALL ".join(
            f"SELECT {i} AS i, '{c}' AS c, CORR(code, {c}) AS r, COUNT({c}) AS n FROM (SELECT *, {code} AS code FROM {source} WHERE {a} IS NOT NULL)"
            for i, c in enumerate(numeric) if c != a)
        parts.append(f"""SELECT {position} AS position, '{a}' AS a, (SELECT 1 - MIN(n)::DOUBLE / SUM(n) FROM (
                SELECT COUNT(*) AS n FROM {source} WHERE {a} IS NOT NULL GROUP BY {a})) AS v,
            (SELECT COALESCE(LIST(c ORDER BY i), []::VARCHAR[]) FROM ({pairs}) WHERE ABS(r) > 0.5 AND n >= 10) AS proxies""")
    return f"""
    shares AS ({" UNION ALL ".join(parts)}),
    checks AS (
        SELECT 0 AS position, 'dataset_pii_detection' AS check_id, 'triggered' AS status, 1.0::DOUBLE AS value, NULL::DOUBLE AS threshold,
               'Detected potential PII columns: c_name' AS reason, '{{"pii_columns":["c_name"]}}' AS metadata
        UNION ALL SELECT position, 'dataset_imbalance_' || a, CASE WHEN v > {limit} THEN 'triggered' ELSE 'not_triggered' END, ROUND(v, 4)::DOUBLE, {limit},
               CASE WHEN v > {limit} THEN printf('Imbalance %.2f exceeded threshold {limit:.2f} for ''%s''.', v, a)
                    || CASE WHEN LEN(proxies) > 0 THEN ' Columns that may stand in for it: ' || ARRAY_TO_STRING(proxies, ', ') || '.' ELSE '' END
                    ELSE printf('Imbalance %.2f is within threshold {limit:.2f} for ''%s''.', v, a) END,
               CASE WHEN v > {limit} THEN '{{"proxy_variables":[' || ARRAY_TO_STRING(LIST_TRANSFORM(proxies, lambda x: '"' || x || '"'), ',') || ']}}' ELSE '{{}}' END
        FROM shares
        UNION ALL SELECT 3, 'dataset_sensitive_attr_missing', 'skipped', NULL, NULL, 'Sensitive attribute ''missing'' is not present in dataset columns.', '{{}}'
        UNION ALL SELECT 4, 'dataset_feature_count', 'not_triggered', {columns}, {most_columns}, 'Feature count {columns} is within threshold {most_columns}.', '{{}}'
        UNION ALL SELECT 5, 'dataset_accountability_baseline', 'triggered', NULL, NULL, 'Baseline accountability recommendation is always added.', '{{}}')"""


DATASET_CHECKS_SQL = "WITH " + dataset_checks_sql(
    "customer", {"c_mktsegment": True, "c_nationkey": False}, ["c_custkey", "c_nationkey", "c_acctbal"], 0.4, 5, 20)
#: Columns that follow an attribute: the length of the segment's name, twice the nation's key (with holes).
PROXY_CHECKS_SQL = """WITH more AS (
        SELECT *, LENGTH(c_mktsegment) AS segment_size, CASE WHEN c_custkey % 3 > 0 THEN 2 * c_nationkey END AS twice FROM customer), """ + dataset_checks_sql(
    "more", {"c_mktsegment": True, "c_nationkey": False}, ["c_custkey", "c_nationkey", "c_acctbal", "segment_size", "twice"], 0.2, 7, 10)
SPEC_SQL = "CASE principle " + " ".join(f"WHEN '{p}' THEN '{elicit.default_specification(p)}'" for p in C.PRINCIPLES) + " END"


def dataset_suggestions_sql(name):
    return f"""
    SELECT position, check_id, principle, name, description, elicitation_reason, confidence_score,
           CASE position WHEN 0 THEN REPLACE({SPEC_SQL}, ']}}', '],"pii_columns":["c_name"]}}') ELSE {SPEC_SQL} END AS specification,
           TRUE AS elicited_automatically, 'draft' AS status
    FROM (SELECT position, check_id, CASE position WHEN 0 THEN 'privacy' WHEN 5 THEN 'accountability' ELSE 'fairness' END AS principle,
           CASE position WHEN 0 THEN 'Privacy Protection — {name}' WHEN 5 THEN 'Accountability — Audit Trail for ''{name}'''
                ELSE 'Fairness — Demographic Parity on ''' || REPLACE(check_id, 'dataset_imbalance_', '') || '''' END AS name,
           CASE position WHEN 0 THEN '1 column(s) look personal: c_name. Train only on data without them in which every row shares its quasi-identifiers with four others.'
                WHEN 5 THEN 'Every validation leaves a record of the model, the data, the measured values and the outcome.'
                ELSE printf('The groups of ''%s'' are uneven (imbalance %.1f%%). Selection and error rates must stay within four fifths of each other.',
                            REPLACE(check_id, 'dataset_imbalance_', ''), value * 100)
                     || CASE WHEN metadata = '{{"proxy_variables":[]}}' THEN '' ELSE ' Also watch ' || REPLACE(REPLACE(
                         SUBSTRING(metadata, 21, LENGTH(metadata) - 22), '","', ', '), '"', '') || '.' END END AS description,
           reason AS elicitation_reason,
           CASE position WHEN 0 THEN 0.9 WHEN 5 THEN 1.0 ELSE ROUND(LEAST(0.95, 0.6 + value), 4) END::DOUBLE AS confidence_score
    FROM checks WHERE status = 'triggered')"""


def dataset_checks_of(spark, directory):
    return elicit.dataset_checks(table(spark, directory, "customer"), ["c_mktsegment", "c_nationkey", "missing"], "lenient")


def proxy_checks_of(spark, directory):
    df = table(spark, directory, "customer").withColumns({
        "segment_size": F.length("c_mktsegment"), "twice": F.when(F.col("c_custkey") % 3 > 0, 2 * F.col("c_nationkey"))})
    return elicit.dataset_checks(df, ["c_mktsegment", "c_nationkey", "missing"], "strict")


@register("elicit_dataset_checks", DATASET_CHECKS_SQL + " SELECT * FROM checks")
def elicit_dataset_checks(spark, directory):
    return dataset_checks_of(spark, directory)


@register("elicit_dataset_proxies", PROXY_CHECKS_SQL + " SELECT * FROM checks")
def elicit_dataset_proxies(spark, directory):
    return proxy_checks_of(spark, directory)


@register("elicit_dataset_suggestions", DATASET_CHECKS_SQL + dataset_suggestions_sql("customers"))
def elicit_dataset_suggestions(spark, directory):
    return elicit.dataset_suggestions(dataset_checks_of(spark, directory), "customers")


@register("elicit_proxy_suggestions", PROXY_CHECKS_SQL + dataset_suggestions_sql("more"))
def elicit_proxy_suggestions(spark, directory):
    return elicit.dataset_suggestions(proxy_checks_of(spark, directory), "more")


def model_checks_sql(first, features, attributes, before=""):
    """Checks of ``judged`` (attribute columns and the prediction) at strict limits, from position ``first`` on."""
    impacts = " UNION ALL ".join(f"""
        SELECT '{a}' AS a, {first + i} AS position, MIN(r) / MAX(r) AS v, COUNT(*) AS n, ARG_MIN(g, (r, g)) AS low_g, MIN(r) AS low, ARG_MAX(g, (r, g)) AS high_g, MAX(r) AS high
        FROM (SELECT {group} AS g, AVG(prediction) AS r FROM judged GROUP BY 1)""" for i, (a, group) in enumerate(attributes.items(), 1))
    return f"""
    , gap AS (SELECT (MAX(n) - MIN(n))::DOUBLE / SUM(n) AS v FROM (SELECT COUNT(*) AS n FROM judged GROUP BY prediction)),
    impacts AS ({impacts}),
    found AS ({before}
        SELECT {first} AS position, 'model_prediction_imbalance' AS check_id, CASE WHEN v > 0.2 THEN 'triggered' ELSE 'not_triggered' END AS status,
               ROUND(v, 4)::DOUBLE AS value, 0.2::DOUBLE AS threshold,
               printf('Prediction imbalance %.2f ' || CASE WHEN v > 0.2 THEN 'exceeded' ELSE 'is within' END || ' threshold 0.20.', v) AS reason, '{{}}' AS metadata FROM gap
        UNION ALL SELECT position, 'model_disparate_impact_' || a, CASE WHEN v < 0.9 THEN 'triggered' ELSE 'not_triggered' END, ROUND(v, 4), 0.9,
               printf('Disparate impact %.3f is ' || CASE WHEN v < 0.9 THEN 'below' ELSE 'within' END || ' threshold 0.90 for ''%s''.', v, a),
               '{{"groups":' || n || ',"lowest":{{"group":"' || low_g || '","rate":' || ROUND(low, 4)::DOUBLE || '}},"highest":{{"group":"' || high_g || '","rate":' || ROUND(high, 4)::DOUBLE || '}}}}' FROM impacts
        UNION ALL SELECT {first + 3}, 'model_disparate_impact_missing', 'skipped', NULL, NULL, 'Sensitive attribute ''missing'' not found in dataset.', '{{}}'
        UNION ALL SELECT {first + 4}, 'model_feature_count', 'not_triggered', {features}, 8, 'Model inference used {features} features, within threshold 8.', '{{}}'),
    checks AS (SELECT * FROM found UNION ALL SELECT {first + 5}, 'model_baseline_monitoring', 'triggered', NULL, NULL,
               'No high-risk checks triggered; baseline monitoring recommendation added.', '{{}}'
        WHERE NOT EXISTS (SELECT 1 FROM found WHERE status = 'triggered' AND check_id <> 'model_feature_compatibility'))"""


MODEL_CHECKS_SQL = ", judged AS (SELECT segment, nation, prediction FROM scored)" + model_checks_sql(
    0, 3, {"segment": "segment", "nation": "nation::VARCHAR"})


def model_checks_of(spark, directory):
    scored = scored_loans(spark, directory)
    return elicit.model_checks(scored, FEATURES, ["segment", "nation", "missing"], "strict")


@register("elicit_model_checks", loans_sql(MODEL_CHECKS_SQL + " SELECT * FROM checks"))
def elicit_model_checks(spark, directory):
    return model_checks_of(spark, directory)


@register("elicit_model_suggestions", loans_sql(MODEL_CHECKS_SQL + f"""
    SELECT position, check_id, principle, name, description, elicitation_reason, confidence_score, {SPEC_SQL} AS specification, TRUE AS elicited_automatically, 'draft' AS status
    FROM (SELECT c.position, check_id, 'fairness' AS principle, CASE WHEN c.position = 0 THEN 'Fairness — Prediction Imbalance Detected'
           ELSE 'Fairness — Disparate Impact on ''' || a || '''' END AS name,
           CASE WHEN c.position = 0 THEN printf('The shares of the predicted classes lie %.1f points apart. Check selection and error rates of every group.', value * 100)
                ELSE printf('Positive predictions range from %s (%.1f%%) to %s (%.1f%%): the lowest rate is %.3f of the highest.',
                            low_g, ROUND(low, 4) * 100, high_g, ROUND(high, 4) * 100, value) END AS description,
           reason AS elicitation_reason,
           ROUND(CASE WHEN c.position = 0 THEN LEAST(0.92, 0.65 + value) ELSE LEAST(0.95, 0.8 + (0.8 - value)) END, 4)::DOUBLE AS confidence_score
    FROM checks c LEFT JOIN impacts i ON c.position = i.position WHERE status = 'triggered')"""))
def elicit_model_suggestions(spark, directory):
    return elicit.model_suggestions(model_checks_of(spark, directory))


#: A model on raw loans: texts as codes of first appearance, missing values 0.
RAW_MODEL_SQL = loans_sql("""
    , raw AS (SELECT row_id, price, CASE WHEN row_id % 10 > 0 THEN balance END AS balance, segment, priority FROM loans),
    segments AS (SELECT segment, ROW_NUMBER() OVER (ORDER BY MIN(row_id)) - 1 AS code FROM raw GROUP BY segment),
    priorities AS (SELECT priority, ROW_NUMBER() OVER (ORDER BY MIN(row_id)) - 1 AS code FROM raw GROUP BY priority),
    judged AS (SELECT r.segment, r.priority, CASE WHEN -0.6::DOUBLE + 0.5 * price + -0.2 * COALESCE(balance, 0) + 0.3 * s.code + -0.1 * p.code > 0 THEN 1 ELSE 0 END AS prediction
        FROM raw r JOIN segments s ON r.segment = s.segment JOIN priorities p ON r.priority = p.priority)""" + model_checks_sql(
    1, 4, {"segment": "segment", "priority": "priority"}, """
        SELECT 0 AS position, 'model_feature_compatibility' AS check_id, 'triggered' AS status, 4.0::DOUBLE AS value, 4.0::DOUBLE AS threshold,
               'Feature compatibility check passed.' AS reason, '{}' AS metadata UNION ALL"""))


@register("elicit_raw_model_checks", RAW_MODEL_SQL + " SELECT * FROM checks")
def elicit_raw_model_checks(spark, directory):
    raw = loans(spark, directory).select(
        "row_id", "price", F.when(F.col("row_id") % 10 > 0, F.col("balance")).alias("balance"), "segment", "priority", "y_true")
    model = scoring.LinearModel(("price", "balance", "segment", "priority"), (0.5, -0.2, 0.3, -0.1), -0.6)
    judge = lambda df: df.withColumn("prediction", (model.score() > 0).cast("int"))
    return elicit.model_elicitation(raw, "row_id", judge, "y_true", ["segment", "priority", "missing"], 4, "strict")


@register("elicit_group_rates", loans_sql("""
    SELECT 'segment' AS attribute, segment AS "group", ROUND(AVG(prediction), 6)::DOUBLE AS rate FROM scored GROUP BY segment
    UNION ALL SELECT 'priority', priority, ROUND(AVG(prediction), 6) FROM scored GROUP BY priority"""))
def elicit_group_rates(spark, directory):
    out = elicit.attribute_rates(scored_loans(spark, directory), ["segment", "priority"])
    return out.withColumn("rate", F.round("rate", 6))


SUPPORTED_SQL = ", ".join(f"('{p}', '{m}')" for p, ms in C.SUPPORTED_RULE_METRICS.items() for m in ms)


@register("elicit_rule_errors", with_views(f"""
    SELECT requirement_id, CASE
        WHEN s.metric IS NULL THEN 'Unsupported metric ''' || r.metric || ''' for principle ''' || r.principle || ''''
        WHEN operator = '!=' THEN 'Unsupported operator ''!='' in rule #1' ELSE 'Rule #1 is missing a value' END AS error
    FROM g_requirements r LEFT JOIN (VALUES {SUPPORTED_SQL}) s(principle, metric) ON r.principle = s.principle AND r.metric = s.metric
    WHERE s.metric IS NULL OR operator = '!=' OR rule_value IS NULL""", "g_requirements"))
def elicit_rule_errors(spark, directory):
    rules = view(spark, directory, "g_requirements").select(
        "requirement_id", "principle", F.lit(0).alias("position"), "metric", "operator", F.col("rule_value").alias("value"))
    return elicit.rule_errors(rules).select("requirement_id", "error")


# --- Templates ------------------------------------------------------------------------

IDS = [row[0] for row in catalog.template_rows()]


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


TEMPLATE_SQL = ", ".join(
    f"({i}, {quoted(t[0])}, {quoted(t[1])}, {quoted(t[6])}, {n}, {quoted(r[0])}, {quoted(r[1])}, {r[2]}::DOUBLE, {quoted(r[3])}, {quoted(r[4])})"
    for i, t in enumerate(catalog.template_rows()) for n, r in enumerate(t[7]))
PRINCIPLE_SQL = ", ".join(f"({i}, {n}, {quoted(p)})" for i, t in enumerate(catalog.template_rows()) for n, p in enumerate(t[4]))
BASELINE_SQL = ", ".join(
    f"({n}, {quoted(r[0])}, {quoted(r[1])}, {r[2]}::DOUBLE, {quoted(r[3])}, {quoted(r[4])})"
    for n, r in enumerate(catalog.rule_rows(catalog.BASELINE_RULES)))
CATALOG_SQL = f""", items(ti, template_id, tname, reference, position, metric, operator, value, principle, description) AS (VALUES {TEMPLATE_SQL}),
    principles(ti, pos, principle) AS (VALUES {PRINCIPLE_SQL}),
    baseline(pos, metric, operator, value, principle, description) AS (VALUES {BASELINE_SQL}),
    enriched AS (
        SELECT ti, position, metric, value, principle FROM items
        UNION ALL SELECT p.ti, 100 + 10 * p.pos + b.pos, b.metric, b.value, b.principle FROM principles p JOIN baseline b ON p.principle = b.principle
        WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.ti = p.ti AND LOWER(i.metric) = b.metric)),
    choices AS (SELECT model_id AS project_id, model_id % 26 AS ti FROM g_models)"""


def catalog_sql(body):
    return with_views("", "g_models") + CATALOG_SQL + body


def choices_of(spark, directory):
    """Every model takes one of the built-in templates; models stand for projects here."""
    models = view(spark, directory, "g_models")
    chosen = F.element_at(F.array(*[F.lit(i) for i in IDS]), (F.col("model_id") % len(IDS) + 1).cast("int"))
    return models.select(F.col("model_id").alias("project_id"), chosen.alias("template_id"))


@register("template_requirements", catalog_sql("""
    SELECT project_id, template_id, position, metric || ' (' || template_id || ')' AS name,
           i.description || '. Source template: ' || tname || '. Reference: ' || reference AS description, principle,
           'Applied from template: ' || tname AS elicitation_reason
    FROM choices c JOIN items i ON c.ti = i.ti"""))
def template_requirements(spark, directory):
    out = templates.apply_to_projects(choices_of(spark, directory), templates.built_in(spark))
    return out.select("project_id", "template_id", "position", "name", "description", "principle", "elicitation_reason")


@register("template_baseline_rules", catalog_sql("""
    SELECT project_id, CAST(ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY position) - 1 AS INTEGER) AS position, metric, principle
    FROM choices c JOIN enriched e ON c.ti = e.ti"""))
def template_baseline_rules(spark, directory):
    out = templates.apply_to_projects(choices_of(spark, directory), templates.with_baseline(templates.built_in(spark)))
    metric = F.regexp_extract("name", r"^(\S+)", 1)
    return out.select("project_id", "position", metric.alias("metric"), "principle")


FAIR_SQL = ", ".join(quoted(m) for m in C.FAIRNESS_THRESHOLDS)


@register("template_settings", catalog_sql(f"""
    , flags AS (
        SELECT ti, position, metric, value, principle, metric IN ({FAIR_SQL}) AS fair, metric = 'k_anonymity' AS is_k, metric = 'l_diversity' AS is_l,
               metric LIKE '%pii%' AS is_pii, metric IN ('shap_coverage', 'model_card_completeness', 'explanation_required') AS transparent FROM enriched),
    validators AS (
        SELECT ti, principle AS v FROM principles UNION SELECT ti, principle FROM flags UNION SELECT ti, 'fairness' FROM flags WHERE fair
        UNION SELECT ti, 'transparency' FROM flags WHERE transparent UNION SELECT ti, 'privacy' FROM flags WHERE is_k OR is_l OR is_pii
        UNION SELECT ti, 'accountability' FROM flags WHERE metric = 'audit_trail_required')
    SELECT project_id, (SELECT STRING_AGG(v, ',' ORDER BY v) FROM validators x WHERE x.ti = c.ti) AS validators,
           COALESCE((SELECT STRING_AGG(DISTINCT metric, ',' ORDER BY metric) FROM flags x WHERE x.ti = c.ti AND fair),
                    'demographic_parity_ratio,disparate_impact_ratio,equalized_odds_ratio') AS fairness_metrics,
           COALESCE((SELECT STRING_AGG(DISTINCT k, ',' ORDER BY k) FROM (
               SELECT ti, CASE WHEN is_pii THEN 'pii_detection' WHEN is_k THEN 'k_anonymity' WHEN is_l THEN 'l_diversity' END AS k FROM flags) x
               WHERE x.ti = c.ti), 'k_anonymity,pii_detection') AS privacy_checks,
           COALESCE((SELECT MAX(value)::INTEGER FROM flags x WHERE x.ti = c.ti AND is_k), 5) AS k,
           COALESCE((SELECT MAX(value)::INTEGER FROM flags x WHERE x.ti = c.ti AND is_l), 2) AS l
    FROM choices c"""))
def template_settings(spark, directory):
    settings = templates.validation_settings(templates.with_baseline(templates.built_in(spark)))
    joined = choices_of(spark, directory).join(F.broadcast(settings), "template_id")
    return joined.select("project_id", *[F.array_join(c, ",").alias(c) for c in ("validators", "fairness_metrics", "privacy_checks")], "k", "l")


@register("template_custom_clones", catalog_sql("""
    SELECT project_id, template_id || '-custom' AS template_id, tname || ' (Custom)' AS name, COUNT(*)::INTEGER + 1 - MAX(CASE WHEN position = 1 THEN 1 ELSE 0 END) AS items,
           0.5::DOUBLE AS first_value FROM choices c JOIN items i ON c.ti = i.ti GROUP BY project_id, template_id, tname"""))
def template_custom_clones(spark, directory):
    clones = templates.customise(
        templates.built_in(spark), overrides=[{"index": 0, "value": 0.5, "operator": "<="}], remove=[1],
        add=[{"metric": "drift", "operator": "<=", "value": 0.1, "principle": "accountability", "description": "Drift"}])
    joined = choices_of(spark, directory).withColumn("template_id", F.concat("template_id", F.lit("-custom"))).join(
        F.broadcast(clones), "template_id")
    return joined.select("project_id", "template_id", "name", F.size("items").alias("items"), F.col("items")[0]["value"].alias("first_value"))


def stored_templates(spark, directory):
    """Templates kept per requirement: its principle and its single rule."""
    item = F.struct("metric", "operator", F.col("rule_value").alias("value"), "principle", F.lit("").alias("description"))
    return view(spark, directory, "g_requirements").select(
        F.col("requirement_id").alias("template_id"), "name", F.col("operator").alias("domain"),
        F.array("principle").alias("principles"), F.array(item).alias("items"), (F.col("status") == "active").alias("is_active"),
        F.lit(1).alias("version"))


@register("template_list", with_views("""
    SELECT requirement_id AS template_id, name FROM g_requirements
    WHERE status = 'active' AND operator = '>=' AND principle = 'privacy' AND CONTAINS(LOWER(name), 'ring')""", "g_requirements"))
def template_list(spark, directory):
    found = templates.list_templates(stored_templates(spark, directory), domain=">=", principle="privacy", search="RING")
    return found.select("template_id", "name")


@register("template_upsert", with_views("""
    SELECT COALESCE(n.requirement_id, o.requirement_id) AS template_id,
           CASE WHEN o.requirement_id IS NULL THEN 'inserted' WHEN n.requirement_id IS NULL THEN 'kept' WHEN n.principle = 'privacy' THEN 'updated' ELSE 'kept' END AS change,
           CASE WHEN o.requirement_id IS NOT NULL AND n.principle = 'privacy' THEN 2 ELSE 1 END AS version,
           CASE WHEN n.principle = 'privacy' THEN n.name || ' v2' ELSE COALESCE(o.name, n.name) END AS name
    FROM (SELECT * FROM g_requirements WHERE operator <> '<') n FULL OUTER JOIN (SELECT * FROM g_requirements WHERE operator <> '>') o
    ON n.requirement_id = o.requirement_id""", "g_requirements"))
def template_upsert(spark, directory):
    stored = stored_templates(spark, directory)
    current = stored.where("domain <> '>'")
    private = F.array_contains("principles", "privacy")
    incoming = stored.where("domain <> '<'").withColumn(
        "name", F.when(private, F.concat("name", F.lit(" v2"))).otherwise(F.col("name")))
    out = templates.upsert(current, incoming, "template_id", ["name", "items"])
    return out.select("template_id", "change", "version", "name")


THRESHOLD_DEFAULTS = ", ".join(f"('{m}', {v}::DOUBLE)" for m, v in C.FAIRNESS_THRESHOLDS.items())


@register("requirement_thresholds", with_views(f"""
    , alive AS (SELECT project_id, requirement_id, metric, rule_value FROM g_requirements WHERE status <> 'archived')
    SELECT p.project_id, d.metric, COALESCE(g.v, d.v) AS threshold FROM (SELECT DISTINCT project_id FROM alive) p CROSS JOIN (VALUES {THRESHOLD_DEFAULTS}) d(metric, v)
    LEFT JOIN (SELECT project_id, metric, ARG_MAX(rule_value, requirement_id) AS v FROM alive WHERE rule_value IS NOT NULL GROUP BY ALL) g
        ON p.project_id = g.project_id AND d.metric = g.metric
    UNION ALL SELECT project_id, CASE metric WHEN 'k_anonymity_k' THEN 'k' ELSE 'l' END, ARG_MAX(rule_value, requirement_id)
    FROM alive WHERE metric IN ('k_anonymity_k', 'l_diversity_l') AND rule_value IS NOT NULL GROUP BY project_id, metric""", "g_requirements"))
def requirement_thresholds(spark, directory):
    rules = view(spark, directory, "g_requirements").select(
        "project_id", "requirement_id", "status", "metric", F.col("rule_value").alias("value"))
    return templates.requirement_thresholds(rules)


@register("template_thresholds", catalog_sql(f"""
    SELECT project_id, d.metric, COALESCE(g.v, d.v) AS threshold FROM choices c CROSS JOIN (VALUES {THRESHOLD_DEFAULTS}) d(metric, v)
    LEFT JOIN (SELECT ti, metric, ARG_MAX(value, position) AS v FROM items GROUP BY ALL) g ON c.ti = g.ti AND d.metric = g.metric"""))
def template_thresholds(spark, directory):
    limits = templates.template_thresholds(templates.built_in(spark))
    return choices_of(spark, directory).join(F.broadcast(limits), "template_id").select("project_id", "metric", "threshold")


RECOMMENDED_SQL = ", ".join(f"({i}, {n}, {quoted(d)})" for i, t in enumerate(catalog.template_rows()) for n, d in enumerate(t[5]))
KNOWN_SQL = ", ".join(f"({quoted(b[0])}, {quoted(b[1])}, {quoted(b[2])})" for b in C.BENCHMARK_DATASETS if b[0] != "compas")


@register("benchmark_load_plan", catalog_sql(f"""
    , recommended(ti, position, dataset_key) AS (VALUES {RECOMMENDED_SQL}), known(dataset_key, name, filename) AS (VALUES {KNOWN_SQL}),
    existing AS (SELECT project_id FROM choices WHERE project_id % 4 = 0)
    SELECT c.project_id, position, r.dataset_key,
           CASE WHEN k.name IS NULL THEN 'failed' WHEN r.dataset_key = 'adult_income' AND e.project_id IS NOT NULL THEN 'skipped_existing'
                WHEN k.filename IN ('adult.csv', 'bank_marketing.csv') THEN 'loaded' ELSE 'missing_files' END AS outcome,
           CASE WHEN k.name IS NULL THEN 'Unknown dataset key: ' || r.dataset_key WHEN r.dataset_key = 'adult_income' AND e.project_id IS NOT NULL THEN r.dataset_key
                WHEN k.filename IN ('adult.csv', 'bank_marketing.csv') THEN k.name ELSE k.filename END AS detail
    FROM choices c JOIN recommended r ON c.ti = r.ti LEFT JOIN known k ON r.dataset_key = k.dataset_key LEFT JOIN existing e ON c.project_id = e.project_id"""))
def benchmark_load_plan(spark, directory):
    choices = choices_of(spark, directory)
    known = benchmarks.catalogue(spark).where("dataset_key <> 'compas'")
    existing = choices.select("project_id", F.when(
        F.col("project_id") % 4 == 0, "Adult Income (Census)").otherwise("other").alias("name"))
    files = spark.createDataFrame([("adult.csv",), ("bank_marketing.csv",)], "filename string")
    return benchmarks.load_plan(choices, templates.built_in(spark), known, existing, files).drop("template_id")
