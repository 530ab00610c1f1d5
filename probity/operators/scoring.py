"""Scoring and evaluation of classifiers."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions import rates as R
from probity.functions.checks import require_columns


@dataclass(frozen=True)
class LinearModel:
    """A binary linear classifier; the label is 1 where the score is not negative."""

    features: tuple
    weights: tuple
    bias: float = 0.0

    def score(self, columns=None):
        """The decision score as a Column."""
        columns = columns or {f: F.col(f) for f in self.features}
        total = F.lit(float(self.bias))
        for f, w in zip(self.features, self.weights):
            total = total + F.lit(float(w)) * columns[f]
        return total

    def transform(self, df) -> DataFrame:
        require_columns(df, self.features)
        return df.withColumn("score", self.score()).withColumns({
            "prediction": (F.col("score") >= 0).cast("int"), "probability": sigmoid(F.col("score"))})


def sigmoid(score):
    return 1 / (1 + F.exp(-score))


def softmax(scores):
    """Class probabilities of an array of scores."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def one_hot(label, classes):
    """Class probabilities of a hard label."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("double"))


def score_with(df, features, predict, schema="probability double") -> DataFrame:
    """Adds the columns of ``schema`` from a Python model.

    ``predict`` takes a pandas DataFrame of the features and returns the new
    columns; it is called once per Arrow batch in every task.
    """
    require_columns(df, features)
    added = T._parse_datatype_string(schema)
    out_schema = T.StructType(df.schema.fields + added.fields)
    names = [f.name for f in added.fields]
    features = list(features)

    def run(batches):
        for batch in batches:
            values = predict(batch[features])
            for i, name in enumerate(names):
                column = values[name] if hasattr(values, "columns") else (values if len(names) == 1 else values[i])
                batch[name] = getattr(column, "to_numpy", lambda c=column: c)()
            yield batch

    return df.mapInPandas(run, out_schema)


def score_pipeline(df, model, positive=1) -> DataFrame:
    """Adds prediction and the probability of the positive class from a fitted Spark ML model."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    return scored.select(
        *df.columns, F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[positive].alias("probability"))


def evaluation(df, y_true="y_true", y_pred="prediction", keys=(), weight=None) -> DataFrame:
    """Accuracy, precision, recall and F1; a zero denominator gives 0. With ``weight``, a row stands for so many."""
    counts = df.groupBy(*keys).agg(*R.confusion_sums(y_true, y_pred, weight))
    return counts.select(
        *keys, F.col("n").alias("rows"),
        R.base_metric("accuracy_score").alias("accuracy"), R.base_metric("precision_score").alias("precision"),
        R.base_metric("recall_score").alias("recall"), R.base_metric("f1_score").alias("f1"))


def class_balance(df, label) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
