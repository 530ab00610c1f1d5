"""Tree ensembles of Spark ML fitted on counted cells of bins instead of on rows.

A tree compares a feature only with the cuts between its bins, so rows with the same bins and the same
label are one row to it, as often as there are such rows. A table of few features has few such cells
at any number of rows: the rows are counted once, and every round and level reads the cells.
Boosting weighs a cell by its count. A forest's bootstrap draws each row by Poisson(1), so a cell of
n rows by Poisson(n); Spark would draw the cell as a whole, so the draws are made here and each tree is fitted on its own.
"""

import math
import random
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import functions as F

from probity.session import ensure_checkpoint_dir

#: Rows a cell must stand for, on average, so that cells are worth their making.
ROWS_PER_CELL = 8
#: Cells of a task; stated, so that the draws do not depend on the cluster.
CELLS_PER_TASK = 16_384
#: Such tasks that one task of a single tree's fit reads: many trees are fitted at once.
TASKS_PER_TREE = 8
#: Bits of a value that a pass over the rows tells.
BITS = 13
TOP = np.uint64(1 << 63)
#: Relative error of the estimate that tells features of few values.
ESTIMATE_ERROR = 0.05


def cuts_between_bins(df, features, bins):
    """Per feature the ascending cuts between at most ``bins`` bins; a value up to a cut lies before it.

    A feature of at most ``bins`` different values is cut half-way between all of them, any other at its exact quantiles.
    """
    told = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.approx_count_distinct(f"`{f}`", ESTIMATE_ERROR).alias(f"_{i}") for i, f in enumerate(features)]).first()
    cuts = {}
    for i, f in enumerate(features):
        if told[f"_{i}"] <= 2 * bins:
            values = sorted(r[0] for r in df.select(f"`{f}`").distinct().collect())  # some 2 * bins at most
            if len(values) <= bins:
                cuts[i] = [low / 2 + high / 2 for low, high in zip(values, values[1:])]
    many = [i for i in range(len(features)) if i not in cuts]
    ranks = sorted({-(-k * told["rows"] // bins) - 1 for k in range(1, bins)} | {told["rows"] - 1})
    for i, found in zip(many, values_at_ranks(df, [features[i] for i in many], ranks) if many else ()):
        cuts[i] = [v for v in sorted(set(found)) if v < found[-1]]
    return [cuts[i] for i in range(len(features))]


def _keys(values):
    """Whole numbers of 64 bits in the order of finite doubles; the two zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | TOP)


def values_at_ranks(df, features, ranks):
    """Per feature (finite doubles) the values at the zero-based ``ranks``, exact.

    The values' bits are told from the first on, ``BITS`` in each pass: rows are counted by them in every task, and only
    those that begin like a wanted one. No row is shuffled or sorted among others; a few thousand counts a rank reach the driver.
    """
    # Per feature and rank: how the value begins, its rank among those that begin so, and the least of them.
    known = [[(0, rank, None) for rank in ranks] for _ in features]
    taken, single = 0, False
    while not single:
        before, taken = taken, min(taken + BITS, 64)
        starts = [np.array(sorted({start for start, *_ in found}), dtype=np.uint64) for found in known]

        def count(batches, starts=starts, before=before, taken=taken):
            for batch in batches:
                for i in range(len(features)):
                    keys = np.sort(_keys(batch[f"_{i}"].to_numpy()))
                    if before:
                        keys = keys[np.isin(keys >> np.uint64(64 - before), starts[i])]
                    heads, first, sizes = np.unique(keys >> np.uint64(64 - taken), return_index=True, return_counts=True)
                    yield pd.DataFrame({
                        "feature": i, "head": heads.view(np.int64), "low": (keys[first] ^ TOP).view(np.int64),
                        "high": (keys[first + sizes - 1] ^ TOP).view(np.int64), "n": sizes})

        values = df.select(*[F.col(f"`{f}`").alias(f"_{i}") for i, f in enumerate(features)])
        counts = values.mapInPandas(count, "feature long, head long, low long, high long, n long").groupBy("feature", "head").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()
        single = True
        for i, found in enumerate(known):
            own = counts[counts["feature"] == i]
            order = np.argsort(own["head"].to_numpy().view(np.uint64))
            heads, low, high, sizes = (own[c].to_numpy()[order] for c in ("head", "low", "high", "n"))
            begun = heads.view(np.uint64) >> np.uint64(taken - before) if before else np.zeros(len(heads), np.uint64)
            upto = np.cumsum(sizes)
            for k, (start, rank, _) in enumerate(found):
                at = np.searchsorted(begun, np.uint64(start))
                rank = rank + upto[at] - sizes[at]
                at = np.searchsorted(upto, rank, side="right")
                found[k] = int(heads.view(np.uint64)[at]), int(rank - upto[at] + sizes[at]), int(low[at])
                single = single and bool(low[at] == high[at])
    return [[_value(low) for *_, low in found] for found in known]


def _value(low):
    """The double of a key that is written as a signed number."""
    key = low + (1 << 63)
    return float(np.array(key ^ (1 << 63) if low >= 0 else key ^ ((1 << 64) - 1), dtype=np.uint64).view(np.float64))


def counted_cells(df, features, cuts, keys):
    """(keys, _bin_0, _bin_1, ..., n): the rows per cell of bins."""
    names = [f"_bin_{i}" for i in range(len(features))]
    cut = [i for i, c in enumerate(cuts) if c]
    if cut:
        # A bucket starts at its lower bound: the next number after a cut.
        df = Bucketizer(inputCols=[features[i] for i in cut], outputCols=[names[i] for i in cut], splitsArray=[
            [-math.inf, *[math.nextafter(c, math.inf) for c in cuts[i]], math.inf] for i in cut]).transform(df)
    df = df.withColumns({names[i]: F.lit(0.0) for i, c in enumerate(cuts) if not c})
    # Without what a bucketizer says of its buckets: trees would take them for categories.
    df = df.select(*keys, *[F.col(c).alias(c, metadata={}) for c in names])
    return df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("n"))


def drawn(cells, order, trees, seed):
    """Adds _draw_0, _draw_1, ...: how often each tree draws a cell of ``n`` rows. Tasks run again draw the same."""
    schema = cells.schema.simpleString()[len("struct<"):-1] + "".join(f",_draw_{t}:bigint" for t in range(trees))

    def draw(batches):
        numbers = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            found = numbers.poisson(batch["n"].to_numpy()[:, None], (len(batch), trees))
            yield pd.concat([batch, pd.DataFrame(found, index=batch.index, columns=[f"_draw_{t}" for t in range(trees)])], axis=1)

    return cells.sortWithinPartitions(*order).mapInPandas(draw, schema)


class Cells:
    """The rows of a split, counted by label and bins; fits tree ensembles that compare features with the cuts."""

    def __init__(self, counts, features, label, cuts, rows):
        self.features, self.label, self.cuts, self.names = list(features), label, cuts, [f"_bin_{i}" for i in range(len(features))]
        self.tasks = math.ceil(rows / CELLS_PER_TASK)
        self.counts = counts.repartition(self.tasks, label, *self.names).persist()
        # Where the sample that Spark finds cuts in would leave out cells, bins could be lost.
        self.most_bins = max(32, math.ceil(math.sqrt(rows)))

    def assembled(self, cells):
        return VectorAssembler(inputCols=self.names, outputCol="features").transform(cells)

    def fitted(self, estimator):
        """The estimator's model, which compares bins."""
        return self.forest(estimator) if isinstance(estimator, RandomForestClassifier) else self.boosted(estimator)

    def scored(self, model):
        """The cells with the prediction of a model fitted on them."""
        return model.transform(self.assembled(self.counts)).select("split", self.label, "n", F.col("prediction").cast("int").alias("prediction"))

    def boosted(self, estimator):
        """A model of boosted trees."""
        train = self.assembled(self.counts.where("split = 'train'")).persist()
        try:
            return estimator.copy().setWeightCol("n").setMaxBins(self.most_bins).fit(train)
        finally:
            train.unpersist()

    def forest(self, estimator):
        """A random forest, of trees fitted one by one, several at once."""
        spark, trees, seed = self.counts.sparkSession, estimator.getNumTrees(), estimator.getSeed()
        train = self.counts.where("split = 'train'")
        classes = int(train.agg(F.max(self.label).alias("most")).first()["most"]) + 1
        # A tree that draws no row of a class still knows of it.
        known = F.col(f"`{self.label}`").alias(self.label, metadata={"ml_attr": {"type": "nominal", "num_vals": classes}})
        bags = self.assembled(drawn(train, [self.label, *self.names], trees, seed)).coalesce(max(1, self.tasks // TASKS_PER_TREE)).persist()
        numbers = random.Random(seed)
        seeds = [numbers.getrandbits(62) for _ in range(trees)]
        strategy = estimator.getFeatureSubsetStrategy()

        def tree(t):
            weight = f"_draw_{t}"
            bag = bags.where(F.col(weight) > 0).select(known, "features", weight)
            one = estimator.copy().setNumTrees(1).setBootstrap(False).setSeed(seeds[t]).setWeightCol(weight).setMaxBins(self.most_bins)
            return one.setFeatureSubsetStrategy("sqrt" if strategy == "auto" else strategy).fit(bag)

        try:
            bags.count()
            with ThreadPool(max(2, spark.sparkContext.defaultParallelism)) as pool:
                fitted = pool.map(inheritable_thread_target(spark)(tree), range(trees), chunksize=1)
        finally:
            bags.unpersist()
        context = spark.sparkContext
        java = context._jvm.org.apache.spark.ml.classification
        grown = context._gateway.new_array(java.DecisionTreeClassificationModel, trees)
        for t, model in enumerate(fitted):
            grown[t] = model._java_obj.trees()[0]
        return estimator._copyValues(RandomForestClassificationModel(
            java.RandomForestClassificationModel(estimator.uid, grown, len(self.features), classes)))

    def of_values(self, model):
        """A model fitted on bins as a pipeline on the features themselves: each split on a bin becomes one on the cut after it.

        The nodes are rewritten where Spark keeps them in a saved model.
        """
        spark = self.counts.sparkSession
        path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
        model.write().save(f"{path}/bins")
        spark.read.text(f"{path}/bins/metadata").coalesce(1).write.text(f"{path}/values/metadata")
        spark.read.parquet(f"{path}/bins/treesMetadata").write.parquet(f"{path}/values/treesMetadata")
        split = F.col("nodeData.split")
        cuts = F.array(*[F.array(*map(F.lit, c)).cast("array<double>") for c in self.cuts])
        cut = cuts[split["featureIndex"]][F.floor(split["leftCategoriesOrThreshold"][0]).cast("int")]
        inner = F.col("nodeData.leftChild") >= 0
        rows = spark.read.parquet(f"{path}/bins/data")
        rows.withColumn("nodeData", F.col("nodeData").withField("split", F.when(inner, split.withField(
            "leftCategoriesOrThreshold", F.array(cut))).otherwise(split))).write.parquet(f"{path}/values/data")
        return PipelineModel([VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep"),
                              type(model).load(f"{path}/values")])


def cells_of(split, features, label, rows, bins=32):
    """The ``Cells`` of ``split`` (features, label, split; ``rows`` rows), or None if they are not many times fewer than its rows."""
    cuts = cuts_between_bins(split.where("split = 'train'"), features, bins)
    counts = counted_cells(split, features, cuts, ["split", label]).persist()
    try:
        size = counts.count()
        if size * ROWS_PER_CELL > rows:
            return None
        cells = Cells(counts, features, label, cuts, size)
        cells.counts.count()
        return cells
    finally:
        counts.unpersist()
