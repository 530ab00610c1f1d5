"""Use of all cores on inputs too small to be split by their files."""

import math

from pyspark.sql import functions as F

BYTES_PER_CORE = 16 << 20
FEW = 4
BYTES_PER_PART = 4 << 20
#: Estimates over joins can be far too high.
MOST_PARTS = 10_000


def spread_small(df):
    """A small input dealt out to all cores; a larger one is left as its files split it.

    A table of a few files or row groups gives a few tasks, which wastes a
    cluster on heavy per-row work such as pattern matching. The optimizer's
    size estimate decides, so the shuffle this adds is never more than
    ``BYTES_PER_CORE`` for each core. Rows go by a hash of their columns, so a
    task run again gets the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if cores < 2 or estimated_bytes(df) >= cores * BYTES_PER_CORE:
        return df
    return df.repartition(cores, *[F.col(f"`{c}`") for c in df.columns])


def dealt_out(df):
    """Slim rows dealt out evenly to at least as many tasks as a shuffle has, for work that expands each of them.

    Files and joins split by bytes, which says nothing of such work. The number is stated, so that the adaptive
    optimizer does not join the parts by their bytes either.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *[F.col(f"`{c}`") for c in df.columns])


def packed(df):
    """A persisted, computed input dealt out to fewer tasks, where each would have next to nothing to do.

    An iterative fit runs hundreds of jobs over the same rows, and then the start of the tasks takes
    the time. A task gets up to ``BYTES_PER_CORE`` and there are as many for each core; an
    input that is at most ``FEW`` times as finely divided is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, math.ceil(estimated_bytes(df) / (cores * BYTES_PER_CORE)))
    if df.rdd.getNumPartitions() <= FEW * tasks:
        return df
    return df.repartition(tasks, *[F.col(f"`{c}`") for c in df.columns])


def parted_by(df, *keys):
    """Rows dealt out by their keys into parts whose number grows with the input, so that a part does not.

    The adaptive optimizer joins parts by their compressed bytes, which says little of what a sort
    or a hash table of them takes; it leaves a stated number of parts alone.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(math.ceil(estimated_bytes(df) / BYTES_PER_PART), MOST_PARTS)
    return df.repartition(max(least, parts), *[F.col(k) for k in keys])


def estimated_bytes(df):
    """The optimizer's estimate of a DataFrame's size; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
