"""Ranks and splits over whole tables without a single-task window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

POSITIONS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 100_000
HASH_DIGITS = 4


def shuffle_key(id_column, seed):
    """A repeatable pseudo-random sort key of a row."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def rank_by_position(df, keys, position, value, rows=None):
    """Zero-based rank of ``value`` by ``position`` (an integer) within ``keys``; with ``rows``, that column and its total per key too.

    Positions are cut into ranges; rows are ranked inside their range and the
    sizes of the ranges before it are added, so no task sees more than one range.
    """
    keep = [] if rows is None else [rows, "total"]
    spread = df.groupBy(*keys).agg(F.min(position).alias("lowest"), F.max(position).alias("highest"), *[F.sum(c).alias("total") for c in keep[:1]])
    spread = spread.select(*keys, *keep[1:], "lowest", F.greatest(
        F.lit(POSITIONS_PER_BUCKET).cast("bigint"),
        F.ceil((F.col("highest").cast("decimal(20,0)") - F.col("lowest")) / MAX_BUCKETS).cast("bigint"),
    ).alias("width"))
    placed = df.join(F.broadcast(spread), keys).withColumn(
        "bucket", F.floor((F.col(position) - F.col("lowest")) / F.col("width"))
    )
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("size")).select(
        *keys, "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(position, value)
    return (
        placed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "bucket"])
        .select(*keys, value, *keep, (F.col("offset") + F.col("inside")).alias("code"))
    )


def in_ranges(rows, order):
    """``rows`` range partitioned by ``order``, with the number of the range in ``part``.

    The number of ranges is stated, so the adaptive optimizer leaves them as they
    are and every reader of the same shuffle sees the same ranges.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())


def rank_unique(rows, column):
    """``rows``, of which none has the same ``column`` (or columns) as another, with the zero-based ``code`` in its order; nulls are left out.

    Rows are range partitioned and sorted; each row's number within its range is
    added to the sizes of the ranges before it: one plan for any size, in which
    the only single task sees one number per range.
    """
    columns = [column] if isinstance(column, str) else list(column)
    placed = in_ranges(rows.na.drop(subset=columns), columns)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("_size")).select(
        "part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = placed.sortWithinPartitions(*columns).withColumn("_inside", inside)
    # One row per range.
    return numbered.join(F.broadcast(before), "part").select(*rows.columns, (F.col("_before") + F.col("_inside")).alias("code"))


def rank_distinct(values, column):
    """Zero-based rank of the distinct values of ``column`` in value order."""
    return rank_unique(values.select(column).distinct(), column)


#: Equal parts of a key's span of values that are counted before single values are looked at.
SPAN_PARTS = 4096


def order_statistics(counts, fractions, key="column", value="value", size="n", spans=None):
    """(key, fraction, value): exact quantiles per ``key`` from rows (key, value, size), interpolated between neighbours.

    ``counts`` has one row per different value, ``size`` says how often it
    occurs; nulls don't count. ``spans`` (key, low, high) has the least and greatest
    values if the caller knows them. Each span is cut into equal parts, which are counted;
    only the values of the parts that hold a wanted rank go on, range partitioned,
    so that values crowded into one part still are not one task's. One plan for any
    size; no value passes through the driver.
    """
    # Conditions that name the size stay above the aggregate that counts: below it they would make it another one, done again.
    known = counts.select(key, F.when(F.col(size) > 0, F.col(value)).alias(value), size).where(F.col(value).isNotNull())
    if spans is None:
        spans = known.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = F.col("high") - F.col("low")
    share = F.floor((F.col(value) - F.col("low")) / width * SPAN_PARTS)
    cell = F.when((width > 0) & (width < float("inf")), F.least(F.greatest(share, F.lit(0)), F.lit(SPAN_PARTS - 1))).otherwise(F.lit(0))
    # One row per key.
    placed = known.join(F.broadcast(spans.select(key, "low", "high")), key).select(key, value, size, cell.alias("_cell"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(key, "_cell").agg(F.sum(size).alias("_size")).select(
        key, "_cell", "_size", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(key)).alias("_whole"))
    asked = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    inside = F.col("_rank") - F.col("_before")
    wanted = cells.select("*", asked).withColumn("_position", F.col("fraction") * (F.col("_whole") - 1)).withColumn(
        "_rank", F.explode(F.array(F.floor("_position"), F.ceil("_position")))).where(
        (inside >= 0) & (inside < F.col("_size"))).select(key, "_cell", "fraction", "_position", inside.alias("_rank"))
    # Two ranks per key and fraction.
    near = placed.join(F.broadcast(wanted.select(key, "_cell").distinct()), [key, "_cell"], "left_semi")
    found = _of_rank(near, [key, "_cell"], value, size, wanted)
    low, high = F.min(value), F.max(value)
    between = F.first("_position") - F.floor(F.first("_position"))
    return found.groupBy(key, "fraction").agg(
        F.when(low == high, low).otherwise(low + (high - low) * between).alias(value))


def _of_rank(rows, keys, value, size, wanted):
    """``wanted`` (keys, _rank, ...) with the value that has this rank among the rows of its keys."""
    placed = in_ranges(rows.select(*keys, value, size), [*keys, value])
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy(*keys, "part").agg(F.sum(size).alias("_size")).select(
        *keys, "part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"), F.col("_size").alias("_held"))
    # As many rows as ``wanted``, which is small.
    asked = spans.join(F.broadcast(wanted), keys).where((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_held")))
    upto = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("_upto", F.sum(size).over(upto))
    rank = F.col("_rank") - F.col("_start")
    return counted.join(F.broadcast(asked), [*keys, "part"]).where((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col(size)))


def split_by_share(df, id_column, share, seed, stratum=None):
    """Column ``in_first``: true for exactly floor(share * rows) rows of every stratum.

    Rows are ordered by a hash. Hash ranges wholly below or above the cut are
    decided by their counts; only the range at the cut is ranked.
    """
    keyed = df.withColumn("_key", shuffle_key(id_column, seed)).withColumn(
        "_bucket", F.conv(F.substring("_key", 1, HASH_DIGITS), 16, 10).cast("int")
    ).withColumn("_stratum", F.lit(0) if stratum is None else F.col(stratum))
    earlier = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("_stratum")
    sizes = keyed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_size")).select(
        "_stratum", "_bucket", "_size",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.floor(F.sum("_size").over(everything) * F.lit(share)).alias("_quota"),
    )
    located = keyed.join(sizes, keyed["_stratum"].eqNullSafe(sizes["_stratum"]) & (
        keyed["_bucket"] == sizes["_bucket"])).drop(sizes["_stratum"]).drop(sizes["_bucket"])
    at_cut = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_size") > F.col("_quota"))
    decided = located.where(~at_cut).withColumn("in_first", F.col("_before") < F.col("_quota"))
    order = Window.partitionBy("_stratum", "_bucket").orderBy("_key", id_column)
    ranked = located.where(at_cut).withColumn(
        "in_first", F.col("_before") + F.row_number().over(order) <= F.col("_quota")
    )
    return decided.unionByName(ranked).select(*df.columns, "in_first")
