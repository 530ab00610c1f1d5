"""Column profiles.

Columns are turned into rows and counted once per different value, numbers as
numbers and texts by hashes; distinct counts and medians are read from these
counts. Top values and small domains count texts by keys of bounded length. A
long text is never shuffled for its own sake: its key is its beginning and a
digest, and the few texts that a result shows are fetched by key.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import checks
from probity.functions.ordering import order_statistics
from probity.functions.partitioning import spread_small

NULL_DISPLAY = "<NULL>"
LIKELY_SENSITIVE_RATIO = 0.7
SMALL_DOMAIN = 20
#: Characters of a text that its key keeps; a longer one goes on with a digest of the whole text.
KEY_CHARACTERS = 64
SECOND_SEED = 0x5DEECE66D
#: Most keys that every task compares its rows with before it shuffles them.
LISTED_KEYS = 256


def first_rows(df, order_by, max_rows=10_000) -> DataFrame:
    """The first rows by a stated key; ``max_rows=None`` keeps every row."""
    return df if max_rows is None else df.orderBy(order_by).limit(max_rows)


def column_kinds(df):
    """numeric, text, datetime or other, per comparable column."""
    numeric, text = checks.numeric_columns(df), checks.string_columns(df)
    dates = checks.datetime_columns(df)
    return {
        c: "numeric" if c in numeric else "text" if c in text else "datetime" if c in dates else "other"
        for c in checks.scalar_columns(df)
    }


def _counted_as_number(df, column):
    """Whether the column's values fit eight bytes, so that they are counted without a text."""
    dtype = dict(df.dtypes)[column]
    return dtype in ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp", "date")


def _number(df, column):
    """(key, value) of a number, time or date: the key tells all values apart, the value is a double."""
    dtype, value = dict(df.dtypes)[column], F.col(f"`{column}`")
    if dtype in ("float", "double"):
        value = value.cast("double") + F.lit(0.0)  # the two zeros are one value
        # One to one on eight bytes.
        return F.when(value.isNotNull(), F.xxhash64(value)), value
    if dtype == "timestamp":
        value = F.unix_micros(value)
    elif dtype == "date":
        value = F.unix_date(value)
    return value.cast("bigint"), value.cast("double")


def _text_of_number(df, column, key, value):
    """A counted number as the cast of the column itself would write it."""
    dtype = dict(df.dtypes)[column]
    if dtype in ("float", "double"):
        return value.cast(dtype).cast("string")
    if dtype == "timestamp":
        return F.timestamp_micros(key).cast("string")
    return F.date_from_unix_date(key.cast("int")).cast("string") if dtype == "date" else key.cast("string")


def _dealt(df, columns):
    """The columns, named by their place so that no name gets in the way, of a small input on all cores."""
    return spread_small(df.select(*columns))


def number_counts(df, columns) -> DataFrame:
    """(column, key, value, n): rows per different value of columns of numbers, times and dates; nulls as null."""
    return _named(value_digests(df, columns), columns).select("column", "key", "value", "n")


def value_digests(df, columns) -> DataFrame:
    """(place, key, more, value, n): rows per different value of any columns, told apart by fixed-width keys.

    Numbers, times and dates are their own keys. Any other value has two 64-bit hashes of its text with different seeds,
    made where it is read, so that no text is shuffled. ``place`` is the column's place in ``columns``.
    """
    numbers = {c for c in columns if _counted_as_number(df, c)}
    hashed = []
    for i, c in enumerate(columns):
        if c in numbers:
            key, value = _number(df, c)
            hashed += [key.alias(f"k{i}"), value.alias(f"v{i}")]
        else:
            text = F.col(f"`{c}`").cast("string")
            hashed += [F.when(text.isNotNull(), F.xxhash64(text)).alias(f"k{i}"), F.xxhash64(F.lit(SECOND_SEED), text).alias(f"h{i}")]
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    cells = F.array(*[F.struct(
        F.lit(i).alias("place"), F.col(f"k{i}").alias("key"), (zero if c in numbers else F.when(F.col(f"k{i}").isNotNull(), F.col(f"h{i}"))).alias("more"),
        (F.col(f"v{i}") if c in numbers else none).alias("value")) for i, c in enumerate(columns)])
    return _dealt(df, hashed).select(F.inline(cells)).groupBy("place", "key", "more", "value").agg(F.count(F.lit(1)).alias("n"))


def _named(counts, columns):
    # All places count something; said like this, filters on the name stay above the counting, which several readers share.
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("place") + 1)
    return counts.withColumn("column", F.when(F.col("n" if "n" in counts.columns else "rows") > 0, name))


def _text_key(value):
    text = value.cast("string")
    # No short text is as long as a key with a digest.
    return F.when(F.length(text) <= KEY_CHARACTERS, text).otherwise(F.concat(F.substring(text, 1, KEY_CHARACTERS), F.md5(text.cast("binary"))))


def _text_pairs(df, columns, *more):
    return F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _text_key(F.col(f"`{c}`")).alias("key"), *[m(c) for m in more]) for c in columns]))


def text_counts(df, columns) -> DataFrame:
    """(column, key, n): rows per different value of columns as texts; a key holds the whole text or its beginning and a digest."""
    keys = _dealt(df, [_text_key(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("key")) for i, c in enumerate(columns)])
    return keys.select(F.inline(pairs)).groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"))


def _is_short(key):
    return F.length(key) <= KEY_CHARACTERS


def shown_texts(df, columns, wanted) -> DataFrame:
    """``wanted`` (column, key, ...) with ``value``, the text that each key stands for (null for a null key).

    Short keys are the texts. For the others the table is read again; if few keys are
    wanted, as for a list of top values, all other rows are dropped where they are.
    """
    long = wanted.where(~_is_short("key")).select("column", "key")
    listed = long.limit(LISTED_KEYS + 1).agg(F.collect_list("key").alias("keys")).select(
        F.when(F.size("keys") <= LISTED_KEYS, F.col("keys"))).scalar()
    # Only where there is a long text at all is its digest compared.
    rows = df.select(_text_pairs(df, columns, lambda c: F.col(f"`{c}`").cast("string").alias("value"))).where(
        ~_is_short("key") & (listed.isNull() | F.array_contains(listed, F.col("key"))))
    texts = rows.join(long, ["column", "key"], "left_semi").groupBy("column", "key").agg(F.min("value").alias("value"))
    return wanted.where(_is_short("key") | F.col("key").isNull()).withColumn("value", F.col("key")).unionByName(
        wanted.where(~_is_short("key")).join(texts, ["column", "key"]))


def _split(df, columns):
    numbers = [c for c in columns if _counted_as_number(df, c)]
    return numbers, [c for c in columns if c not in numbers]


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_counts(df, approximate=False, digests=None) -> DataFrame:
    """Distinct and missing values of every column.

    The approximate form needs no shuffle of values and suits very wide tables.
    ``digests`` are the ``value_digests`` of all columns, where the caller has them.
    """
    kinds = column_kinds(df)
    kind_map = F.create_map(*[F.lit(x) for item in kinds.items() for x in item])
    if approximate:
        totals = df.agg(F.count(F.lit(1)).alias("rows"), *[
            F.struct(F.approx_count_distinct(c).alias("d"), F.count(c).alias("k")).alias(c) for c in kinds
        ])
        counts = totals.select("rows", F.inline(F.array(*[
            F.struct(
                F.lit(c).alias("column"), F.col(c)["d"].alias("unique_count"),
                (F.col("rows") - F.col(c)["k"]).alias("null_count"),
            ) for c in kinds
        ])))
    else:
        digests = value_digests(df, list(kinds)) if digests is None else digests
        counts = _named(digests.groupBy("place").agg(
            F.sum("n").alias("rows"),
            F.count("key").alias("unique_count"),
            F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        ), list(kinds))
    share = F.coalesce(F.try_divide(F.col("null_count").cast("double"), F.col("rows").cast("double")), F.lit(0.0))
    return counts.select(
        "column", kind_map[F.col("column")].alias("kind"), "rows", "unique_count", "null_count",
        F.round(share * 100, 3).alias("null_percentage"),
    )


def medians(df, columns, numbers=None, spans=None) -> DataFrame:
    """Exact medians without bringing a column into one task; see ``order_statistics``."""
    if numbers is None:
        numbers = number_counts(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), columns)
    return order_statistics(numbers, [0.5], spans=spans).select("column", F.col("value").alias("median"))


def numeric_stats(df, columns=None, approximate=False, numbers=None) -> DataFrame:
    """Minimum, maximum, mean, median and sample deviation of numeric columns; ``numbers`` are their ``number_counts``, if known."""
    columns = checks.numeric_columns(df) if columns is None else columns
    dealt = _dealt(df, [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    wide = dealt.agg(*[
        F.struct(
            F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            *([F.percentile_approx(v, 0.5).alias("median")] if approximate else []),
        ).alias(v)
        for v in dealt.columns
    ])
    fields = ["min", "max", "mean", "std"] + (["median"] if approximate else [])
    stats = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"v{i}")[f].alias(f) for f in fields]) for i, c in enumerate(columns)
    ])))
    if not approximate:
        # One row per column. Columns that are not counted as numbers (decimals) are counted once more.
        spans = stats.select("column", F.col("min").alias("low"), F.col("max").alias("high"))
        others = [c for c in columns if not _counted_as_number(df, c)]
        known = [c for c in columns if c not in others]
        own = None if numbers is None else numbers.where(F.col("column").isin(known))
        parts = ([medians(df, known, own, spans)] if known else []) + ([medians(df, others, None, spans)] if others else [])
        stats = stats.join(F.broadcast(_union(parts)), "column", "left")
    return stats.select("column", "min", "max", "mean", "median", "std")


def top_values(df, columns=None, limit=10) -> DataFrame:
    """Most frequent values of the non-numeric columns, ties in value order."""
    kinds = column_kinds(df)
    columns = [c for c, k in kinds.items() if k != "numeric"] if columns is None else columns
    of_numbers, of_texts = _split(df, columns)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "shown")
    parts = []
    if of_numbers:
        # Their texts are short.
        parts.append(_number_texts(df, of_numbers, number_counts(df, of_numbers)).select(
            "column", F.coalesce("value", F.lit(NULL_DISPLAY)).alias("shown"), "n"))
    if of_texts:
        # All that can be among the first by count and the beginning of the text; only those that begin alike need the rest.
        begins = Window.partitionBy("column").orderBy(F.desc("n"), F.coalesce(F.substring("key", 1, KEY_CHARACTERS), F.lit(NULL_DISPLAY)))
        first = text_counts(df, of_texts).withColumn("place", F.rank().over(begins)).where(F.col("place") <= limit)
        parts.append(shown_texts(df, of_texts, first).select("column", F.coalesce("value", F.lit(NULL_DISPLAY)).alias("shown"), "n"))
    return _union(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        "column", F.col("shown").alias("value"), F.col("n").alias("count"), "rank")


def _number_texts(df, columns, counts):
    """(column, value as text, n) of counted numbers."""
    text = F.lit(None).cast("string")
    for c in columns:
        text = F.when(F.col("column") == c, _text_of_number(df, c, F.col("key"), F.col("value"))).otherwise(text)
    return counts.select("column", text.alias("value"), "n")


def small_domain_counts(df, max_values=SMALL_DOMAIN) -> DataFrame:
    """All counts of the columns that have at most ``max_values`` distinct values.

    A column leaves as soon as it has more: each task and each reducer sends at most one value more than that.
    """
    of_numbers, of_texts = _split(df, list(column_kinds(df)))

    def small(counts):
        least = Window.partitionBy("column").orderBy("key")
        known = counts.where(F.col("key").isNotNull())
        some = known.withColumn("place", F.row_number().over(least)).where(F.col("place") <= max_values + 1)
        every = Window.partitionBy("column")
        return some.withColumn("distinct", F.max("place").over(every)).where(F.col("distinct") <= max_values).drop("place", "distinct")

    parts = []
    if of_numbers:
        parts.append(_number_texts(df, of_numbers, small(number_counts(df, of_numbers))))
    if of_texts:
        parts.append(shown_texts(df, of_texts, small(text_counts(df, of_texts))).select("column", "value", "n"))
    return _union(parts).select("column", "value", F.col("n").alias("count"))


def column_profile(df, approximate=False) -> DataFrame:
    """Counts of every column with the statistics of the numeric ones."""
    columns = list(column_kinds(df))
    digests = None if approximate else value_digests(df, columns)
    numbers = None if approximate else _named(digests, columns)
    counts = column_counts(df, approximate, digests)
    if not checks.numeric_columns(df):
        empty = [F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean", "median", "std")]
        return counts.select("*", *empty)
    return counts.join(F.broadcast(numeric_stats(df, approximate=approximate, numbers=numbers)), "column", "left")


def registration_profile(df, value_counts=True) -> DataFrame:
    """One row (row_count, profile_data): types, missing and distinct values of every column as JSON, columns in name order.

    With ``value_counts`` also all counts of the columns with few distinct values. Lists are as long as the table
    is wide; a table without rows has no entries but its types.
    """
    def object_of(key, value):
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))

    kinds = sorted(df.dtypes)
    types = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.lit(t).alias("v")) for c, t in kinds]))
    facts = column_counts(df).agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("row_count"),
        object_of("column", "null_count").alias("missing_values"), object_of("column", "unique_count").alias("unique_counts"))
    parts = [types.alias("column_types"), "missing_values", "unique_counts"]
    if value_counts:
        small = small_domain_counts(df).groupBy("column").agg(object_of("value", "count").alias("values"))
        entries = small.agg(F.array_sort(F.collect_list(F.struct("column", F.map_entries("values").alias("values")))).alias("entries"))
        parts.append(entries.select(F.map_from_entries(F.transform("entries", lambda e: F.struct(
            e["column"].alias("k"), F.map_from_entries(e["values"]).alias("v"))))).scalar().alias("value_counts"))
    return facts.select("row_count", F.to_json(F.struct(*parts)).alias("profile_data"))


def likely_sensitive(profile) -> DataFrame:
    """Text columns whose values are mostly distinct."""
    ratio = F.coalesce(F.try_divide(F.col("unique_count").cast("double"), F.col("rows").cast("double")), F.lit(0.0))
    return profile.select(
        "column", ratio.alias("unique_ratio"),
        ((F.col("kind") == "text") & (ratio >= LIKELY_SENSITIVE_RATIO)).alias("likely_sensitive"),
    )
