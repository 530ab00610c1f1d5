"""Personal data in columns: by name, by value pattern, by cardinality.

Values are read once as rows (column, value) and counted per column, so any
number of columns and patterns takes one pass and a shuffle of a few rows.
"""

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from probity.functions import constants as C
from probity.functions.checks import require_columns, string_columns
from probity.functions.partitioning import spread_small

LONG_TEXT = 64
GUARD_ROWS = 10
MAX_SAMPLES = 3
SAMPLE_CHARS = 50
REPORT_SCHEMA = (
    "column_name string, is_pii boolean, pii_type string, confidence double, "
    "detection_method string, details string"
)


def normalise_name(name):
    return name.lower().replace("_", "").replace("-", "").replace(" ", "")


def merged_patterns(custom=None):
    """Built-in patterns followed by the caller's; an unusable one is an error."""
    patterns = dict(C.PII_PATTERNS)
    for name, regex in (custom or {}).items():
        if not name or not regex:
            raise ValueError("custom_pii_patterns keys and regex values must be non-empty")
        try:
            re.compile(regex)
        except re.error as exc:
            raise ValueError(f"Invalid custom PII regex for '{name}': {exc}") from exc
        patterns[name] = regex
    return patterns


def merged_tokens(custom=None):
    extra = [normalise_name(t) for t in (custom or []) if isinstance(t, str) and t.strip()]
    return list(C.PII_COLUMN_TOKENS) + [t for t in extra if t not in C.PII_COLUMN_TOKENS]



def columns_by_name(columns, tokens=C.PII_COLUMN_TOKENS) -> DataFrame:
    """A table of columns (table, column) with the token each name contains."""
    return columns.withColumn("token", F.try_element_at(F.filter(
        F.array(*[F.lit(t) for t in tokens]),
        lambda t: F.contains(F.regexp_replace(F.lower("column"), "[_\\- ]", ""), t)), F.lit(1)))


# Every text a pattern matches holds this sign, or a digit. The cheap test for it
# comes first, which saves the pattern on most texts and changes no result.
MUST_HOLD = {"email": "@", "url": "://", "device": ":"}
MUST_HAVE_DIGIT = {
    C.PII_PATTERNS[n] for n in ("phone_us", "ssn", "credit_card", "ip_address", "date_of_birth", "zip_code")
} | {p for h in C.HIPAA_IDENTIFIERS if h[0] in ("dates", "geographic", "phone", "ssn", "ip_address") for p in h[3]}


def found(value, name, regex, digit=None):
    """Whether a text matches; ``digit`` says whether the text has a digit, if that is known."""
    if name in MUST_HOLD and (regex == C.PII_PATTERNS.get(name) or any(regex in h[3] for h in C.HIPAA_IDENTIFIERS)):
        return F.contains(value, F.lit(MUST_HOLD[name])) & value.rlike(regex)
    if digit is not None and regex in MUST_HAVE_DIGIT:
        return digit & value.rlike(regex)
    return value.rlike(regex)


def matches(value, pattern_name, regex, digit=None):
    """Whether a text matches; a ZIP must also open with a number in range."""
    hit = found(value, pattern_name, regex, digit)
    if pattern_name != "zip_code":
        return hit
    digits = F.regexp_extract(value, r"^(\d{5})", 1)
    return hit & F.coalesce(digits.try_cast("int").between(*C.ZIP_RANGE), F.lit(False))


def cell_rows(df, columns, keep=()) -> DataFrame:
    """Rows (position, column, value) of the named text columns, missing values included."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"))
        for i, c in enumerate(columns)
    ])
    # Keys get names of their own: one of them may be a text column or be called "value".
    named = [F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keep)]
    return spread_small(df.select(*named, *[f"`{c}`" for c in columns])).select(*[f"_key{i}" for i in range(len(keep))], F.inline(pairs))


def text_values(df, columns, keep=()) -> DataFrame:
    """Rows (column, value) of the named text columns, missing values left out."""
    rows = cell_rows(df, columns, keep).where(F.col("value").isNotNull())
    return rows.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keep)], "position", "column", "value")


def _keys(order_by):
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _first(keys, count):
    """The first ``count`` present values by the keys (equal keys by value) as an array.

    A bounded heap per group, filled in every task before the shuffle: no column
    is sorted and no other value travels.
    """
    entry = F.struct(*[f"_key{i}" for i in range(len(keys))], "value")
    return InternalFunction.collect_top_k(F.when(F.col("value").isNotNull(), entry), count, True)


def first_values(df, columns, order_by, count) -> DataFrame:
    """The first ``count`` present values of each column by the given key, in one scan."""
    keys = _keys(order_by)
    rows = cell_rows(df, columns, keys).where(F.col("value").isNotNull())
    return rows.groupBy("position", "column").agg(_first(keys, count).alias("first")).select(
        "position", "column", F.explode("first.value").alias("value"))


def _hits(patterns):
    return F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.count_if(matches(F.col("value"), name, regex, F.col("digit"))).alias("hits"))
        for name, regex in patterns.items()
    ])


def pattern_counts(values, patterns) -> DataFrame:
    """Per column: present values and an array of (pattern, hits) in pattern order."""
    return values.withColumn("digit", F.col("value").rlike("[0-9]")).groupBy("column").agg(
        F.count("value").alias("present"), _hits(patterns).alias("hits"))


def looks_like_date(value):
    parsed = F.try_to_timestamp(value)
    for fmt in C.DATE_FORMATS:
        parsed = F.coalesce(parsed, F.try_to_timestamp(value, F.lit(fmt)))
    return parsed.isNotNull()


def all_dates(values):
    """Whether an array of texts holds dates alone; an empty one doesn't."""
    return (F.size(values) > 0) & F.forall(values, looks_like_date)


def column_facts(df, columns, order_by, patterns, sample_size=None, approximate=False) -> DataFrame:
    """Per text column: rows, present values, pattern hits, whether it opens with dates, distinct values.

    One scan gives all but exact distinct counts, which shuffle the distinct
    values and so take a second one (``approximate`` saves it). ``sample_size``
    limits the patterns to the first values by ``order_by``.
    """
    keys = _keys(order_by)
    rows = cell_rows(df, columns, keys).withColumn("digit", F.col("value").rlike("[0-9]"))
    wanted = [F.count(F.lit(1)).alias("rows"), _first(keys, max(GUARD_ROWS, sample_size or 0)).alias("first")]
    if sample_size is None:
        wanted += [F.count("value").alias("present"), _hits(patterns).alias("hits")]
    if approximate:
        wanted.append(F.approx_count_distinct("value").alias("unique_count"))
    facts = rows.groupBy("column").agg(*wanted)
    opening = F.slice("first.value", 1, GUARD_ROWS)
    out = facts.withColumn("is_date", all_dates(opening))
    if sample_size is not None:
        sampled = facts.select("column", F.explode(F.slice("first.value", 1, sample_size)).alias("value"))
        out = out.join(pattern_counts(sampled, patterns), "column", "left")
    if not approximate:
        out = out.join(distinct_counts(text_values(df, columns)), "column", "left")
    return out.drop("first")


def distinct_counts(values, approximate=False) -> DataFrame:
    """Distinct values per column; long texts are shuffled as their digest."""
    key = F.when(F.length("value") > LONG_TEXT, F.md5("value")).otherwise(F.col("value"))
    if approximate:
        return values.groupBy("column").agg(F.approx_count_distinct(key).alias("unique_count"))
    return values.select("column", key.alias("key")).distinct().groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"))


def pii_report(
    df, order_by, columns=None, sample_size=None, custom_patterns=None, custom_tokens=None, approximate=False
) -> DataFrame:
    """One row per column: what kind of personal data it holds and how that was found.

    A name match beats a pattern match, which beats high cardinality.
    ``sample_size`` limits pattern matching to the first values by ``order_by``;
    by default every value is read.
    """
    if sample_size is not None and sample_size < 1:
        raise ValueError("sample_size must be at least 1")
    spark = df.sparkSession
    columns = list(df.columns) if columns is None else list(columns)
    require_columns(df, columns)
    patterns, tokens = merged_patterns(custom_patterns), merged_tokens(custom_tokens)
    named, rest = [], []
    for c in columns:
        token = next((t for t in tokens if t in normalise_name(c)), None)
        (named if token else rest).append((c, token))
    texts = [c for c, _ in rest if c in string_columns(df)]
    fixed = [
        (c, True, t, C.PII_NAME_CONFIDENCE, "column_name", f"Column name '{c}' matches known PII pattern '{t}'")
        for c, t in named
    ] + [(c, False, None, 0.0, "none", "No PII patterns detected") for c, _ in rest if c not in texts]
    out = spark.createDataFrame(fixed, REPORT_SCHEMA)
    return out.unionByName(_value_rows(df, texts, order_by, sample_size, patterns, approximate)) if texts else out


def _value_rows(df, texts, order_by, sample_size, patterns, approximate):
    listed = df.sparkSession.createDataFrame([(c,) for c in texts], "column string")
    facts = listed.join(column_facts(df, texts, order_by, patterns, sample_size, approximate), "column", "left")
    rate = lambda h: F.try_divide(h["hits"], F.col("present"))
    best = F.try_element_at(F.filter("hits", lambda h: rate(h) > C.PII_MATCH_RATE), F.lit(1))
    facts = facts.withColumn("best", best).withColumn("ratio", F.try_divide("unique_count", "rows"))
    empty = F.coalesce(F.col("present"), F.lit(0)) == 0
    by_pattern = F.col("best").isNotNull()
    unique = F.coalesce(F.col("ratio") > C.PII_UNIQUE_RATIO, F.lit(False))
    is_date = F.coalesce("is_date", F.lit(False))
    case = F.when(empty, "empty").when(by_pattern, "pattern").when(is_date, "date").when(unique, "unique")
    return facts.withColumn("case", F.coalesce(case, F.lit("clear"))).select(
        F.col("column").alias("column_name"),
        F.col("case").isin("pattern", "unique").alias("is_pii"),
        F.when(F.col("case") == "pattern", F.col("best")["pattern"])
        .when(F.col("case") == "unique", "potential_identifier").alias("pii_type"),
        F.when(F.col("case") == "pattern", F.least(rate(F.col("best")), F.lit(1.0)))
        .when(F.col("case") == "unique", C.PII_UNIQUE_CONFIDENCE).otherwise(0.0).alias("confidence"),
        F.when(F.col("case") == "pattern", "pattern").when(F.col("case") == "unique", "value_analysis")
        .otherwise("none").alias("detection_method"),
        F.when(F.col("case") == "empty", "Column is empty or contains only null values")
        .when(F.col("case") == "pattern", F.format_string(
            "%d/%d values match %s pattern", F.col("best")["hits"], F.col("present"), F.col("best")["pattern"]))
        .when(F.col("case") == "date", "Column contains datetime values")
        .when(F.col("case") == "unique", F.format_string(
            "High cardinality: %.1f%% unique values", F.col("ratio") * 100))
        .otherwise("No PII patterns detected").alias("details"),
    )


def pii_samples(df, report, order_by, custom_patterns=None, limit=MAX_SAMPLES) -> DataFrame:
    """The first matching values, cut short, of every column flagged by pattern."""
    keys = _keys(order_by)
    patterns = merged_patterns(custom_patterns)
    flagged = report.where("detection_method = 'pattern'").select(F.col("column_name").alias("column"), "pii_type")
    hit = F.lit(False)
    for name, regex in patterns.items():
        hit = hit | ((F.col("pii_type") == name) & matches(F.col("value"), name, regex))
    # One row per flagged column.
    hits = text_values(df, string_columns(df), keys).join(F.broadcast(flagged), "column").where(hit)
    order = Window.partitionBy("column").orderBy(*keys)
    return hits.select("column", *keys, "pii_type", F.substring("value", 1, SAMPLE_CHARS).alias("sample")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("column", "pii_type", "rank", "sample")


def column_listing(spark, frames) -> DataFrame:
    """(table, position, column, kind) of several DataFrames given by name."""
    rows = [(name, i, c, t) for name, df in frames.items() for i, (c, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table string, position int, column string, kind string")
