"""Small text and number clean-ups."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leading characters that a spreadsheet would run as a formula.
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r")


def guard_cell(column):
    """A text with a quote in front when it could run as a spreadsheet formula."""
    return F.when(F.substring(column, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), F.col(column))).otherwise(F.col(column))


def guard_cells(df):
    return df.withColumns({n: guard_cell(n) for n, t in df.dtypes if t == "string"})


def clean_metric_name(column):
    """A metric name with every sign other than letters, digits and _ replaced by _."""
    return F.regexp_replace(column, r"[^\p{L}\p{N}_]", "_")


def finite_or_null(value):
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(math.inf)), value)


def _safe(value, dtype):
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite_or_null(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda k, v: _safe(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [_safe(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def json_safe(df):
    """NaN and infinite numbers as null, at any depth."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def kept_texts(column):
    """An array of texts trimmed, with missing and blank ones dropped."""
    return F.filter(F.transform(column, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
