"""Argument checks made before a plan is built."""


def require_columns(df, columns):
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Columns not found in dataset: {missing}")


def string_columns(df):
    return [name for name, dtype in df.dtypes if dtype == "string"]


def numeric_columns(df):
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [name for name, dtype in df.dtypes if dtype in kinds or dtype.startswith("decimal")]


def datetime_columns(df):
    return [name for name, dtype in df.dtypes if dtype in ("timestamp", "timestamp_ntz", "date")]


def scalar_columns(df):
    """Columns whose values can be compared and counted."""
    return [
        name for name, dtype in df.dtypes
        if not dtype.startswith(("array", "map", "struct", "variant"))
    ]
