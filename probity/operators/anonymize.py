"""Anonymisation of columns and advice on how to do it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.checks import numeric_columns, require_columns, string_columns

BINS = 5
ROUNDING_RANGE = 20
CATEGORY_SHARE = 0.1


def bin_codes(df, columns, bins=BINS) -> DataFrame:
    """Numeric columns as codes of equal-width, right-closed bins; the lowest value is in the first."""
    edges = df.agg(F.struct(*[
        F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias(c)
        for c in columns for v in [F.col(c).cast("double")]
    ]).alias("edges")).scalar()
    out = {}
    for c in columns:
        low, high, value = edges[c]["low"], edges[c]["high"], F.col(c).cast("double")
        code = F.ceil((value - low) / ((high - low) / F.lit(bins))).cast("int") - 1
        # A constant column sits in the middle bin.
        code = F.when(high == low, F.lit((bins - 1) // 2)).otherwise(F.greatest(F.least(code, F.lit(bins - 1)), F.lit(0)))
        out[c] = F.when(value.isNotNull(), code)
    return df.withColumns(out)


def anonymise(df, strategies) -> DataFrame:
    """Applies bin, generalize, mask or suppress per column; unknown columns are skipped.

    Missing texts stay missing.
    """
    numeric, texts = numeric_columns(df), string_columns(df)
    chosen = {c: s for c, s in strategies.items() if c in df.columns}
    binned = [c for c, s in chosen.items() if s == "bin" and c in numeric]
    out = bin_codes(df, binned) if binned else df
    out = out.withColumns({
        c: F.concat(F.substring(c, 1, 3 if s == "generalize" else 2), F.lit("**" if s == "generalize" else "***"))
        for c, s in chosen.items() if s in ("generalize", "mask") and c in texts
    })
    return out.drop(*[c for c, s in chosen.items() if s == "suppress"])


# Advice rows as (method, privacy gain, utility loss).
ADVICE = {
    "binning": ("High", "Low to Medium"),
    "rounding": ("Medium", "Low"),
    "noise_addition": ("High", "Very Low"),
    "masking": ("High", "Medium"),
    "generalization": ("High", "Medium"),
    "categorization": ("Medium to High", "Medium"),
    "suppression": ("Maximum", "Maximum"),
}

# Advice texts.
ADVICE_TEXT = {
    "rounding": "Round to nearest 5 or 10",
    "noise_addition": "Add small random noise (differential privacy)",
    "masking": "Mask part of the value",
    "generalization": "Use broader category",
    "categorization": "Group into broader categories",
    "suppression": "Remove column entirely if not essential for analysis",
}


def generalisation_advice(df, columns) -> DataFrame:
    """Ways to make each column less identifying, best first, with its basic facts."""
    require_columns(df, columns)
    numeric, texts = numeric_columns(df), string_columns(df)

    def facts(c):
        low = F.min(F.col(c).cast("double")) if c in numeric else F.lit(None).cast("double")
        high = F.max(F.col(c).cast("double")) if c in numeric else F.lit(None).cast("double")
        return low, high

    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(facts(c)[0].alias("low"), facts(c)[1].alias("high"), F.count(c).alias("present")).alias(c)
        for c in columns
    ])
    rows = wide.select("rows", F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.lit("numeric" if c in numeric else "text" if c in texts else "other").alias("kind"),
            F.col(c)["low"].alias("low"), F.col(c)["high"].alias("high"), F.col(c)["present"].alias("present"),
        ) for c in columns
    ])))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = df.select(F.inline(pairs)).distinct().groupBy("column").agg(F.count("value").alias("unique_values"))
    known = rows.join(distinct, "column", "left").withColumn("spread", F.col("high") - F.col("low"))
    is_number, is_text = F.col("kind") == "numeric", F.col("kind") == "text"
    few = F.col("unique_values") < F.col("rows") * CATEGORY_SHARE
    applies = {
        "binning": is_number,
        "rounding": is_number & (F.col("spread") > ROUNDING_RANGE),
        "noise_addition": is_number,
        "masking": is_text,
        "generalization": is_text,
        "categorization": is_text & few,
        "suppression": F.lit(True),
    }
    offers = F.array_compact(F.array(*[
        F.when(rule, F.struct(
            F.lit(m).alias("method"), F.lit(ADVICE[m][0]).alias("privacy_gain"), F.lit(ADVICE[m][1]).alias("utility_loss"),
        )) for m, rule in applies.items()
    ]))
    words = F.create_map(*[F.lit(x) for item in ADVICE_TEXT.items() for x in item])
    ranges = F.format_string("Group into ranges (e.g., %.1f-%.1f into 5-10 bins)", "low", "high")
    return known.select(
        "column", "kind", F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        (F.col("rows") - F.col("present")).alias("null_count"), "low", "high",
        F.posexplode(offers).alias("position", "offer"),
    ).select(
        "column", "kind", "unique_values", "null_count", "position", "offer.*",
        F.coalesce(words[F.col("offer")["method"]], ranges).alias("description"),
    )
