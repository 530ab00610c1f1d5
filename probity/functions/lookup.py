"""Joins with a table of one row per key where a few keys, or nulls, hold most of the rows."""

from functools import reduce

from pyspark.sql import functions as F

#: A key is heavy when it holds more than this share of the rows, so at most 1 / HEAVY keys are.
HEAVY = 1 / 1024

_FOUND = "__found"


def is_heavy(values, rows="rows", share=HEAVY):
    """Whether a row of ``values`` holds more than ``share`` of all rows: true of at most 1 / share of them, whatever the table."""
    total = values.agg(F.sum(rows).alias("total")).select("total").scalar()
    return F.coalesce(F.col(rows) > total * F.lit(share), F.lit(False))


def heavy_keys(values, rows="rows", share=HEAVY):
    """The rows of ``values`` with a heavy key."""
    return values.where(is_heavy(values, rows, share))


def looked_up(df, values, keys, rows="rows", share=HEAVY):
    """``df`` with the columns that ``values`` has beside ``keys`` and ``rows``; null where a key is null or unknown.

    ``values`` has one row per key and in ``rows`` how many rows of ``df`` have
    it. Rows of heavy keys find theirs in a table of at most 1 / share rows that
    every task holds, and rows with a null key need no search: neither is
    shuffled. Only the rest, in which no key is heavy, is joined by a shuffle.
    """
    keys = list(keys)
    new = [c for c in values.columns if c not in keys and c != rows]
    heavy = heavy_keys(values, rows, share).select(*keys, *new, F.lit(True).alias(_FOUND))
    light = values.where(~is_heavy(values, rows, share)).select(*keys, *new)
    told = df.join(F.broadcast(heavy), keys, "left").select(*[f"`{c}`" for c in df.columns], *new, _FOUND)
    unknown = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    done = told.where(F.col(_FOUND) | unknown)
    rest = told.where(F.col(_FOUND).isNull() & ~unknown).drop(*new)
    return done.drop(_FOUND).unionByName(rest.drop(_FOUND).join(light, keys, "left").select(*[f"`{c}`" for c in df.columns], *new))


def looked_up_all(df, tables, spread_by, rows="rows", total="total", share=HEAVY):
    """``df`` with each column of ``tables`` looked up in its own table, in one pass.

    ``tables`` is {column: (values, new column)}; ``values`` has the column's
    different values, the new column, ``rows`` and, in every row, the ``total`` of
    these. All heavy values are found in the first pass over the rows, without a
    shuffle. Only rows that have a rare value in some column go on to the shuffled
    joins; there a column that is null or already found joins with nothing, under
    keys dealt out by ``spread_by``.
    """
    told, light = df, {}
    for c, (values, new) in tables.items():
        heavy = F.col(rows) > F.col(total) * F.lit(share)
        named = [F.col(c).alias(f"_k_{c}"), F.col(new).alias(f"_n_{c}")]
        # At most 1 / share rows.
        told = told.join(F.broadcast(values.where(heavy).select(*named)), F.col(c) == F.col(f"_k_{c}"), "left").drop(f"_k_{c}")
        light[c] = values.where(~heavy).select(F.col(c).alias(f"_k_{c}"), F.col(new).alias(f"_m_{c}"), F.lit(0).cast("bigint").alias(f"_s_{c}"))
    open_ = {c: F.col(c).isNotNull() & F.col(f"_n_{c}").isNull() for c in tables}
    unknown = reduce(lambda a, b: a | b, open_.values())
    rest = told.where(unknown)
    for c, values in light.items():
        key = F.when(open_[c], F.col(c))
        salt = F.when(open_[c], F.lit(0)).otherwise(F.pmod(F.xxhash64(spread_by), F.lit(1 << 20)) + 1)
        found = rest.withColumns({f"_kk_{c}": key, f"_ss_{c}": salt}).join(
            values, (F.col(f"_kk_{c}") == F.col(f"_k_{c}")) & (F.col(f"_ss_{c}") == F.col(f"_s_{c}")), "left")
        rest = found.withColumn(f"_n_{c}", F.coalesce(f"_n_{c}", f"_m_{c}")).drop(f"_kk_{c}", f"_ss_{c}", f"_k_{c}", f"_s_{c}", f"_m_{c}")
    out = told.where(~unknown).unionByName(rest)
    return out.select(*df.columns, *[F.col(f"_n_{c}").alias(new) for c, (_, new) in tables.items()])
