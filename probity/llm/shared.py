"""Intermediate tables in the folder that all executors share, and sums of large arrays."""

import uuid

import numpy as np
import pyarrow as pa

from probity.session import ensure_checkpoint_dir

def literal_rows(spark, rows, schema):
    """A few rows of numbers (or None) as a table that is part of the plan; ``schema`` as in "a int, b long"."""
    fields = [f.split() for f in schema.split(",")]
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"{v}" for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({name} AS {'bigint' if kind == 'long' else kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(name for name, _ in fields)})")


#: Values of an array that travel in one row when arrays of all tasks are added up.
PIECE = 8192


def new_path(spark, name):
    """A path not used before, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df, name):
    """``df`` written as Parquet to the shared folder and read again: later steps don't repeat the work before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(array):
    """Rows (piece, total) that carry an array of integers."""
    flat = np.ascontiguousarray(array, np.int64).ravel()
    parts = [flat[i:i + PIECE] for i in range(0, len(flat), PIECE)]
    keep = [i for i, part in enumerate(parts) if part.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array(keep, pa.int32()), pa.array([parts[i].tobytes() for i in keep], pa.binary())], ["piece", "total"])


PIECES = "piece int, total binary"


def summed(df, length):
    """Add up the arrays that tasks have sent as ``pieces``; the sum (of ``length`` values) comes to the driver.

    Reducers hold one running sum per piece, however many tasks sent one.
    """
    def add(batches):
        totals = {}
        for batch in batches:
            for piece, total in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(total.as_buffer(), np.int64)
                totals[piece] = totals[piece] + part if piece in totals else part.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())],
            ["piece", "total"])

    out = np.zeros(length, np.int64)
    width = max(1, -(-length // PIECE))
    for row in df.repartition(min(16, width), "piece").mapInArrow(add, PIECES).collect():
        part = np.frombuffer(row["total"], np.int64)
        out[row["piece"] * PIECE:row["piece"] * PIECE + len(part)] += part
    return out
