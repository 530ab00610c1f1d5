"""Product codes of vectors: integer components, codebooks by a fixed number of rounds, exact distances.

A component x is the integer floor(scale * x). In every batch each dimension has
a dictionary of the different integers it holds; the squared differences of
those to all entries of the codebook are tabulated once, and a part's distances
are gathers from these tables by dictionary code, added up over its dimensions.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from probity.functions.lookup import looked_up

from .shared import PIECES, pieces, stored, summed

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Distances that are worked out at once.
CELLS = 1 << 20
#: Components and sums travel in two halves of so many bits, so that sums of any number of rows stay exact.
HALF = 30
#: Largest component that is coded; more has no exact place in a long.
LARGEST = 1 << 60

_VECTOR, _ID, _LABEL = "__vector", "__id", "__label"


def kept(vectors, vector="embedding"):
    """The rows whose vector is not null and holds neither nulls nor values that are not finite."""
    values = F.col(f"`{vector}`").cast("array<double>")
    return vectors.where(values.isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def integers(column, width=None):
    """Rows of integers floor(SCALE * x) of a list column of finite values."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    width = (int(sizes[0]) if len(sizes) else 0) if width is None else width
    if (sizes != width).any():
        raise ValueError(f"vectors of {width} and of {int(sizes[sizes != width][0])} components can't share codebooks")
    rows = np.floor(column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.float64) * SCALE)
    if len(rows) and np.abs(rows).max() > LARGEST:
        raise ValueError("a component is too large for integer codes")
    return rows.astype(np.int64).reshape(len(column), width)


def _type(values, books):
    """int64 if no sum of squares can leave it, else Python's integers."""
    top = 2 * max([1, *(int(np.abs(x).max()) for x in (values, books) if x.size)])
    return np.int64 if top * top * max(1, values.shape[1]) < 1 << 62 else object


def assigned(values, books):
    """(entries, distances): for each row and part the nearest entry of the part's codebook (ties to the lower one).

    ``books`` has shape (parts, entries, dimensions of a part).
    """
    parts, entries, width = books.shape
    kind = _type(values, books)
    nearest = np.zeros((len(values), parts), np.int64)
    distance = np.zeros((len(values), parts), kind)
    step = max(1, CELLS // entries)
    for part in range(parts):
        tables, codes = [], []
        for d in range(width):
            different, code = np.unique(values[:, part * width + d], return_inverse=True)
            gap = different.astype(kind)[:, None] - books[part, :, d].astype(kind)[None, :]
            tables.append(gap * gap)
            codes.append(code)
        for first in range(0, len(values), step):
            rows = slice(first, first + step)
            total = np.zeros((len(values[rows]), entries), kind)
            for table, code in zip(tables, codes, strict=True):
                total += table[code[rows]]
            nearest[rows, part] = best = total.argmin(axis=1)
            distance[rows, part] = total[np.arange(len(best)), best]
    return nearest, distance


def first_books(vectors, ids="vec_id", vector="embedding", parts=PARTS, entries=ENTRIES):
    """Codebooks that start as the parts of the ``entries`` smallest ids' vectors, ascending; equal ids by their vectors."""
    least = vectors.select(F.col(f"`{ids}`").alias(_ID), F.col(f"`{vector}`").cast("array<double>").alias(_VECTOR)).orderBy(
        F.col(_ID).asc_nulls_last(), _VECTOR).limit(entries).collect()  # at most ``entries`` rows
    rows = integers(pa.array([r[_VECTOR] for r in least], pa.list_(pa.float64())))
    if rows.shape[1] % parts:
        raise ValueError(f"{rows.shape[1]} components can't be cut into {parts} equal parts")
    return rows.reshape(len(rows), parts, rows.shape[1] // parts).transpose(1, 0, 2)


def trained(vectors, vector="embedding", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, ids="vec_id"):
    """Codebooks after ``rounds`` rounds: every part goes to its nearest entry, then entries become floor(sum / count).

    Each task sends one array of sums, of the codebooks' size. An entry that no part chose stays.
    """
    books = first_books(vectors, ids, vector, parts, entries)
    if not books.size:
        return books
    shape = books.shape
    source = vectors.select(F.col(f"`{vector}`").cast("array<double>").alias(_VECTOR))
    spark = vectors.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)  # parts x entries x dimensions, whatever the table

        def add(batches, sent=sent):
            # Of each entry: how many parts, and the sums of the upper and the lower halves of their components.
            totals = np.zeros((3, *shape), np.int64)
            for batch in batches:
                values = integers(batch.column(0), shape[0] * shape[2])
                nearest, _ = assigned(values, sent.value)
                for part in range(shape[0]):
                    own = values[:, part * shape[2]:(part + 1) * shape[2]]
                    order = np.argsort(nearest[:, part], kind="stable")
                    chosen, first = np.unique(nearest[order, part], return_index=True)
                    if len(chosen):
                        totals[0, part, chosen] += np.diff(np.append(first, len(order)))[:, None]
                        totals[1, part, chosen] += np.add.reduceat(own[order] >> HALF, first, axis=0)
                        totals[2, part, chosen] += np.add.reduceat(own[order] & ((1 << HALF) - 1), first, axis=0)
            yield pieces(totals)

        count, upper, lower = summed(source.mapInArrow(add, PIECES), 3 * books.size).reshape(3, *shape)
        total = upper.astype(object) * (1 << HALF) + lower.astype(object)
        books = np.where(count > 0, total // np.maximum(count, 1), books.astype(object)).astype(np.int64)
    return books


def digest(books):
    """Hex digest of all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors, books, ids="vec_id", vector="embedding", keep=()):
    """(ids, *keep, code, error): two hex digits per part, and the squared distances of all parts added up (null beyond a long)."""
    source = vectors.select(F.col(f"`{ids}`"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").cast("array<double>").alias(_VECTOR))
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")

    def work(batches):
        for batch in batches:
            books = sent.value
            values = integers(batch.column(batch.num_columns - 1), books.shape[0] * books.shape[2])
            nearest, distance = assigned(values, books)
            code = np.ascontiguousarray(digits[nearest]).view(f"S{2 * books.shape[0]}").ravel().astype(str)
            errors = [e if e < 1 << 63 else None for e in map(int, distance.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(errors, pa.int64())],
                                             [*batch.schema.names[:-1], "code", "error"])

    return source.mapInArrow(work, f"{fields}, code string, error bigint")


def compressed(vectors, ids="vec_id", vector="embedding", label="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """(vec_id, code, error, label_error, codebooks_sha256), one row per kept vector.

    Vectors that are null or hold null or non-finite components are left out.
    Equal ids or repeated rows are coded each; null ids come last among the
    first entries; fewer kept vectors than ``entries`` make smaller codebooks;
    an empty table gives no rows. ``label_error`` adds up the errors of equal
    labels, nulls together (null beyond a long); labels may be as uneven as they like. Other
    columns are not read. Vectors of different lengths, lengths that can't be
    cut into ``parts`` and components beyond 2^60 / 256 are errors. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    own = kept(vectors, vector)
    books = trained(own, vector, parts, entries, rounds, ids)
    coded = encoded(own.withColumn(_LABEL, F.col(f"`{label}`")), books, ids, vector, [_LABEL]).select(
        F.col(f"`{ids}`").alias("vec_id"), _LABEL, "code", "error")
    coded = stored(coded, "codes")
    sums = coded.groupBy(_LABEL).agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    nulls = sums.where(F.col(_LABEL).isNull()).select("label_error").scalar()
    return looked_up(coded, sums.where(F.col(_LABEL).isNotNull()), [_LABEL]).select(
        "vec_id", "code", "error", F.when(F.col(_LABEL).isNull(), nulls).otherwise(F.col("label_error")).alias("label_error"),
        F.lit(digest(books)).alias("codebooks_sha256"))
