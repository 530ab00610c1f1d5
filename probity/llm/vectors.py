"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Equal vectors are one vector with a count. Every tree splits recursively at the
sample's median along a random direction; vectors near the cut go to both sides.
Vectors are compared in double precision inside the leaves only, large leaves in
pairs of blocks. A pair that shares several leaves counts in the first of them,
so that numbers of links add up without listing the pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .components import components, stars
from .shared import stored

#: Different vectors that a leaf should hold, and most that one task compares with as many others.
LEAF = 2048
BLOCK = 2048
#: Rows of the bounded sample that sets the trees' cuts, and the fewest of them for a further split.
SAMPLE = 16_384
SPLIT_ROWS = 32
TREES = 4
#: Half width of the overlap at a cut, in standard deviations of the projected distance of a pair at the threshold.
SPILL = 1.2

PAIRS = 1 << 18


def _unit(column):
    """Unit rows, in double precision, of a list column of finite values."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    rows = values[offsets[0]:offsets[-1]].reshape(len(column), -1)
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / top  # else squares of very large or small values would leave the range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def plant(sample, rows, threshold, trees=TREES, leaf=LEAF, seed=17):
    """Directions, cuts and overlap of a forest for ``rows`` vectors, set by a sample (unit rows)."""
    width = sample.shape[1] if sample.ndim == 2 and len(sample) else 1
    depth = int(max(0, min(np.ceil(np.log2(max(1, rows) / leaf)), np.floor(np.log2(max(1, len(sample)) / SPLIT_ROWS)))))
    draw = np.random.default_rng(seed)
    directions = draw.normal(size=(trees, depth, width))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    spill = SPILL * np.sqrt(max(0.0, 2 - 2 * threshold) / width)
    cuts = np.zeros((trees, (1 << depth) - 1))
    for t in range(trees):
        nodes = {0: np.arange(len(sample))}
        for level in range(depth):
            values, below = sample @ directions[t, level], {}
            for node, own in nodes.items():
                cut = float(np.median(values[own])) if len(own) else 0.0
                cuts[t, node] = cut
                below[2 * node + 1], below[2 * node + 2] = own[values[own] < cut], own[values[own] >= cut]
            nodes = below
    return {"directions": directions, "cuts": cuts, "spill": spill, "depth": depth}


def leaves(rows, forest):
    """(row, leaf) of every leaf that a vector falls into; leaves of all trees are numbered through."""
    trees, depth = forest["directions"].shape[:2]
    found = []
    for t in range(trees):
        row, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for level in range(depth):
            value, cut = (rows @ forest["directions"][t, level])[row], forest["cuts"][t, node]
            left, right = value < cut + forest["spill"], value >= cut - forest["spill"]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        found.append((row, node - ((1 << depth) - 1) + (t << depth)))
    row, leaf = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


def _compared(table, threshold):
    """Numbers of links and star-shaped links of one pair of blocks."""
    leaf, first, second = (table.column(c)[0].as_py() for c in ("leaf", "first", "second"))
    table = table.sort_by("uid")
    uid, n, block = (table.column(c).to_numpy() for c in ("uid", "n", "block"))
    rows = _unit(table.column("embedding").combine_chunks())
    own = table.column("leaves").combine_chunks()
    sizes = np.diff(own.offsets.to_numpy())
    every = np.full((len(uid), int(sizes.max())), -1, np.int64)
    every[np.arange(every.shape[1]) < sizes[:, None]] = own.values.to_numpy()[own.offsets.to_numpy()[0]:own.offsets.to_numpy()[-1]]
    # Only leaves before this one matter.
    every[every >= leaf] = -1
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    links, a, b = np.zeros(len(uid), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, PAIRS * 8 // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at:at + step]
        i, j = np.nonzero(rows[part] @ rows[right].T >= threshold)
        i, j = part[i], right[j]
        kept = i < j if first == second else i != j
        i, j = i[kept], j[kept]
        for k in range(0, len(i), PAIRS):
            x, y = i[k:k + PAIRS], j[k:k + PAIRS]
            shared = np.zeros(len(x), bool)
            for c in range(every.shape[1]):
                shared |= ((every[x, c][:, None] == every[y]) & (every[x, c] >= 0)[:, None]).any(axis=1)
            x, y = x[~shared], y[~shared]
            links += np.bincount(x, n[y], len(uid)).astype(np.int64) + np.bincount(y, n[x], len(uid)).astype(np.int64)
            a.append(x)
            b.append(y)
    node, root = stars(np.concatenate(a), np.concatenate(b), len(uid))
    linked = np.flatnonzero(links)
    return pa.table({
        "uid": pa.array(np.concatenate([uid[linked], uid[node]])),
        "links": pa.array(np.concatenate([links[linked], np.zeros(len(node), np.int64)])),
        "root": pa.array(np.concatenate([uid[linked], uid[root]]))})


def near_vectors(vectors, threshold=0.98, trees=TREES, leaf=LEAF, sample=SAMPLE):
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows are compared if their labels (and dimensions) are equal and not null.
    Rows without a vec_id and vectors that are null, empty, zero or hold null or
    non-finite values link with nothing and are their own component. Repeated
    rows are linked vectors like any others; component_id is then their common
    vec_id. An empty table gives no rows. The trees' cuts come from a bounded
    sample of ``sample`` different vectors; every vector goes through every tree.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    able = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit).withColumn("width", F.size("embedding"))
    unique = able.groupBy("label", "width", "embedding").agg(F.min("vec_id").alias("uid"), F.count(F.lit(1)).alias("n"))
    unique = stored(unique, "vectors")
    widths = {r["width"]: r["rows"] for r in unique.groupBy("width").agg(F.count(F.lit(1)).alias("rows")).collect()}
    found = None
    for width, count in sorted(widths.items()):
        own = unique.where(F.col("width") == width)
        share = min(1.0, 1.1 * sample / count)
        drawn = own.where(F.pmod(F.xxhash64("uid", F.lit(23)), F.lit(1 << 30)) < share * (1 << 30)).select("uid", "embedding").limit(2 * sample).toArrow()
        drawn = drawn.sort_by("uid").slice(0, sample)
        forest = plant(_unit(drawn.column("embedding").combine_chunks()) if len(drawn) else np.zeros((0, width)), count, threshold, trees, leaf)
        one = _links(own, spark.sparkContext.broadcast(forest), threshold)
        found = one if found is None else found.unionAll(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "vector-links")
    parts = components(found.where(F.col("root") != F.col("uid")).select(F.col("uid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    told = unique.join(links, "uid", "left").join(parts.withColumnRenamed("node", "uid"), "uid", "left").select(
        F.col("label").alias("own_label"), F.col("embedding").alias("own"), F.col("uid"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("component", "uid").alias("component"), F.xxhash64("label", "embedding").alias("key"))
    # A key of its own for rows that link with nothing, so that they don't meet in one task.
    able_row = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False))
    keyed = rows.withColumn("key", F.when(able_row, F.xxhash64("label", "embedding")).otherwise(F.xxhash64("vec_id", F.lit(29))))
    joined = keyed.withColumn("able", able_row).join(
        told, (keyed["key"] == told["key"]) & F.col("able") & (F.col("label") == F.col("own_label")) & (F.col("embedding") == F.col("own")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(unique, forest, threshold):
    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, leaf = leaves(_unit(batch.column(1)), forest.value)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(leaf))], [*batch.schema.names, "leaves"])

    columns = unique.select("uid", "embedding", "label", "n")
    placed_rows = columns.mapInArrow(placed, f"{_ddl(columns)}, leaves array<long>")
    placed_rows = stored(placed_rows, "vector-leaves")
    spread = placed_rows.withColumn("leaf", F.explode("leaves"))
    sizes = spread.groupBy("leaf", "label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    large = sizes.where(F.col("blocks") > 1)
    cut = spread.join(large, ["leaf", "label"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("uid", F.lit(31)), F.col("blocks")).cast("int"))
    # Every block meets every block of its leaf, itself included.
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "uid", "embedding", "n", "leaves", "leaf", "label", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return met.groupBy("leaf", "label", "first", "second").applyInArrow(
        lambda table: _compared(table, threshold), "uid long, links long, root long")


def _ddl(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
