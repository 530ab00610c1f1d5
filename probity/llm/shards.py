"""K-d tree shards: cells are split at weighted medians along their widest dimension until a leaf holds the target bytes.

Only DataFrame operations. A cell that stands for k shards is split so that one
side holds k // 2 of them by weight. The cut is found by histograms: one
aggregate over all open cells gives the bytes per bin, the bin with the cut is
cut into bins again, and so on until what is left of it weighs no more than the
tolerance. What travels to the driver is a row per open cell.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import literal_rows, stored

#: Bins that a range is cut into in one pass.
BINS = 1 << 14
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: Bits of the hash that follow a dimension's value and part rows of equal values.
TIE_BITS = 31
LAST_ID = (1 << 63) - 1


def sized(docs, dimensions=None):
    """The columns a tree is built on: doc_id, size (UTF-8 bytes plus 16), text_crc32, dimensions d0, d1, ...

    ``dimensions``: expressions of whole numbers from 0 to 2 ** 31, by default
    the size of the text, its bytes a character in thousandths and its
    checksum. They depend on the text alone, so that equal texts have equal
    coordinates and stay together wherever the target allows. Nulls count as 0,
    a null text as empty.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    dimensions = dimensions or [size, (size * 1000 / F.greatest(F.char_length(text), F.lit(1))).cast("long"), F.shiftright(F.crc32(text.cast("binary")), 1)]
    # A value is followed by bits of a hash of the text: different texts of one value can be parted, equal texts can't.
    tie = F.pmod(F.xxhash64(text), F.lit(1 << TIE_BITS))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (size + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[(F.shiftleft(F.coalesce(d.cast("long"), F.lit(0)), TIE_BITS) + tie).alias(f"d{i}") for i, d in enumerate(dimensions)],
        # Where one text alone is too heavy, its rows are parted by a hash of their ids.
        F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(3)), 1).alias("last"))


def _cuts(rows, cells, axes, tolerance):
    """{cell: (axis, cut, last cut)}: rows of the cell beyond (cut, last cut) in (axis value, id hash) go right.

    ``cells``: {cell: (shards, axis, lowest, highest, bytes to the left)}.
    """
    done, open_cells = {}, {c: {"axis": a, "low": low, "high": high, "want": want, "value": None} for c, (_, a, low, high, want) in cells.items()}
    while open_cells:
        # One row per open cell, at most as many as shards; "at" is the one value left, if there is only one.
        state = literal_rows(
            rows.sparkSession, [(c, s["axis"], s["low"], s["high"], s["value"], s["want"]) for c, s in open_cells.items()],
            "cell int, axis int, low long, high long, at long, want long")
        at = F.col("at")
        coordinate = F.element_at(F.array(*[F.col(f"d{i}") for i in range(axes)]), F.col("axis") + 1)
        # Bins of the axis, or, once a single value is left, of the hash of the ids of its rows.
        position = F.when(at.isNull(), coordinate).otherwise(F.col("last"))
        picked = rows.join(F.broadcast(state), "cell").select("*", position.alias("position"), coordinate.alias("coordinate"))
        picked = picked.where((F.col("position") >= F.col("low")) & (F.col("position") <= F.col("high")) & (at.isNull() | (F.col("coordinate") == at)))
        binned = picked.select("cell", F.expr(f"(position - low) div ((high - low) div {BINS} + 1)").alias("bin"), "size", "want")
        histogram = binned.groupBy("cell", "bin", "want").agg(F.sum("size").alias("weight"))
        running = F.sum("weight").over(Window.partitionBy("cell").orderBy("bin"))
        reached = histogram.withColumn("up_to", running).where(F.col("up_to") >= F.col("want"))
        first = reached.groupBy("cell").agg(F.min_by(F.struct("bin", "weight", "up_to"), "bin").alias("hit"))
        for r in first.collect():
            cell, hit, state = r["cell"], r["hit"], open_cells[r["cell"]]
            step = (state["high"] - state["low"]) // BINS + 1
            bin_low = state["low"] + hit["bin"] * step
            bin_high = min(state["high"], bin_low + step - 1)
            before = hit["up_to"] - hit["weight"]
            if hit["weight"] <= tolerance or (bin_low == bin_high and state["value"] is not None):
                # The nearer side of the bin; what is in it stays together.
                edge = bin_high if hit["up_to"] - state["want"] <= state["want"] - before else bin_low - 1
                done[cell] = (state["axis"], edge, LAST_ID) if state["value"] is None else (state["axis"], state["value"], edge)
                del open_cells[cell]
            elif bin_low == bin_high:  # one text, heavier than the tolerance
                state |= {"value": bin_low, "low": 0, "high": LAST_ID, "want": state["want"] - before}
            else:
                state |= {"low": bin_low, "high": bin_high, "want": state["want"] - before}
    return done


def assign(rows, shards, tolerance_share=0.01):
    """``rows`` (of ``sized``) with the leaf of each, 0 to shards - 1; the sizes of all leaves are near equal.

    A bin with a cut is parted no further once it weighs less than
    ``tolerance_share`` of a leaf, so equal texts that weigh less than that
    always share a leaf. Rows that are equal in everything share a leaf, too.
    Without rows there are no leaves.
    """
    axes = sum(c[0] == "d" and c[1:].isdigit() for c in rows.columns)
    spans = [x for i in range(axes) for x in (F.min(f"d{i}").alias(f"low{i}"), F.max(f"d{i}").alias(f"high{i}"))]
    whole = rows.agg(F.sum("size").alias("weight"), *spans).head()
    if whole["weight"] is None:
        return rows.withColumn("shard", F.lit(0))
    tolerance = int(whole["weight"] / shards * tolerance_share)
    scale = [max(1, whole[f"high{i}"] - whole[f"low{i}"]) for i in range(axes)]
    # A cell is named by the first of its shards.
    state = {0: shards}
    rows = rows.withColumn("cell", F.lit(0))
    while any(k > 1 for k in state.values()):
        split = {c: k for c, k in state.items() if k > 1}
        cells = {}
        for r in rows.where(F.col("cell").isin(list(split))).groupBy("cell").agg(F.sum("size").alias("weight"), *spans).collect():
            widest = max(range(axes), key=lambda i: ((r[f"high{i}"] - r[f"low{i}"]) / scale[i], -i))
            k = split[r["cell"]]
            cells[r["cell"]] = (k, widest, r[f"low{widest}"], r[f"high{widest}"], max(1, round(r["weight"] * (k // 2) / k)))
        cuts = _cuts(rows, cells, axes, tolerance)
        # One row per cell, at most as many as shards.
        plan = literal_rows(
            rows.sparkSession, [(c, a, v, last, c + split[c] // 2) for c, (a, v, last) in cuts.items()], "cell int, axis int, cut long, last_cut long, right int")
        coordinate = F.element_at(F.array(*[F.col(f"d{i}") for i in range(axes)]), F.col("axis") + 1)
        right = (coordinate > F.col("cut")) | ((coordinate == F.col("cut")) & (F.col("last") > F.col("last_cut")))
        columns = [c for c in rows.columns if c != "cell"]
        rows = rows.join(F.broadcast(plan), "cell", "left").select(
            *columns, F.when(F.coalesce(right, F.lit(False)), F.col("right")).otherwise(F.col("cell")).alias("cell"))
        rows = stored(rows, "shard-cells")  # a level reads the cells of the one before, not all cuts so far
        state = {s: n for c, k in state.items() for s, n in ([(c, k)] if k == 1 else [(c, k // 2), (c + k // 2, k - k // 2)])}
    return rows.withColumnRenamed("cell", "shard")


#: Rows that share a counter when slots are numbered.
SLOT_ROWS = 100_000


def slots(rows, total):
    """Number the rows of every shard from 0 without gaps.

    A shard's rows are dealt by a hash of the id into as many groups as
    ``total`` rows need; a row's slot is the size of the groups before its own
    and its rank there. Equal rows take neighbouring slots.
    """
    groups = max(1, -(-total // SLOT_ROWS))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("last", "text_crc32"), F.lit(groups)))
    order = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("shard", "group").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "group", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "group").orderBy("last", "doc_id", "text_crc32"))
    return rows.withColumn("rank", rank - 1).join(before, ["shard", "group"]).withColumn("slot", (F.col("before") + F.col("rank")).cast("long"))


def shards_for(weight, target_bytes):
    """As many leaves as hold at most about the target."""
    return max(1, -(-int(weight or 0) // int(target_bytes)))


def sharded(docs, shards=None, target_bytes=None, dimensions=None):
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``.

    Give the number of shards or the bytes of one. Null and empty texts weigh
    16 bytes; repeated rows stay repeated, and where they weigh more than the
    tolerance and have one id only, they can't be parted. Columns other than
    doc_id and text are not read. An empty table gives no rows.
    """
    rows = stored(sized(docs, dimensions), "shard-rows")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).head()
    shards = shards or shards_for(whole["weight"], target_bytes)
    leaves = assign(rows, shards)
    return slots(leaves, whole["n"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
