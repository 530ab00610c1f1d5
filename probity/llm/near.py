"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF word shingles.

The weight of a shingle is its count in the text times its inverse document
frequency. Samples of a text fall into bands; texts that share a band are
candidates; candidates are verified by the weighted Jaccard similarity of their
whole shingle sets; verified links are joined to groups.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .components import components, stars
from .shared import PIECES, pieces, stored, summed
from .spans import TEXT, blocks, mixed, words

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Document frequencies are counted by hash of the shingle; every shingle of every text counts.
FREQUENCY_BUCKETS = 1 << 18
#: How much a shingle's rarity moves its weight. It is small, so that copies of a text that has very many copies are as near as others.
RARITY = 0.05
#: Entries of the tables that the samples' random numbers are drawn from.
DRAWS = 1 << 16
SHINGLE_BITS = 44
#: Texts that one task compares with as many others, and most texts connected through bands that are blocked together.
BLOCK = 1024
COMPONENT = 8 * BLOCK


def shingles(data, offsets, size=WORDS):
    """(row, shingle, count): the different shingles of every text, sorted; a text of fewer words than ``size`` (but not none) is one shingle."""
    hashes, row = words(data, offsets)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    if not len(hashes):
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty
    # A text's first shingle exists even if the text is short; it then ends with the text.
    first = np.cumsum(n) - n
    rank = np.arange(len(hashes)) - first[row]
    starts = np.flatnonzero((rank == 0) | (rank + size <= n[row]))
    total = np.zeros(len(starts), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(size):
        at = starts + k
        inside = rank[starts] + k < n[row[starts]]
        total = np.where(inside, total * factor + hashes[np.minimum(at, len(hashes) - 1)], total)
    keys = (row[starts].astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (mixed(total) >> np.uint64(64 - SHINGLE_BITS))
    keys.sort()
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(cuts, len(keys)))
    keys = keys[cuts]
    return (keys >> np.uint64(SHINGLE_BITS)).astype(np.int64), keys & np.uint64((1 << SHINGLE_BITS) - 1), counts


def _bucket(shingle):
    return (shingle >> np.uint64(SHINGLE_BITS - 18)).astype(np.int64)


def rarity(docs, size=WORDS, strength=RARITY):
    """The weight of a shingle of every bucket, from the document frequencies over all texts (the last entry: the number of texts)."""
    def counted(batches):
        total = np.zeros(FREQUENCY_BUCKETS + 1, np.int64)
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                total[:-1] += np.bincount(_bucket(shingles(data, offsets, size)[1]), minlength=FREQUENCY_BUCKETS)
                total[-1] += len(offsets) - 1
        yield pieces(total)

    total = summed(docs.select("text").mapInArrow(counted, PIECES), FREQUENCY_BUCKETS + 1)
    return (1 + strength * np.log((1 + total[-1]) / (1 + np.minimum(total[:-1], total[-1])))).astype(np.float64)


def _tables(seed=41):
    """Gamma(2,1) step sizes, logarithms of Gamma(2,1) levels and uniform shifts."""
    draw = np.random.default_rng(seed)
    return [t.astype(np.float32) for t in (draw.gamma(2, 1, DRAWS), np.log(draw.gamma(2, 1, DRAWS)), draw.random(DRAWS))]


def samples(row, shingle, weight, rows, n_samples, tables):
    """(rows x n_samples) consistent weighted samples; 0 for rows without shingles.

    A sample is the shingle of the least level together with its quantised
    weight; equal levels are decided by the shingle.
    """
    out = np.zeros((rows, n_samples), np.uint64)
    if not len(row):
        return out
    steps, levels, shifts = tables
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    there, sizes = row[cuts], np.diff(np.append(cuts, len(row)))
    log_weight = np.log(weight).astype(np.float32)
    for k in range(n_samples):
        if k % 4 == 0:
            spread = mixed(shingle * np.uint64(2 * k + 1) + np.uint64(k + 1))
        draw = ((spread >> np.uint64(16 * (k % 4))) & np.uint64(DRAWS - 1)).astype(np.int64)
        step = steps[draw]
        t = np.floor(log_weight / step + shifts[draw])
        level = levels[draw] - step * (t - shifts[draw]) - step
        least = np.minimum.reduceat(level, cuts)
        hit = np.flatnonzero(level == np.repeat(least, sizes))
        own = row[hit]
        hit = hit[np.concatenate([[True], own[1:] != own[:-1]])]  # shingles are sorted: the first one decides
        out[there, k] = mixed(shingle[hit] * np.uint64(1 << 19) + (t[hit].astype(np.int64) & ((1 << 19) - 1)).astype(np.uint64)) | np.uint64(1)
    return out


def _signed(values):
    return values.astype(np.uint64).view(np.int64)


def signatures(docs, weights, bands=BANDS, rows=ROWS, size=WORDS):
    """(doc_id, set1, set2, bands) of every row: a digest of its weighted set and a hash for every band.

    A text without words has the digest of its bytes and no bands, so it is a
    copy of equal texts only; a null text has null digests and copies nothing.
    """
    sent, tables = docs.sparkSession.sparkContext.broadcast(weights), _tables()

    def signed(batches):
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                n = len(offsets) - 1
                row, shingle, count = shingles(data, offsets, size)
                drawn = samples(row, shingle, count * sent.value[_bucket(shingle)], n, bands * rows, tables)
                band = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    band = band * np.uint64(0x9E3779B97F4A7C15) + drawn[:, k::rows]
                band = mixed(band + np.arange(bands, dtype=np.uint64))
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                item = shingle * np.uint64(1 << 20) + count.astype(np.uint64)
                np.add.at(one, row, mixed(item))
                np.add.at(two, row, mixed(item ^ np.uint64(0x5851F42D4C957F2D)))
                full = np.bincount(row, minlength=n) > 0
                for k in np.flatnonzero(~full):
                    raw = data[offsets[k]:offsets[k + 1]]
                    power = np.cumprod(np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
                    one[k] = ((raw.astype(np.uint64) + np.uint64(1)) * power).sum(dtype=np.uint64) + np.uint64(len(raw))
                    two[k] = mixed(one[k:k + 1])[0] ^ np.uint64(1)
                null = batch.column(1).slice(first, n).is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(full * bands)]), pa.int32()), pa.array(_signed(np.ascontiguousarray(band[full]).ravel())))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), pa.array(_signed(one), pa.int64(), mask=null), pa.array(_signed(two), pa.int64(), mask=null), lists],
                    ["doc_id", "set1", "set2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").alias(TEXT)).mapInArrow(signed, "doc_id long, set1 long, set2 long, bands array<long>")


def weighted_sets(docs, weights, size=WORDS):
    """(doc_id, shingles, weights) of every row, as sorted bytes of numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def built(batches):
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                n = len(offsets) - 1
                row, shingle, count = shingles(data, offsets, size)
                weight = (count * sent.value[_bucket(shingle)]).astype("<f4")
                cuts = np.searchsorted(row, np.arange(n + 1))
                raw = shingle.astype("<u8")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), pa.array([raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([weight[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["doc_id", "shingles", "weights"])

    return docs.select("doc_id", "text").mapInArrow(built, "doc_id long, shingles binary, weights binary")


def weighted_jaccard(first, first_weights, second, second_weights):
    """Sum of the smaller weights over the sum of the larger ones; both sets sorted."""
    _, i, j = np.intersect1d(first, second, assume_unique=True, return_indices=True)
    low = np.minimum(first_weights[i], second_weights[j]).sum(dtype=np.float64)
    whole = first_weights.sum(dtype=np.float64) + second_weights.sum(dtype=np.float64) - low
    return low / whole if whole else 0.0


def _flat(column, kind):
    """(values, ends) of a column of bytes that hold numbers."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def compared(table, similarity):
    """Star-shaped links (a, b) between the texts of two blocks that share a band and are similar enough."""
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    table = table.sort_by("rep")
    rep, block = table.column("rep").to_numpy(), table.column("block").to_numpy()
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    shingle, ends = _flat(table.column("shingles"), "<u8")
    weight = _flat(table.column("weights"), "<f4")[0].astype(np.float64)
    sizes = np.diff(ends, prepend=0)
    column, total = np.unique(shingle, return_inverse=True)[1], np.add.reduceat(weight, ends - sizes)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    own, a, b = np.zeros(len(shingle)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left:
        others = right[right > i] if first == second else right
        others = others[(bands[others] == bands[i]).any(axis=1)]
        if not len(others):
            continue
        mine = slice(ends[i] - sizes[i], ends[i])
        own[column[mine]] = weight[mine]
        cuts = np.cumsum(sizes[others]) - sizes[others]
        at = np.repeat(ends[others] - sizes[others] - cuts, sizes[others]) + np.arange(sizes[others].sum())
        low = np.add.reduceat(np.minimum(weight[at], own[column[at]]), cuts)
        own[column[mine]] = 0
        hit = others[low / (total[i] + total[others] - low) >= similarity]
        a.append(np.full(len(hit), i))
        b.append(hit)
    node, root = stars(np.concatenate(a), np.concatenate(b), len(rep))
    return pa.table({"a": pa.array(rep[node], pa.int64()), "b": pa.array(rep[root], pa.int64())})


def near_groups(docs, similarity=SIMILARITY, size=WORDS, bands=BANDS, rows=ROWS):
    """(doc_id, group_id, kept) of every row of ``docs`` (doc_id, text).

    group_id is the smallest doc_id of the documents joined by links of the
    similarity or more; kept is true for that document. Texts of equal weighted
    sets (case and punctuation aside) are copies; one of them stands for all.
    All different texts that share a band are compared, in pairs of blocks of a
    bounded size: blocks of all texts connected through bands or, if these are
    very many, blocks of one band's bucket. Only links travel, no pairs. Rows
    with a null text or doc_id are their own group and kept; repeated rows have
    one answer each; different texts of one id are one document. Columns other
    than doc_id and text are not read.
    """
    weights = rarity(docs.where(F.col("text").isNotNull()), size)
    known = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stored(signatures(known, weights, bands, rows, size), "near-signatures")
    usable = signed.where(F.col("doc_id").isNotNull() & F.col("set1").isNotNull())
    members = stored(usable.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-members")
    buckets = members.select("rep", F.posexplode("bands").alias("band", "hash"))
    leaders = buckets.groupBy("band", "hash").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    crowded = stored(buckets.join(leaders.select("band", "hash", "leader"), ["band", "hash"]), "near-buckets")
    tied = stored(components(crowded.select(F.col("rep").alias("a"), F.col("leader").alias("b"))), "near-candidates")
    sizes = tied.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    place = tied.join(sizes, "component").select(F.col("node").alias("rep"), "component", (F.col("n") > COMPONENT).alias("large"))
    small = place.where(~F.col("large")).select("rep", F.col("component").alias("key"), F.lit(-1).alias("part"))
    large = crowded.join(place.where("large"), "rep").select("rep", F.col("hash").alias("key"), F.col("band").alias("part"))
    spread = stored(small.unionAll(large), "near-blocks")
    counts = spread.groupBy("key", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = spread.join(counts.where(F.col("blocks") > 1), ["key", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("rep", F.lit(43)), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "part", "rep", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    # The texts that are anyone's candidates: the side of the ids is hashed, the texts are not sorted.
    needed = tied.select(F.col("node").alias("doc_id"))
    sets = weighted_sets(known.join(needed.hint("shuffle_hash"), "doc_id", "left_semi"), weights, size)
    sets = sets.groupBy("doc_id").agg(F.min(F.struct("shingles", "weights")).alias("own")).select(F.col("doc_id").alias("rep"), "own.*")
    one = members.groupBy("rep").agg(F.min("bands").alias("bands"))
    links = met.join(sets, "rep").join(one, "rep").groupBy("key", "part", "first", "second").applyInArrow(
        lambda table: compared(table, similarity), "a long, b long")
    groups = components(stored(links, "near-links"))
    found = members.select("set1", "set2", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set1", "set2", F.coalesce("component", "rep").alias("group_id"))
    # Rows without a set of their own must not meet in one task.
    keyed = signed.select("doc_id", "set1", "set2")
    able = F.col("doc_id").isNotNull() & F.col("set1").isNotNull()
    told = keyed.where(able).join(found, ["set1", "set2"])
    alone = keyed.where(~able).select("doc_id", F.col("doc_id").alias("group_id"))
    return told.select("doc_id", "group_id").unionAll(alone).select(
        "doc_id", "group_id", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("kept"))
