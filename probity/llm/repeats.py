"""Removal of repeated byte strings by suffix arrays built with a difference cover.

A suffix array over every byte of a corpus would be many times its size, so the
corpus is first cut to where repeats can be: every string of LENGTH bytes holds
an anchor (the least hash of the k-grams in it), and equal strings hold equal
anchors. The strings that hold an anchor lie in the bytes around it. Of equal
bytes around equal anchors all but those of the smallest doc_id are removed
whole, so only one text of each kind has to be compared: told by a 64-bit hash
beside the anchor's, before any text travels. Different texts around one anchor
meet in one task, unless they are very many (see HOT_KINDS). There their suffix array is built by the difference cover
modulo 3 - sort the sampled triples, recurse on their names, merge the other
suffixes - and neighbours with a common prefix of LENGTH bytes are repeats. All
repeats are found, since any two equal strings share an anchor.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .shared import stored
from .spans import blocks, mixed, powers

LENGTH = 50
GRAM = 20
#: Bytes of texts around anchors that one suffix array is built over, few enough for a core's cache; no anchor is parted.
ARRAY_BYTES = 1 << 18
#: An anchor of more kinds of texts is not compared in one task: windows that hold it are grouped by their hashes instead.
HOT_KINDS = (1 << 21) // (2 * LENGTH - GRAM)
#: Kinds of texts around one anchor among TEXT_BYTES of texts from which they are dealt out by the texts, not by the anchor.
HOT_HERE = 32
#: Bytes of text whose anchors meet in one bucket, on average; the number of buckets grows with the corpus.
BUCKET_BYTES = 4 << 20
#: Bytes of texts whose anchors are packed together, or of texts around anchors that are cut out at once.
TEXT_BYTES = 8 << 20
LAST = (1 << 63) - 1


def suffix_array(values):
    """Starts of the suffixes of an array of whole numbers, sorted; by the difference cover modulo 3."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: values[i:].tolist()), np.int64)
    padded = np.concatenate([values - values.min() + 1, np.zeros(3, np.int64)])
    extra = n % 3 == 1  # one more suffix at the end, so that the halves of the sample don't run together
    ones, twos = (n + extra + 1) // 3, (n + extra) // 3
    zero, one, two, three = (np.ascontiguousarray(padded[k::3]) for k in range(4))  # characters by their place modulo 3
    if padded.max() < 1 << 21:  # a triple fits into one number
        triples = np.concatenate([(one[:ones] << 42) | (two[:ones] << 21) | three[:ones], (two[:twos] << 42) | (three[:twos] << 21) | one[1:twos + 1]])
        order = np.argsort(triples)
        triples = triples[order]
        new = triples[1:] != triples[:-1]
    else:
        triples = [np.concatenate(x) for x in ((one[:ones], two[:twos]), (two[:ones], three[:twos]), (three[:ones], one[1:twos + 1]))]
        order = np.lexsort(triples[::-1])
        triples = [x[order] for x in triples]
        new = np.logical_or.reduce([x[1:] != x[:-1] for x in triples])
    names = np.empty(len(order), np.int64)
    names[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    if not new.all():
        order = suffix_array(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rank_one, rank_two = (np.concatenate([x, np.zeros(2, np.int64)]) for x in (rank[:ones], rank[ones:]))
    if extra:
        order = order[order != ones - 1]
    is_one = order < ones
    own_one, own_two = order[is_one], order[~is_one] - ones
    # Two characters and a rank in one number, wherever they fit.
    rests, base, top = (n + 2) // 3, len(order) + 3, int(padded.max()) + 1
    rest = zero[:rests] * base + rank_one[:rests]
    by = np.argsort(rest)
    below = np.searchsorted(one[own_one] * base + rank_two[own_one], rest[by])
    pairs = [two[:twos] * top + three[:twos], zero[:rests] * top + one[:rests]]
    if top * top * base > LAST:  # they don't fit: the pairs are named first
        pairs = np.split(np.unique(np.concatenate(pairs), return_inverse=True)[1], [twos])
    below += np.searchsorted((pairs[0] * base + rank_one[1:twos + 1])[own_two], (pairs[1] * base + rank_two[:rests])[by])
    out = np.empty(n, np.int64)
    at = np.arange(rests) + below
    out[at] = 3 * by
    free = np.ones(n, bool)
    free[at] = False
    out[free] = np.where(is_one, 3 * order + 1, 3 * (order - ones) + 2)
    return out


def anchors(data, offsets, length=LENGTH, gram=GRAM):
    """(position, row, hash, hash of the bytes around) of the least k-gram of every window of ``length`` bytes, once each.

    Windows never cross texts; the bytes around are those that windows with the anchor reach.
    """
    windows = len(data) - length + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64, out=prefix[1:])
    grams = len(data) - gram + 1
    hashes = mixed((prefix[gram:] - prefix[:-gram]) * inverse[:grams])
    # 34 bits of the hash, then the position: of equal hashes the first counts.
    least = (hashes >> np.uint64(30) << np.uint64(30)) | np.arange(grams, dtype=np.uint64)
    reach, want = 1, length - gram + 1
    while reach < want:
        step = min(reach, want - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    whole = np.ones(windows, bool)
    for edge in offsets[1:-1]:
        whole[max(0, edge - length + 1):min(edge, windows)] = False
    chosen = (least[:windows][whole] & np.uint64((1 << 30) - 1)).astype(np.int64)
    chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen
    row = np.searchsorted(offsets, chosen, "right") - 1
    low, high = np.maximum(offsets[row], chosen - (length - gram)), np.minimum(offsets[row + 1], chosen + length)
    shape = ((chosen - low) * (2 * length) + high - low).astype(np.uint64)
    around = mixed(mixed((prefix[high] - prefix[low]) * inverse[low]) + shape)
    # Anchors are least hashes, so their first bits are mostly 0: mixed once more, they fill all buckets alike.
    return chosen, row, mixed(hashes[chosen] + np.uint64(1)) >> np.uint64(64 - HASH_BITS), around


#: Bits of a place in a text, beside HASH_BITS of an anchor's hash: texts of up to a quarter of a gigabyte.
PLACE_BITS, HASH_BITS = 28, 35


#: Texts and arrays travel compressed, texts a little more tightly; their sizes are told beside them.
CODEC, TEXT_LEVEL = "zstd", 3


def _unpacked(raw, size):
    return pa.decompress(raw, int(size), CODEC, asbytes=True)


def _planes(values):
    """Bytes of an array of numbers, all first bytes, then all second bytes and so on: they pack better so."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), CODEC, asbytes=True)


def _unplaned(raw, kind, count):
    width = np.dtype(kind).itemsize
    raw = _unpacked(raw, width * count)
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).tobytes(), kind)


def _packed_anchors(hashes, around, places, keys, ords):
    """Columns of one bucket's anchors, sorted by hash, as the fields of a row."""
    order = np.argsort(hashes)
    who, first, own = np.unique(keys[order], return_index=True, return_inverse=True)
    steps = np.diff(hashes[order], prepend=hashes.dtype.type(0))
    told = [_planes(x) for x in (steps, places[order].astype(np.int32), own.astype(np.int32), who, ords[order][first])]
    return [around[order].tobytes(), *told]


def _unpacked_anchors(row):
    around, *row = row
    around = np.frombuffer(around, np.uint64).copy()
    steps, places, own = (_unplaned(x, k, len(around)) for x, k in zip(row, (np.uint64, np.int32, np.int32)))
    who, ords = (_unplaned(x, np.int64, int(own.max()) + 1) for x in row[3:])
    return np.cumsum(steps, dtype=np.uint64), around, places, who[own], ords[own]


COLUMNS = ["around", "steps", "places", "own", "who", "ords"]


def _anchored(known, bits, here=HOT_HERE):
    """Anchors of all texts in 2 ** ``bits`` buckets by hash: a row for every bucket of a batch, its columns packed.

    What a batch can tell alone is told at once: anchors of texts that a smaller
    doc_id of the batch has as well go to negative buckets, as places to remove.
    An anchor with ``here`` kinds or more in a batch is dealt to buckets from
    2 ** ``bits`` on, by the bytes around it; a row with the place -1 tells so in
    its own bucket, so that its kinds from other batches stay open.
    """
    def found(batches):
        for batch in batches:
            for part in _slices(batch, batch.column(2).to_numpy()):
                yield from told(part)

    def told(batch):
        key, order, sizes = (batch.column(k).to_numpy() for k in range(3))
        texts = pa.array([_unpacked(x.as_buffer(), n) for x, n in zip(batch.column(3), sizes, strict=True)], pa.large_binary()).cast(pa.large_string())
        parts = []
        for first, data, offsets in blocks(texts):
            if np.diff(offsets).max(initial=0) >> PLACE_BITS:
                raise ValueError("a text is longer than a place can tell")
            at, row, hashes, around = anchors(data, offsets)
            parts.append((hashes, around, at - offsets[row], key[first + row], order[first + row]))
        if not parts:
            return
        hashes, around, places, keys, ords = columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        by = np.lexsort((ords, around, hashes))
        kind = np.concatenate([[True], (hashes[by][1:] != hashes[by][:-1]) | (around[by][1:] != around[by][:-1])]) if len(by) else np.zeros(0, bool)
        later = ords[by] > ords[by][np.flatnonzero(kind)][np.cumsum(kind) - 1]
        gone, (hashes, around, places, keys, ords) = by[later], [c[by[~later]] for c in columns]
        values, own, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        hot = counts >= here
        bucket = np.where(hot[own], np.uint64(1 << bits) + (around >> np.uint64(64 - bits)), hashes >> np.uint64(HASH_BITS - bits)).astype(np.int64)
        marks, n = values[hot], int(hot.sum())
        own_bucket = int(mixed(key[:1].astype(np.uint64))[0] & np.uint64((1 << bits) - 1))  # another one for each batch
        removed = [np.zeros(len(gone), np.uint64)] * 2 + [c[gone] for c in columns[2:]]
        columns = [np.concatenate(x) for x in zip(
            (hashes, around, places, keys, ords),
            (marks, np.zeros(n, np.uint64), np.full(n, -1), np.full(n, -1), np.full(n, LAST)), removed, strict=True)]
        bucket = np.concatenate([bucket, (marks >> np.uint64(HASH_BITS - bits)).astype(np.int64), np.full(len(gone), -1 - own_bucket)])
        by = np.argsort(bucket, kind="stable")
        numbers, cuts = np.unique(bucket[by], return_index=True)
        rows = [_packed_anchors(*(c[own] for c in columns)) for own in np.split(by, cuts[1:])] if len(by) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers.astype(np.int64)), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(len(COLUMNS)))], ["bucket", *COLUMNS])

    fields = ", ".join(f"{c} binary" for c in COLUMNS)
    return known.select("key", "ord", "size", "packed").mapInArrow(found, f"bucket long, {fields}")


def _removed(hashes, around, places, keys, ords):
    """Rows as of ``_decided``: all the places are to be removed."""
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places.astype(np.int32)), pa.nulls(len(keys), pa.int64())], ["key", "done", "open"])


def _decided(hashes, around, places, keys, ords, hot=False):
    """(key, done, open) of the anchors of a bucket that are in two or more documents.

    done is the place of an anchor with the same bytes around it as a document of
    a smaller doc_id has: all of them are removed. open is hash and place of one
    that stands for its kind, where other kinds of texts hold the anchor too;
    of ``hot`` anchors other kinds are always elsewhere.
    """
    order = np.lexsort((ords, around, hashes))
    hashes, around, places, keys, ords = (x[order] for x in (hashes, around, places, keys, ords))
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    kind = new | np.concatenate([[True], around[1:] != around[:-1]])
    cuts, group = np.flatnonzero(new), np.cumsum(new) - 1
    shared = (np.minimum.reduceat(keys, cuts) != np.maximum.reduceat(keys, cuts))[group]
    several = (np.add.reduceat(kind.astype(np.int64), cuts) > 1)[group]
    later = ords > ords[np.flatnonzero(kind)][np.cumsum(kind) - 1]
    real = places >= 0
    done, undecided = later & real & (shared | hot), real & ~later & (hot | shared & several)
    numbers = (hashes.astype(np.int64) << PLACE_BITS) | places
    told = np.concatenate([keys[done], keys[undecided]])
    nones, nulls = np.zeros(undecided.sum(), np.int32), np.arange(len(told)) >= done.sum()
    return pa.RecordBatch.from_arrays([
        pa.array(told), pa.array(np.concatenate([places[done], nones]).astype(np.int32), mask=nulls),
        pa.array(np.concatenate([np.zeros(done.sum(), np.int64), numbers[undecided]]), mask=~nulls)], ["key", "done", "open"])


def _shared(anchored, bits):
    """(key, done, open) as ``_decided`` tells; each task takes one bucket after the other."""
    def told(batches):
        held, bucket = [], None

        def decided():
            return _decided(*(np.concatenate(x) for x in zip(*held, strict=True)), hot=bucket >> bits > 0)

        for batch in batches:
            for number, *row in zip(*batch.columns, strict=True):
                row = _unpacked_anchors([x.as_buffer() for x in row])
                if number.as_py() < 0:
                    yield _removed(*row)
                    continue
                if held and number.as_py() != bucket:
                    yield decided()
                    held = []
                bucket = number.as_py()
                held.append(row)
        if held:
            yield decided()

    # A number of partitions that is asked for is not made smaller, so that no task gets a great many bytes at once.
    partitions = int(anchored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return anchored.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(told, "key long, done int, open long")


def _ranges(starts, sizes):
    """Places of ``sizes`` consecutive places from each start, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _binaries(data, sizes):
    """Binary column of consecutive parts of an array of bytes."""
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _lists(column):
    """(values, sizes) of a column of lists of numbers; a null is an empty list."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batch, sizes):
    """Slices of whole rows, of about TEXT_BYTES by their ``sizes``."""
    total = np.cumsum(sizes)
    edges = [*np.searchsorted(total, np.arange(TEXT_BYTES, total[-1] if len(total) else 0, TEXT_BYTES), "left"), len(total)]
    for low, high in zip([0, *edges[:-1]], edges, strict=True):
        if high > low:
            yield batch.slice(low, high - low)


def _around(rows, hot, wanted, length=LENGTH, gram=GRAM):
    """(hash, ord, key, at, left, around): the bytes around every open anchor that strings with it can reach; ``wanted``: of those in ``hot``, else of others."""
    chosen = np.array(sorted(hot), np.int64)

    def cut(batches):
        for batch in batches:
            for part in _slices(batch, batch.column(2).to_numpy()):
                yield from one(part)

    def one(batch):
        numbers, counts = _lists(batch.column(4))
        row = np.repeat(np.arange(batch.num_rows), counts)
        own = np.isin(numbers >> PLACE_BITS, chosen) == wanted
        numbers, row = numbers[own], row[own]
        needed = np.zeros(batch.num_rows, bool)
        needed[row] = True
        sizes = np.where(needed, batch.column(2).to_numpy(), 0)
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join([_unpacked(x.as_buffer(), n) for x, n in zip(batch.column(3), sizes, strict=True) if n]), np.uint8)
        keys, ords = (batch.column(k).to_numpy() for k in range(2))
        step = TEXT_BYTES // (2 * length - gram)
        for k in range(0, len(numbers), step):
            number, who = numbers[k:k + step], row[k:k + step]
            at = number & ((1 << PLACE_BITS) - 1)
            low, high = np.maximum(0, at - (length - gram)), np.minimum(at + length, sizes[who])
            around = _binaries(data[_ranges(begins[who] + low, high - low)], high - low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number >> PLACE_BITS), pa.array(ords[who]), pa.array(keys[who]), pa.array(at.astype(np.int32)),
                 pa.array((at - low).astype(np.int32)), around], ["hash", "ord", "key", "at", "left", "around"])

    return rows.select("key", "ord", "size", "packed", "open").mapInArrow(cut, "hash long, ord long, key long, at int, left int, around binary")


def _repeats(hashes, ords, left, texts, length=LENGTH):
    """(row, first, last): places of the first and the last removed string of the texts around some anchors that have one.

    Rows come as whole groups of one hash. All strings of a row hold its anchor,
    so those from the first to the last leave no byte between them.
    """
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets, data = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1], np.frombuffer(data, np.uint8)
    sizes = np.diff(offsets)
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    cuts, group = np.flatnonzero(new), np.cumsum(new) - 1
    # What has room for a string, in groups where a document has a smaller doc_id than another one.
    own = np.flatnonzero((sizes >= length) & (np.minimum.reduceat(ords, cuts) != np.maximum.reduceat(ords, cuts))[group])
    if not len(own):
        return own, own, own
    ords, left, sizes = ords[own], left[own].astype(np.int64), sizes[own]
    data = data[_ranges(offsets[own], sizes)]
    begins = np.cumsum(sizes) - sizes
    # Every text ends with a number of its own, so that no common prefix goes beyond it.
    row = np.repeat(np.arange(len(own)), sizes + 1)
    values = np.empty(len(row), np.int64)
    ends = begins + sizes + np.arange(len(own))
    values[ends] = np.arange(len(own))
    inside = np.ones(len(row), bool)
    inside[ends] = False
    values[inside] = data.astype(np.int64) + len(own)
    # Strings that hold the anchor and fit into the text.
    counts = np.minimum(left, sizes - length) + 1
    fits = np.zeros(len(row), bool)
    fits[_ranges(begins + np.arange(len(own)), counts)] = True
    order = suffix_array(values)
    order = order[fits[order]]
    row = row[order]
    start = order - row
    # Neighbours are compared eight bytes at once.
    eights = np.ascontiguousarray(np.ndarray(len(data) - 7, np.uint64, data, strides=(1,)))
    same = np.ones(len(start) - 1, bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        eight = eights[start + k]
        same &= eight[1:] == eight[:-1]
    run = np.concatenate([[0], np.cumsum(~same)])
    ords = ords[row]
    least = np.minimum.reduceat(ords, np.flatnonzero(np.concatenate([[True], ~same])))
    gone = ords > least[run]
    row, start = row[gone], start[gone]
    first, last = np.full(len(own), LAST), np.full(len(own), -1)
    np.minimum.at(first, row, start)
    np.maximum.at(last, row, start)
    hit = last >= 0
    return own[hit], (first - begins)[hit], (last - begins)[hit]


#: Bits of the end of a span, beside its start in one number.
END_BITS = 32


def _marks(contexts, length=LENGTH):
    """(key, span) of the removed strings around the anchors, one span for each anchor of a document."""
    def compared(batches):
        held, size = [], 0

        def marked(batch):
            hashes, ords, keys, at, left = (batch.column(k).to_numpy() for k in range(5))
            row, first, last = _repeats(hashes, ords, left, batch.column(5), length)
            low = (at - left)[row].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array((low + first << END_BITS) | (low + last + length))], ["key", "span"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < ARRAY_BYTES:
                continue
            whole = pa.concat_batches(held)
            hashes = whole.column(0).to_numpy()
            # Whole groups of about ARRAY_BYTES; the last one may go on in the next batch.
            cuts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            total = np.cumsum(pc.binary_length(whole.column(5)).to_numpy().astype(np.int64))
            own = (total[cuts] - total[0]) // ARRAY_BYTES
            edges = [*cuts[np.concatenate([[True], own[1:] != own[:-1]])], cuts[-1]]
            for low, high in zip(edges, edges[1:]):
                if high > low:
                    yield marked(whole.slice(low, high - low))
            held = [whole.slice(cuts[-1])]
            size = held[0].nbytes
        if held and sum(map(len, held)):
            yield marked(pa.concat_batches(held))

    return contexts.repartition("hash").sortWithinPartitions("hash").mapInArrow(compared, "key long, span long")


def _hot_marks(contexts, length=LENGTH):
    """(key, span) as of ``_marks``, of anchors with very many kinds: windows with an anchor are equal if their hashes are.

    The least doc_id of a window is found in every task before the shuffle.
    """
    def cut(batches):
        for batch in batches:
            texts = batch.column(5).to_pylist()
            at, left, sizes = batch.column(3).to_numpy(), batch.column(4).to_numpy(), np.array([len(t) for t in texts], np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            power, inverse = powers(len(data) + 1)
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
            counts = np.minimum(left, sizes - length) + 1
            own = np.repeat(np.arange(len(texts)), counts)
            start = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            place = (np.cumsum(sizes) - sizes)[own] + start
            window = mixed((prefix[place + length] - prefix[place]) * inverse[place]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own)), pa.array(window), *(batch.column(k).take(pa.array(own)) for k in (1, 2)),
                 pa.array((at - left)[own] + start, pa.int32())], ["hash", "window", "ord", "key", "s"])

    windows = contexts.select("hash", "ord", "key", "at", "left", "around").mapInArrow(cut, "hash long, window long, ord long, key long, s int")
    least = windows.groupBy("hash", "window").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").drop("most")
    found = windows.join(least.hint("shuffle_hash"), ["hash", "window"]).where("ord > least")
    start = F.col("s").cast("long")
    return found.select("key", F.shiftleft(start, END_BITS).bitwiseOR(start + length).alias("span"))


def _told(texts, sizes, spans, done, length=LENGTH, gram=GRAM):
    """(removed bytes, maximal removed runs, digest of the rest) of some texts, as columns; all bytes around the anchors at ``done`` are removed.

    ``spans`` and ``done``: the row and the value of each.
    """
    # One more byte after every text, so that no run goes beyond it.
    begins = np.cumsum(sizes + 1) - sizes - 1
    (row, span), (other, at) = spans, done
    starts = np.concatenate([begins[row] + (span >> END_BITS), begins[other] + np.maximum(0, at - (length - gram))])
    ends = np.concatenate([begins[row] + (span & ((1 << END_BITS) - 1)), begins[other] + np.minimum(at + length, sizes[other])])
    by = np.argsort(starts)
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(by) else np.zeros(0, bool)
    starts, ends = starts[new], ends[np.concatenate([new[1:], [True]])] if len(by) else ends
    row = np.searchsorted(begins, starts, "right") - 1
    runs = np.bincount(row, minlength=len(sizes))
    removed = np.bincount(row, ends - starts, minlength=len(sizes)).astype(np.int64)
    starts, ends, edges = (starts - begins[row]).tolist(), (ends - begins[row]).tolist(), np.cumsum(runs).tolist()
    digests, k = [], 0
    for raw, edge in zip(texts, edges, strict=True):
        digest, at, raw = hashlib.sha256(), 0, memoryview(raw)
        for k in range(k, edge):
            digest.update(raw[at:starts[k]])
            at = ends[k]
        k = edge
        digest.update(raw[at:])
        digests.append(digest.hexdigest())
    return pa.array(removed), pa.array(runs.astype(np.int64)), pa.array(digests, pa.string())


def without_repeats(docs, hot_kinds=HOT_KINDS, hot_here=HOT_HERE):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    A null text is empty. Documents of a null id come after all others; rows of
    one doc_id take nothing from each other; repeated rows have equal answers.
    Texts of more than 2 ** PLACE_BITS bytes are an error.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
        F.monotonically_increasing_id().alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def packed(batches):
        codec = pa.Codec(CODEC, compression_level=TEXT_LEVEL)
        for batch in batches:
            texts = [t.encode() for t in batch.column(3).to_pylist()]
            sent = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(t) for t in texts], pa.int64()), sent], ["doc_id", "ord", "key", "size", "packed"])

    # Keys are given once and kept; texts travel and wait compressed.
    known = stored(rows.mapInArrow(packed, "doc_id long, ord long, key long, size long, packed binary"), "repeat-documents")
    size = known.agg(F.sum("size").alias("size")).first()["size"] or 0
    bits = min(HASH_BITS - 1, max(1, (size // BUCKET_BYTES).bit_length()))
    found = stored(_shared(_anchored(known, bits, hot_here), bits).groupBy("key").agg(
        F.collect_list("done").alias("done"), F.collect_list("open").alias("open")), "repeat-anchors")
    undecided = found.where(F.size("open") > 0).select("key", "open")
    kinds = undecided.select(F.explode("open").alias("number")).groupBy(F.shiftright("number", PLACE_BITS).alias("hash")).count()
    # At most one of hot_kinds open anchors.
    hot = frozenset(r["hash"] for r in kinds.where(F.col("count") > hot_kinds).collect())
    rows = known.join(undecided.hint("shuffle_hash"), "key")
    marks = _marks(_around(rows, hot, False))
    if hot:
        marks = marks.unionAll(_hot_marks(stored(_around(rows, hot, True), "repeat-hot")))
    marks = marks.groupBy("key").agg(F.collect_set("span").alias("spans"))

    def told(batches):
        for batch in batches:
            for part in _slices(batch, batch.column(1).to_numpy()):
                sizes = part.column(1).to_numpy()
                texts = [_unpacked(x.as_buffer(), n) for x, n in zip(part.column(2), sizes, strict=True)]
                rows = np.arange(len(texts))
                own = [(np.repeat(rows, counts), values) for values, counts in (_lists(part.column(3)), _lists(part.column(4)))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], *_told(texts, sizes, *own)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    marked = known.join(found.select("key", "done").hint("shuffle_hash"), "key", "left").join(marks.hint("shuffle_hash"), "key", "left")
    return marked.select("doc_id", "size", "packed", "spans", "done").mapInArrow(told, fields)
