"""Benchmark decontamination with a distributed positional inverted index.

The index has one row per block of documents: every different word of the block
with its positions. Windows of the benchmark start from the postings of their
rarest word (rarest over the whole corpus) and are intersected with the other
words' postings, shifted by their offsets, in order of rarity. Blocks are
searched where they are; postings never move.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .shared import new_path
from .spans import blocks, runs, words

WINDOW = 10
#: A word is known by the upper bits of its hash; positions in a block take the lower ones.
POSITION_BITS = 22
BLOCK_BYTES = 1 << 22
#: Bytes of benchmark text in one search; a larger benchmark is searched in several passes.
PASS_BYTES = 32 << 20
#: Candidate places looked at together.
CANDIDATES = 1 << 20

POSTINGS = "block long, doc_ids array<long>, first array<long>, terms binary, counts binary, positions binary"
FOUND = "block long, row int, doc_id long, n_words long, spans array<struct<s:int,e:int>>, items array<string>, near array<string>"


def _postings(data, offsets):
    hashes, row = words(data, offsets)
    first = np.searchsorted(row, np.arange(len(offsets)))
    if len(hashes) >> POSITION_BITS:  # one very long text
        positions = np.argsort(hashes >> np.uint64(POSITION_BITS), kind="stable")
        terms = hashes[positions] >> np.uint64(POSITION_BITS)
    else:
        keys = (hashes >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        keys.sort()
        positions, terms = (keys & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64), keys >> np.uint64(POSITION_BITS)
    cuts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    counts = np.diff(np.append(cuts, len(terms)))
    steps = np.diff(positions, prepend=0)
    steps[cuts] = positions[cuts]
    return first, terms[cuts], counts, steps


def build_index(docs, path):
    """Write the index of all words of all ``docs`` (doc_id, text) under ``path``; a null text has no words.

    Repeated rows are indexed as often as they occur; a null doc_id stays null.
    """
    def indexed(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1), BLOCK_BYTES):
                first, terms, counts, steps = _postings(data, offsets)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([batch.column(0).slice(row, len(offsets) - 1).to_pylist()], pa.list_(pa.int64())),
                    pa.array([first], pa.list_(pa.int64())), pa.array([terms.astype("<u8").tobytes()], pa.binary()),
                    pa.array([counts.astype("<u4").tobytes()], pa.binary()), pa.array([steps.astype("<i4").tobytes()], pa.binary())],
                    ["block", "doc_ids", "first", "terms", "counts", "positions"])
                block += 1

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(indexed, POSTINGS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def windows_of(items, length=WINDOW):
    """The different windows of (item_id, text) rows, as arrays over a sorted vocabulary.

    An item of fewer words than ``length`` (but not none) is one window. Null
    ids count as empty ids; items of one id are one item.
    """
    owners, rows = [], {}
    for item, text in items:
        raw = (text or "").encode()
        hashes = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] >> np.uint64(POSITION_BITS)
        for start in range(max(1, len(hashes) - length + 1) if len(hashes) else 0):
            rows.setdefault(tuple(hashes[start:start + length].tolist()), set()).add(item or "")
    names = sorted({name for own in rows.values() for name in own})
    place = {name: k for k, name in enumerate(names)}
    vocabulary = np.array(sorted({t for window in rows for t in window}), np.uint64)
    terms = np.full((len(rows), length), -1, np.int64)
    for k, window in enumerate(rows):
        terms[k, :len(window)] = np.searchsorted(vocabulary, np.array(window, np.uint64))
        owners.append(np.array(sorted(place[name] for name in rows[window])))
    return {"vocabulary": vocabulary, "terms": terms, "names": names, "owner": np.concatenate([np.zeros(0, np.int64), *owners]),
            "owner_at": np.cumsum([0, *map(len, owners)])}


def _known(row, vocabulary):
    """Vocabulary number of every term of an index row that is in the vocabulary, with the row's term and its count."""
    terms, counts = np.frombuffer(row["terms"].as_buffer(), "<u8"), np.frombuffer(row["counts"].as_buffer(), "<u4").astype(np.int64)
    if not len(terms) or not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    at = np.searchsorted(vocabulary, terms).clip(max=len(vocabulary) - 1)
    own = np.flatnonzero(vocabulary[at] == terms)
    return at[own], own, counts


def term_counts(index, vocabulary):
    """How often every word of a benchmark's vocabulary occurs in the whole corpus."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at, own, counts = _known({"terms": batch.column(0)[k], "counts": batch.column(1)[k]}, sent.value)
                total[at] += counts[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    # One row per word of the benchmark at most.
    for r in index.select("terms", "counts").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _occurrences(windows, order, keys, slop):
    """(window, start) of every place where all words of a window stand at their offsets, give or take ``slop``."""
    terms = windows["terms"]
    numbers = keys >> 32
    there = np.bincount(numbers, minlength=len(windows["vocabulary"]))
    begin = np.cumsum(there) - there
    possible = np.flatnonzero(((there[terms] > 0) | (terms < 0)).all(axis=1))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    sizes = there[terms[possible, order[possible, 0]]]
    while len(possible):
        n = max(1, int(np.searchsorted(np.cumsum(sizes), CANDIDATES)))
        own, own_sizes, possible, sizes = possible[:n], sizes[:n], possible[n:], sizes[n:]
        window = np.repeat(own, own_sizes)
        offset = order[window, 0]
        rank = np.arange(len(window)) - np.repeat(np.cumsum(own_sizes) - own_sizes, own_sizes)
        start = (keys[begin[terms[window, offset]] + rank] & 0xFFFFFFFF) - offset
        for k in range(1, terms.shape[1]):
            offset = order[window, k]
            term = terms[window, offset]
            wanted = (term << 32) | np.maximum(start + offset - slop, 0)
            at = np.searchsorted(keys, wanted)
            kept = (term < 0) | ((at < len(keys)) & (keys[at.clip(max=len(keys) - 1)] <= ((term << 32) | (start + offset + slop).clip(min=0))))
            window, start = window[kept], start[kept]
        found.append((window[start >= 0], start[start >= 0]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _items_by_row(windows, window, row, rows):
    """For every row the sorted names of the items whose windows occur in it."""
    out = [[] for _ in range(rows)]
    if not len(window):
        return out
    sizes = np.diff(windows["owner_at"])[window]
    rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    item = windows["owner"][np.repeat(windows["owner_at"][window], sizes) + rank]
    width = max(1, len(windows["names"]))
    for pair in np.unique(np.repeat(row, sizes) * width + item).tolist():
        out[pair // width].append(windows["names"][pair % width])
    return out


def search(index, windows, slop=None):
    """One row per document of the index: its words, the word spans inside occurrences, the items found.

    ``near``: with ``slop``, items with a window whose words all stand within
    that many places of their offsets (proximity matches; exact ones among them).
    """
    rarity = term_counts(index, windows["vocabulary"])
    terms = windows["terms"]
    order = np.argsort(np.where(terms < 0, np.iinfo(np.int64).max, rarity[terms] if len(rarity) else 0), axis=1, kind="stable")
    sent = index.sparkSession.sparkContext.broadcast((windows, order))

    def searched(batches):
        windows, order = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                first, doc_ids = np.array(row["first"].as_py(), np.int64), row["doc_ids"].as_py()
                at, own, counts = _known(row, windows["vocabulary"])
                steps = np.frombuffer(row["positions"].as_buffer(), "<i4").astype(np.int64)
                mine = np.zeros(len(counts), bool)
                mine[own] = True
                kept = np.repeat(mine, counts)
                sizes, steps = counts[own], steps[kept]
                sums = np.cumsum(steps)
                base = np.cumsum(sizes) - sizes
                positions = sums - np.repeat(sums[base] - steps[base], sizes) if len(steps) else steps
                keys = (np.repeat(at, sizes) << 32) | positions
                length = (windows["terms"] >= 0).sum(axis=1)
                rows = len(doc_ids)

                def located(slop, keys=keys, first=first, length=length):
                    window, start = _occurrences(windows, order, keys, slop)
                    row = np.searchsorted(first, start, "right") - 1
                    inside = start + length[window] <= first[np.minimum(row + 1, len(first) - 1)]
                    return window[inside], start[inside], row[inside]

                window, start, at_row = located(0)
                cover = np.zeros(int(first[-1]) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length[window], -1)
                begins, stops, span_row = runs(np.cumsum(cover[:-1]) > 0, first)
                spans = [[] for _ in range(rows)]
                for s, e, r in zip(begins.tolist(), stops.tolist(), span_row.tolist(), strict=True):
                    spans[r].append({"s": s - int(first[r]), "e": e - int(first[r])})
                near = [[]] * rows
                if slop is not None:
                    window_n, _, row_n = located(slop)
                    near = _items_by_row(windows, window_n, row_n, rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, row["block"].as_py())), pa.array(np.arange(rows), pa.int32()), pa.array(doc_ids, pa.int64()),
                    pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                    pa.array(_items_by_row(windows, window, at_row, rows), pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
                    ["block", "row", "doc_id", "n_words", "spans", "items", "near"])

    return index.mapInArrow(searched, FOUND)


def contamination(docs, benchmark, length=WINDOW, slop=None, pass_bytes=PASS_BYTES):
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids), near, spans.

    The benchmark (item_id, text) is searched in as many passes as keep the
    windows sent to the tasks under ``pass_bytes`` of text. Items without words
    match nothing; an empty benchmark gives no hits; empty ``docs`` no rows.
    """
    index = build_index(docs.select("doc_id", "text"), new_path(docs.sparkSession, "postings"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    found = None
    for k in range(passes):
        own = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        one = search(index, windows_of([tuple(r) for r in own.collect()], length), slop)
        found = one if found is None else found.unionAll(one)
    if passes > 1:
        found = found.groupBy("block", "row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")])
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["n"].cast("long"))
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"),
        F.array_sort(F.array_distinct("near")).alias("near"), "spans")


def digests(docs, benchmark):
    """The contract's columns for every document."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
