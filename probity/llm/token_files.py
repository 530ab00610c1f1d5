"""Token ids in files of independent blocks, coded by interleaved range asymmetric numeral systems.

A frequency table over the ids of all documents is shared by all blocks. A
block holds whole documents in ascending doc_id order; its ids are dealt over
lanes (id i goes to lane i mod lanes), every lane is a coder of its own, and all
lanes write to one stream. Checkpoints keep the lanes' states and the place in
the stream, so a reader can start in the middle; checksums cover the whole block
and its ids. Blocks can be read by as many tasks as there are blocks.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .pretokens import token_ids
from .shared import PIECES, new_path, pieces, summed

MAGIC = b"IANS"
SCALE = 20  # frequencies add up to 2 ** SCALE
LOWEST = np.uint64(1 << 31)  # a state is at least this between two ids
LANES = 1024
BLOCK_IDS = 1 << 20
CHECKPOINT_STEPS = 512
HEADER = struct.Struct("<4sHHIIIIII")  # magic, lanes, 0, documents, ids, words, steps a checkpoint, crc of ids, crc of the table

END_ID = 0


def frequency_table(counts):
    """Scale counts to frequencies that add up to 2 ** SCALE; an id that occurs keeps at least 1."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        counts, total = np.eye(1, max(1, len(counts)), dtype=np.int64)[0], 1
    if (counts > 0).sum() > 1 << SCALE:
        raise ValueError("more different ids than the frequency table has room for")
    share = counts * ((1 << SCALE) / total)
    scaled = np.where(counts > 0, np.maximum(1, share.astype(np.int64)), 0)
    order = np.argsort(-scaled, kind="stable")
    rest = (1 << SCALE) - int(scaled.sum())
    if rest > 0:
        scaled[order[0]] += rest
    for k in order:
        if rest >= 0:
            break
        less = min(-rest, int(scaled[k]) - 1)
        scaled[k] -= less
        rest += less
    if scaled.max() == 1 << SCALE:  # a frequency fits in SCALE bits: another id, which never occurs, takes one slot
        only = int(scaled.argmax())
        scaled[only] -= 1
        scaled = np.append(scaled, 0) if len(scaled) == 1 else scaled
        scaled[only - 1 if only else 1] += 1
    return scaled.astype(np.uint64)


def encode_block(ids, sizes, freq, lanes=LANES, every=CHECKPOINT_STEPS):
    """The bytes of one block: ``ids`` of documents of ``sizes`` ids each."""
    ids = np.asarray(ids, np.int64)
    begin = np.cumsum(freq) - freq
    both = (freq << np.uint64(32)) | begin
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOWEST, np.uint64)
    words, marks, written = [], [], 0
    down, low, up, unit = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(63 - SCALE), np.uint64(1 << SCALE)
    for step in range(steps - 1, -1, -1):
        own = ids[step * lanes:(step + 1) * lanes]
        x, own = state[:len(own)], both[own]
        f = own >> down
        full = np.flatnonzero(x >= f << up)
        over = x[full]
        words.append(over.astype("<u4"))
        written += len(full)
        x[full] = over >> down
        q = x // f
        x += q * (unit - f) + (own & low)
        if step and step % every == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks = [(written - at, kept) for at, kept in marks[::-1]]
    head = HEADER.pack(MAGIC, lanes, 0, len(sizes), len(ids), written, every, zlib.crc32(ids.astype("<u4").tobytes()),
                       zlib.crc32(freq.astype("<u4").tobytes()))
    body = b"".join([
        head, np.asarray(sizes, "<u4").tobytes(), state.astype("<u8").tobytes(), struct.pack("<I", len(marks)),
        *(struct.pack("<I", at) + kept.astype("<u8").tobytes() for at, kept in marks), stream.tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block, freq, symbols=None, first_step=0):
    """(ids, sizes) of a block; checks its checksums. ``first_step``: start at this checkpoint's step and give the ids from there."""
    body, (crc,) = block[:-4], struct.unpack("<I", block[-4:])
    magic, lanes, _, documents, total, n_words, every, ids_crc, table_crc = HEADER.unpack_from(body)
    if magic != MAGIC or crc != zlib.crc32(body):
        raise ValueError("a block of token ids is damaged")
    if table_crc != zlib.crc32(freq.astype("<u4").tobytes()):
        raise ValueError("a block of token ids belongs to another frequency table")
    symbols = symbol_table(freq) if symbols is None else symbols
    at = HEADER.size
    sizes = np.frombuffer(body, "<u4", documents, at).astype(np.int64)
    at += 4 * documents
    state = np.frombuffer(body, "<u8", lanes, at).astype(np.uint64)
    at += 8 * lanes
    (n_marks,) = struct.unpack_from("<I", body, at)
    at += 4
    stream = np.frombuffer(body, "<u4", n_words, at + n_marks * (4 + 8 * lanes)).astype(np.uint64)
    place = 0
    if first_step:
        if first_step % every or first_step // every > n_marks:
            raise ValueError(f"no checkpoint at step {first_step}")
        at += (first_step // every - 1) * (4 + 8 * lanes)
        (place,) = struct.unpack_from("<I", body, at)
        state = np.frombuffer(body, "<u8", lanes, at + 4).astype(np.uint64)
    state = state.copy()
    ids = np.empty(total - first_step * lanes, np.int64)
    mask, scale, top, down = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(2 * SCALE), np.uint64(32)
    for first in range(0, len(ids), lanes):
        n = min(lanes, len(ids) - first)
        x = state[:n]
        own = symbols[(x & mask).astype(np.int64)]
        x >>= scale
        x *= (own >> scale) & mask
        x += own & mask
        short = np.flatnonzero(x < LOWEST)
        x[short] = (x[short] << down) | stream[place:place + len(short)]
        place += len(short)
        ids[first:first + n] = own >> top
    if not first_step and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids of a block don't match their checksum")
    return ids, sizes


def symbol_table(freq):
    """For every slot of the shared table its id, the id's frequency and the slot's place among the id's slots, in 24, 20 and 20 bits."""
    ids = np.repeat(np.arange(len(freq), dtype=np.uint64), freq.astype(np.int64))
    place = np.arange(1 << SCALE, dtype=np.uint64) - (np.cumsum(freq) - freq)[ids.astype(np.int64)]
    return (ids << np.uint64(2 * SCALE)) | (freq[ids.astype(np.int64)] << np.uint64(SCALE)) | place


def tokenize(docs, tokenizer, end_id=END_ID):
    """(doc_id, n_tokens, ids) of every row: little-endian ids of 2 bytes if all are small enough, else of 4; a null text counts as empty."""
    def encoded(batches):
        for batch in batches:
            ids, counts = token_ids(batch.column(1), tokenizer)
            ends = np.cumsum(counts)
            whole = np.full(len(ids) + len(counts), end_id, np.int64)
            where = np.ones(len(whole), bool)
            where[ends + np.arange(len(counts))] = False
            whole[where] = ids
            cuts = np.concatenate([[0], ends + np.arange(1, len(counts) + 1)])
            kept = whole.astype("<u4")
            sent = [kept[a:b].astype("<u2").tobytes() if b - a and kept[a:b].max() < 65536 else kept[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts + 1, pa.int64()), pa.array(sent, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, "doc_id long, n_tokens long, ids binary")


def _unpacked(sent, n):
    return np.frombuffer(sent, "<u2" if len(sent) == 2 * n else "<u4").astype(np.int64)


def write(docs, tokenizer, path, vocabulary, parts=None, end_id=END_ID, block_ids=BLOCK_IDS):
    """Tokenise ``docs`` (doc_id, text) and write the files under ``path``; returns the path.

    ``tokens``: the ids as they come. ``blocks``: the coded blocks in ascending
    doc_id order (null first, equal ids by their tokens), one file per range of
    doc_id. ``table``: the frequencies of all ids, one row. A document is never
    split; one of more than ``block_ids`` ids is a block of its own. An empty
    table gives no blocks.
    """
    spark = docs.sparkSession
    tokenize(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")

    def counted(batches):
        total, held, n_held = np.zeros(vocabulary, np.int64), [], 0
        for batch in batches:
            for n, sent in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(_unpacked(sent.as_buffer(), n))
                n_held += n
                if n_held > block_ids:
                    total += np.bincount(np.concatenate(held), minlength=vocabulary)
                    held, n_held = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=vocabulary)
        yield pieces(total)

    freq = frequency_table(summed(tokens.select("n_tokens", "ids").mapInArrow(counted, PIECES), vocabulary))
    spark.createDataFrame([(SCALE, freq.astype("<u4").tobytes())], "scale int, frequencies binary").write.parquet(f"{path}/table")
    sent_freq = spark.sparkContext.broadcast(freq)

    def coded(batches):
        from pyspark import TaskContext

        freq, part, block, before = sent_freq.value, TaskContext.get().partitionId(), 0, 0
        held, ids, n_ids = [], [], 0

        def closed():
            sizes = [n for _, n in held]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([n_ids], pa.int64()),
                pa.array([[i for i, _ in held]], pa.list_(pa.int64())),
                pa.array([encode_block(np.concatenate(ids), sizes, freq)], pa.binary())],
                ["part", "block", "ids_before", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for doc, n, sent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and n_ids + n > block_ids:
                    yield closed()
                    block, before, held, ids, n_ids = block + 1, before + n_ids, [], [], 0
                held.append((doc, n))
                ids.append(_unpacked(sent.as_buffer(), n))
                n_ids += n
        if held:
            yield closed()

    tie = F.xxhash64("ids")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (tokens.withColumn("tie", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .select("doc_id", "n_tokens", "ids")
     .mapInArrow(coded, "part int, block int, ids_before long, n_ids long, doc_ids array<long>, payload binary")
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))
    return path


def read(spark, path, fields, of):
    """What ``of(ids, doc_ids, sizes, start)`` gives for each block (a dict of columns as in ``fields``), read from the files."""
    table = spark.read.parquet(f"{path}/table").head()
    sent = spark.sparkContext.broadcast(np.frombuffer(table["frequencies"], "<u4").astype(np.uint64))
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per file: far fewer rows than blocks, added up in order of the files.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("part").agg(F.sum("n_ids").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("part_start"))

    def decoded(batches):
        freq, symbols = sent.value, None
        for batch in batches:
            for k in range(batch.num_rows):
                symbols = symbol_table(freq) if symbols is None else symbols
                ids, sizes = decode_block(batch.column(2)[k].as_py(), freq, symbols)
                columns = of(ids, batch.column(1)[k].as_py(), sizes, batch.column(0)[k].as_py())
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.join(starts, "part").select(
        (F.col("part_start") + F.col("ids_before")).alias("start"), "doc_ids", "payload").mapInArrow(decoded, fields)


def digests(spark, path):
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files under ``path``."""
    def of(ids, doc_ids, sizes, start):
        ends = np.cumsum(sizes)
        raw = memoryview(ids.astype("<u4").tobytes())
        return {
            "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64()),
        }

    return read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", of)


def written_digests(docs, tokenizer, vocabulary):
    """Write ``docs`` to a new folder in the shared place and give the digests of what the files hold."""
    path = write(docs, tokenizer, new_path(docs.sparkSession, "token-ids"), vocabulary)
    return digests(docs.sparkSession, path)
