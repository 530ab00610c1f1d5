"""Byte-level BPE by rank files: encoding and decoding of whole texts.

Encoding looks in two tiers. A minimal perfect hash over the vocabulary answers
for all pre-tokens of a block at once, in numpy, and a comparison of the bytes
tells which of them are tokens as a whole. The others are merged pair by pair,
the pair of lowest rank first, leftmost of equals, with a heap over linked
bytes; results are remembered per worker as far as a bounded table goes.
"""

import base64
import os
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .pretokens import pretoken_starts
from .spans import TEXT, blocks, mixed, span_hashes

#: Most bytes of a rank file: the vocabulary goes to every worker.
MOST_BYTES = 64 << 20
#: Slots for each key that is still without a place, per level of the perfect hash.
SLOTS_PER_KEY = 2
#: Bytes of merged pre-tokens that a worker remembers, with their ids, before it starts anew.
POOL = 3 << 20
#: Bytes of text that are worked on at once.
BLOCK = 1 << 18
#: Bytes of a pre-token from which the links are kept in arrays.
LONG = 1 << 14
#: Bits of a heap entry that hold the place.
PLACE = 40


def index_of_ranges(starts, sizes):
    """The positions of ranges one after another."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


class PerfectHash:
    """Every key (a 64-bit hash) has its own number from 0 to n - 1; other keys get any number or -1.

    Each level has a bit for every slot that exactly one key falls on; keys that
    share a slot go to the next level. A key's number is the count of set bits before its own.
    """

    def __init__(self, keys):
        keys = np.asarray(keys, np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys have the same hash")
        bits, self.starts, left = [], [0], keys
        while len(left):
            slots = self._slots(left, len(bits), SLOTS_PER_KEY * len(left))
            taken = np.bincount(slots, minlength=SLOTS_PER_KEY * len(left))
            bits.append(taken == 1)
            self.starts.append(self.starts[-1] + len(taken))
            left = left[taken[slots] != 1]
        self.bits = np.concatenate([np.zeros(0, bool), *bits])
        self.before = (np.cumsum(self.bits) - self.bits).astype(np.int32)

    @staticmethod
    def _slots(keys, level, size):
        seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
        return (mixed(keys + seed) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys):
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (start, stop) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            at = start + self._slots(keys[todo], level, stop - start)
            hit = self.bits[at]
            found[todo[hit]] = self.before[at[hit]]
            todo = todo[~hit]
        return found


class Vocabulary:
    """The tokens of a rank file (base64 bytes and rank per line), their perfect hash, and what a worker remembers."""

    def __init__(self, tokens, pattern):
        ids = np.array(list(tokens.values()), np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() > 2**31 - 1 or len(np.unique(ids)) != len(ids)):
            raise ValueError("ranks must be different and fit an int")
        missing = [b for b in range(256) if bytes([b]) not in tokens]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.pattern = pattern
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes)
        keys = span_hashes(flat, ends - sizes, ends)
        self.hash = PerfectHash(keys)
        # Tokens in the order of their numbers; by_id leads from an id to that number.
        order = np.empty(len(keys), np.int64)
        order[self.hash(keys)] = np.arange(len(keys))
        self.ids, self.sizes = ids[order].astype(np.int32), sizes[order]
        self.flat = flat[index_of_ranges((ends - sizes)[order], self.sizes)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.by_id = np.full(int(ids.max()) + 1, -1, np.int32) if len(ids) else np.zeros(0, np.int32)
        self.by_id[self.ids] = np.arange(len(keys))
        self.longest = int(sizes.max())

    @classmethod
    def read(cls, path, pattern=None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}, pattern)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _start(self):
        """What only workers need, made there once."""
        raw = self.flat.tobytes()
        self._ranks = {raw[a:a + n]: i for a, n, i in zip(self.starts.tolist(), self.sizes.tolist(), self.ids.tolist(), strict=True)}
        self._tables = byte_tables(self._ranks)
        # White space as Unicode has it, which some libraries widen by four control characters.
        self._split = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._tiled = self.pattern == TILED
        self._forget()

    def _forget(self):
        self._known, self._bytes = {}, 0

    # --- encoding -----------------------------------------------------------------

    def encode(self, column):
        """(ids, counts): the ids of all texts of an Arrow column one after another, and how many each text has."""
        if not hasattr(self, "_ranks"):
            self._start()
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for _, data, offsets in blocks(column, BLOCK):
            one, sizes = self._encode_block(data, offsets)
            ids.append(one)
            counts.append(sizes)
        return np.concatenate(ids), np.concatenate(counts)

    def _spans(self, data, offsets):
        """(starts, ends) of the pre-tokens, whole texts one after another."""
        raw = data.tobytes()
        high = np.concatenate([[0], np.cumsum(data >= 0xC4)])
        by_pattern = (high[offsets[1:]] > high[offsets[:-1]]) | (not self._tiled)
        starts, ends = [], []
        row = 0
        while row < len(by_pattern):
            stop = row + 1
            if by_pattern[row]:
                text = raw[offsets[row]:offsets[stop]].decode()
                found = np.array([m.span() for m in self._split.finditer(text)], np.int64).reshape(-1, 2)
                found = found[found[:, 1] > found[:, 0]]
                # From characters to bytes: where each character starts.
                own = data[offsets[row]:offsets[stop]]
                place = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own)) + offsets[row]
                starts.append(place[found[:, 0]])
                ends.append(place[found[:, 1]])
            else:
                while stop < len(by_pattern) and not by_pattern[stop]:
                    stop += 1
                own = pretoken_starts(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]) + offsets[row]
                starts.append(own)
                ends.append(np.append(own[1:], offsets[stop])[:len(own)])
            row = stop
        return np.concatenate(starts), np.concatenate(ends), raw

    def _encode_block(self, data, offsets):
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts, ends, raw = self._spans(data, offsets)
        number = self.hash(span_hashes(data, starts, ends))
        sizes = np.ones(len(starts), np.int64)
        # Tier 1: the number belongs to this pre-token if lengths and all bytes agree.
        maybe = np.flatnonzero((number >= 0) & (self.sizes[number] == ends - starts))
        length = self.sizes[number[maybe]]
        same = data[index_of_ranges(starts[maybe], length)] == self.flat[index_of_ranges(self.starts[number[maybe]], length)]
        wrong = np.concatenate([[0], np.cumsum(~same)])
        last = np.cumsum(length)
        whole = maybe[wrong[last] == wrong[last - length]]
        # Tier 2: all others are merged, each different one once.
        rest = np.ones(len(starts), bool)
        rest[whole] = False
        rest = np.flatnonzero(rest)
        if self._bytes > POOL:
            self._forget()
        found = [self._merged(raw[a:b]) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        sizes[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        total = np.cumsum(sizes)
        ids = np.empty(total[-1] if len(total) else 0, np.int32)
        ids[(total - sizes)[whole]] = self.ids[number[whole]]
        ids[index_of_ranges((total - sizes)[rest], sizes[rest])] = np.frombuffer(b"".join(found), np.int32)
        before = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
        return ids, np.diff(before)

    def _merged(self, piece):
        """The ids of a pre-token, four bytes each."""
        known = self._known.get(piece)
        if known is None:
            known = self._known[piece] = array("i", merged(piece, self._ranks, self.longest, self._tables)).tobytes()
            self._bytes += len(piece)
        return known

    # --- decoding -----------------------------------------------------------------

    def decode(self, ids, counts):
        """(bytes, counts of bytes) of sequences of ids one after another."""
        ids = np.asarray(ids, np.int64)
        inside = (ids >= 0) & (ids < len(self.by_id))
        number = np.where(inside, self.by_id[np.where(inside, ids, 0)], -1)
        if (number < 0).any():
            raise ValueError(f"id {int(ids[number < 0][0])} is not in the vocabulary")
        sizes = self.sizes[number]
        data = self.flat[index_of_ranges(self.starts[number], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return data, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


#: The pattern whose pre-tokens ``pretoken_starts`` finds for whole blocks.
TILED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_tables(ranks):
    """The ids of single bytes, and the ranks of all pairs of bytes (-1: none) at 256 * first + second."""
    pairs = [-1] * 65_536
    for token, rank in ranks.items():
        if len(token) == 2:
            pairs[token[0] << 8 | token[1]] = rank
    return [ranks[bytes([b])] for b in range(256)], pairs


def merged(piece, ranks, longest, tables=None):
    """Ids of ``piece`` after all merges: a heap of (rank, place) over parts linked by where they end and begin.

    A heap entry is one integer, the rank above the place. It counts only while the pair that
    starts at its place has its rank: a merge changes the ranks of the two pairs beside it.
    The merged part's id is that rank.
    """
    size, get = len(piece), ranks.get
    single, pairs = byte_tables(ranks) if tables is None else tables
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    rank = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
    ids = [single[b] for b in piece]
    if size >= LONG:  # arrays take a fifth of the memory of lists
        after, before, rank, ids = array("q", after), array("q", before), array("q", rank), array("q", ids)
    heap = [r << PLACE | i for i, r in enumerate(rank) if r >= 0]
    heapify(heap)
    mask = (1 << PLACE) - 1
    while heap:
        entry = heappop(heap)
        i = entry & mask
        r = rank[i]
        if r != entry >> PLACE:
            continue
        gone = after[i]
        stop = after[i] = after[gone]
        ids[i] = r
        if stop < size:
            rank[gone] = -1
            before[stop] = i
            end = after[stop]
            rank[i] = r = get(piece[i:end], -1) if end - i <= longest else -1
            if r >= 0:
                heappush(heap, r << PLACE | i)
        else:
            rank[i] = -1
            if gone < size - 1:
                rank[gone] = -1
        if i:
            near = before[i]
            rank[near] = r = get(piece[near:stop], -1) if stop - near <= longest else -1
            if r >= 0:
                heappush(heap, r << PLACE | near)
    out, i = [], 0
    while i < size:
        out.append(ids[i])
        i = after[i]
    return out


# --- on DataFrames -------------------------------------------------------------------

def _others(df, names, keep):
    """The columns that stay: ``keep`` or all, but for those that are called like the new one."""
    kept = df.columns if keep is None else list(keep)
    return [c for c in kept if c.lower() not in {n.lower() for n in names}]


def encode(docs, vocabulary, into="token_ids", text="text", keep=None, decoded=None):
    """``docs`` with the column ``into``: each whole text's token ids; ``decoded`` names a column for what they decode to.

    Row by row, without a shuffle. A null or empty text has no ids (an empty
    array); repeated rows are encoded each; a null in any other column stays.
    An empty table gives none. Texts of any length are whole: one is one block. A column already
    called like a new one (in any case) is replaced; ``keep`` names the other columns to return (all).
    Special tokens are ordinary text.
    """
    names = [into] if decoded is None else [into, decoded]
    others = _others(docs, names, keep)
    source = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias(TEXT))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = StructType([*source.schema.fields[:-1], StructField(into, ArrayType(IntegerType(), False), False), *[
        StructField(n, BinaryType(), False) for n in names[1:]]])

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                ids, counts = sent.value.encode(part.column(part.num_columns - 1))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                if decoded is not None:
                    new.append(_binary(*sent.value.decode(ids, counts)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*part.schema.names[:-1], *names])

    return source.mapInArrow(work, schema)


def decode(tokens, vocabulary, ids="token_ids", into="decoded", keep=None):
    """``tokens`` with the column ``into``: the bytes that the ids stand for.

    Null ids give null, no ids give no bytes; a null or an unknown id within a row is an
    error. Repeated rows are decoded each, an empty table gives none, a column already called
    ``into`` (in any case) is replaced; ``keep`` names the other columns to return (all).
    """
    others = _others(tokens, [into], keep)
    source = tokens.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids}`").cast("array<int>").alias(TEXT))
    sent = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    schema = StructType([*source.schema.fields[:-1], StructField(into, BinaryType(), True)])

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                lists = part.column(part.num_columns - 1)
                flat = lists.flatten()
                if flat.null_count:
                    raise ValueError("null among the ids")
                counts = np.diff(lists.offsets.to_numpy())
                if lists.null_count:
                    counts = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, counts)
                data, sizes = sent.value.decode(flat.to_numpy(), counts)
                values = _binary(data, sizes)
                if lists.null_count:
                    values = pa.array([None if n else v.as_py() for n, v in zip(lists.is_null().to_pylist(), values, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], [*part.schema.names[:-1], into])

    return source.mapInArrow(work, schema)


def _binary(data, sizes):
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return values.cast(pa.binary())


def slices(batch, most=8 * BLOCK):
    """Runs of whole rows of some megabytes, so that what is made of them stays small too."""
    rows = max(1, min(batch.num_rows, batch.num_rows * most // max(1, batch.column(batch.num_columns - 1).nbytes)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def digests(docs, path, pattern=None):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded by ``encode``, digests of both."""
    vocabulary = Vocabulary.read(path, pattern)
    # One pass of Python: what is decoded are the ids, where they are made.
    return encode(docs, vocabulary, keep=["doc_id"], decoded="decoded").select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
