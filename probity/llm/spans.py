"""Texts of an Arrow column as one byte array: blocks, word spans and hashes of spans, all in numpy."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is its own block.
BLOCK_BYTES = 1 << 20

#: Name of the text on its way into a task, beside columns of any name.
TEXT = "__text"

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes inside a word: digits, letters and every byte of a character beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0"):ord("9") + 1] = IN_WORD[ord("a"):ord("z") + 1] = IN_WORD[0x80:] = True


def column_bytes(column):
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(column, limit=BLOCK_BYTES):
    """Yield (first row, bytes, offsets) for runs of whole rows of about ``limit`` bytes."""
    if not len(column):
        return
    data, offsets = column_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def runs(inside, offsets):
    """(starts, ends, row) of the maximal runs of true values; a run never crosses rows."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(values):
    """Spread 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(length):
    """Powers of the hash multiplier and of its inverse, ``length`` of each."""
    if len(_powers[0]) < length:
        for slot, base in enumerate((_MULTIPLIER, _INVERSE)):
            table = np.full(max(length, 2 * BLOCK_BYTES), base, np.uint64)
            table[0] = 1
            _powers[slot] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:length], _powers[1][:length]


def span_hashes(data, starts, ends):
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    power, inverse = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64, out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts])


def words(data, offsets):
    """(hashes, row) of the lower-cased words, in order."""
    data = LOWER[data]
    starts, ends, row = runs(IN_WORD[data], offsets)
    return span_hashes(data, starts, ends), row
