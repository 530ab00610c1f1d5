"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

The library is asked once per different pre-token and worker, as far as a
bounded table remembers; which bytes form a pre-token is worked out for whole
blocks at once. Texts with characters beyond U+00FF or with the text of a
special token go through the library as they are.
"""

import numpy as np

from .spans import blocks, span_hashes

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3

# Unicode classes (letter, number, white space, other) up to U+00FF.
_ASCII = np.full(256, OTHER, np.uint8)
_ASCII[ord("a"):ord("z") + 1] = _ASCII[ord("A"):ord("Z") + 1] = LETTER
_ASCII[ord("0"):ord("9") + 1] = NUMBER
_ASCII[[9, 10, 11, 12, 13, 32]] = SPACE
_ASCII[[28, 29, 30, 31]] = OTHER
_C2 = np.full(256, OTHER, np.uint8)  # second bytes of U+0080 to U+00BF
_C2[[0xAA, 0xB5, 0xBA]] = LETTER
_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
_C2[[0x85, 0xA0]] = SPACE
_C3 = np.full(256, LETTER, np.uint8)  # second bytes of U+00C0 to U+00FF
_C3[[0x97, 0xB7]] = OTHER

#: Slots of the table of known pre-tokens, and token ids it holds before it starts anew.
SLOTS = 1 << 20
POOL = 1 << 23
BLOCK = 1 << 22

# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = np.zeros(256, "<u4")
_LETTERS[_PRINTABLE] = _PRINTABLE
_LETTERS[[b for b in range(256) if b not in _PRINTABLE]] = 256 + np.arange(256 - len(_PRINTABLE))

_known = {}


def _letters(raw):
    """The characters by which the vocabulary writes these bytes."""
    return _LETTERS[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")


class _Table:
    """Token ids by the 64-bit hash of a pre-token; a slot holds one pre-token, a newer one takes its place."""

    def __init__(self, path):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The file's model alone, for many pre-tokens in one string, a line break between them.
        self.joined = Tokenizer(self.tokenizer.model)
        self.joined.pre_tokenizer = pre_tokenizers.Split(_letters(b"\n"), "isolated")
        self.line_break = self.tokenizer.token_to_id(_letters(b"\n"))
        self.start_anew()

    def start_anew(self):
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int64)
        self.sizes = np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def add(self, hashes, spans):
        sizes, flat = np.zeros(len(spans), np.int64), []
        several = np.fromiter((b"\n" in s for s in spans), bool, len(spans))
        one, rest = np.flatnonzero(~several), np.flatnonzero(several)
        for first in range(0, len(one), 4096):
            own = one[first:first + 4096]
            ids = np.array(self.joined.encode(_letters(b"\n".join([spans[i] for i in own])), add_special_tokens=False).ids, np.int32)
            breaks = np.flatnonzero(ids == self.line_break)
            sizes[own] = np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1
            flat.append(ids[ids != self.line_break])
        for i in rest:
            ids = np.array(self.tokenizer.encode(spans[i].decode(), add_special_tokens=False).ids, np.int32)
            sizes[i] = len(ids)
            flat.append(ids)
        order = np.concatenate([one, rest])
        flat = np.concatenate(flat)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        first = np.zeros(len(spans), np.int64)
        first[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        slot = (hashes % np.uint64(SLOTS)).astype(np.int64)
        self.keys[slot], self.at[slot], self.sizes[slot] = hashes, first, sizes
        return first, sizes


def table_of(path):
    if path not in _known:
        _known[path] = _Table(path)
    return _known[path]


def pretoken_starts(data, offsets):
    """Starts of the pre-tokens of byte-level BPE in texts of characters up to U+00FF; they tile the texts."""
    kind = _ASCII[data]
    for lead, table in ((0xC2, _C2), (0xC3, _C3)):
        at = np.flatnonzero(data == lead)
        kind[at] = kind[at + 1] = table[data[at + 1]]
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    begin = begin[:-1]
    change = begin.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    at = np.flatnonzero(change & (kind != SPACE) & ~begin)
    at = at[kind[at - 1] == SPACE]  # runs right behind white space
    blank = data[at - 1] == 32
    start[at[blank]] = False  # the last blank belongs to the run
    start[at[blank] - 1] = True
    other = at[~blank]  # any other last white-space character stands alone
    last = other - 1 - (data[other - 1] >= 0x80)
    start[last] = True
    # Contractions: an apostrophe that starts a pre-token takes the letters with it.
    quote = np.flatnonzero(start & (data == 39))
    if len(quote):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        edges = np.concatenate([begin, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~edges[quote + 1]
        pair = inside & ~edges[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | (
            (one == ord("l")) & (two == ord("l"))))
        single = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        size = np.where(pair, 2, np.where(single, 1, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        start[after[after < len(data)]] = True
    return np.flatnonzero(start)


def token_ids(column, path):
    """(ids, counts): the ids of all texts of an Arrow column one after another, and how many each text has."""
    table = table_of(path)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, data, offsets in blocks(column, BLOCK):
        raw = data.tobytes()
        high = np.concatenate([[0], np.cumsum(data >= 0xC4)])
        whole = high[offsets[1:]] > high[offsets[:-1]]
        for mark in table.special:
            at = raw.find(mark)
            while at >= 0:
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        if whole.any():
            for row in range(len(whole)):
                a, b = offsets[row], offsets[row + 1]
                one = (np.array(table.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.int32)
                       if whole[row] else _block_ids(data[a:b], np.array([0, b - a]), table)[0])
                ids.append(one)
                counts.append(np.array([len(one)]))
        else:
            one, sizes = _block_ids(data, offsets, table)
            ids.append(one)
            counts.append(sizes)
    return np.concatenate(ids), np.concatenate(counts)


def _block_ids(data, offsets, table):
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    if table.used > POOL:
        table.start_anew()
    starts = pretoken_starts(data, offsets)
    ends = np.append(starts[1:], len(data))
    hashes = span_hashes(data, starts, ends)
    slot = (hashes % np.uint64(SLOTS)).astype(np.int64)
    at, sizes = table.at[slot], table.sizes[slot].astype(np.int64)
    missing = np.flatnonzero(table.keys[slot] != hashes)
    if len(missing):
        new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
        raw = data.tobytes()
        place = missing[first]
        found, length = table.add(new, [raw[a:b] for a, b in zip(starts[place], ends[place], strict=True)])
        at[missing], sizes[missing] = found[which], length[which]
    total = np.cumsum(sizes)
    index = np.repeat(at - (total - sizes), sizes) + np.arange(total[-1])
    before = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
    return table.pool[index], np.diff(before)
