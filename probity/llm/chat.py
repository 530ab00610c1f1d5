"""Chat formatting by columns: all turns of a batch are written into one Arrow buffer.

A turn is written as ``<|turn role|>``, line break, text, ``</s>``, line break. Inside
texts and roles, every ``<``, ``[`` and ``|`` is followed by a backslash, so that
no control string of this or another common template (``<|...|>``, ``<s>``,
``[INST]``, ``<<SYS>>``) is left in them; reading takes these backslashes away, and
every text comes back as it was.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .shared import new_path
from .spans import BLOCK_BYTES, column_bytes

OPEN, CLOSE_ROLE, END = b"<|turn ", b"|>\n", b"</s>\n"
SCORED_ROLE = "assistant"

TURNS = "conv_id long, turn long, formatted string, loss_start int, loss_chars int"

_FOLLOWED = re.compile(r"([<\[|])\\")


def escaped(column):
    """Texts with a backslash behind every character that could open or close a mark."""
    return pc.replace_substring_regex(column, r"([<\[|])", r"\1\\")


def unescaped(text):
    return _FOLLOWED.sub(r"\1", text)


def _joined(segments):
    """One array of strings, each row the row's segments one after another, copied into one buffer.

    ``segments``: (bytes, offsets) of a column, or bytes that every row has.
    """
    rows = next(len(s[1]) - 1 for s in segments if isinstance(s, tuple))
    lengths = np.stack([np.diff(s[1]) if isinstance(s, tuple) else np.full(rows, len(s)) for s in segments], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(rows, len(segments))
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    for k, segment in enumerate(segments):
        if isinstance(segment, tuple):
            data, offsets = segment
            own = data[offsets[0]:offsets[-1]]
            # Byte i of the column goes to i shifted by its row's distance.
            out[np.arange(len(own)) + np.repeat(starts[:, k] - (offsets[:-1] - offsets[0]), lengths[:, k])] = own
        elif len(segment):
            out[(starts[:, k][:, None] + np.arange(len(segment))).ravel()] = np.tile(np.frombuffer(segment, np.uint8), rows)
    offsets = np.concatenate([[0], ends[:, -1]]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out))


def formatted_batch(roles, texts):
    """(formatted, start and length of the text under the loss mask, in characters) of a batch of turns."""
    roles, texts = pc.fill_null(roles.cast(pa.large_string()), ""), pc.fill_null(texts.cast(pa.large_string()), "")
    own_roles, own_texts = escaped(roles), escaped(texts)
    out = _joined([OPEN, column_bytes(own_roles), CLOSE_ROLE, column_bytes(own_texts), END])
    scored = pc.equal(roles, SCORED_ROLE).to_numpy(zero_copy_only=False)
    start = pc.utf8_length(own_roles).to_numpy() + len(OPEN) + len(CLOSE_ROLE)
    return out, np.where(scored, start, 0), np.where(scored, pc.utf8_length(own_texts).to_numpy(), 0)


def format_turns(turns):
    """One formatted row (conv_id, turn, formatted, loss_start, loss_chars) for every row of ``turns`` (conv_id, turn, role, text).

    A null role or text counts as empty. Turns are formatted where they are; a
    conversation is its rows in order of turn.
    """
    def formatted(batches):
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy())
            first = 0
            while first < batch.num_rows:
                stop = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BLOCK_BYTES, "right")))
                part = batch.slice(first, stop - first)
                text, start, length = formatted_batch(part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), text.cast(pa.string()), pa.array(start, pa.int32()), pa.array(length, pa.int32())],
                    ["conv_id", "turn", "formatted", "loss_start", "loss_chars"])
                first = stop

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(formatted, TURNS)


def write(turns, path):
    """Write the formatted turns, each file in order of conversation and turn.

    A conversation's rows are next to each other: those of one conversation
    are in one file, unless it is longer than a file; then the next file goes on.
    Rows of equal turn are in order of their text. Null conversations come first.
    """
    rows = format_turns(turns)
    (rows.repartitionByRange("conv_id", "turn", "formatted").sortWithinPartitions("conv_id", "turn", "formatted").write.parquet(path))
    return turns.sparkSession.read.parquet(path)


def parsed(formatted):
    """(role, text) of one formatted turn."""
    role, rest = formatted[len(OPEN):].split(CLOSE_ROLE.decode(), 1)
    return unescaped(role), unescaped(rest[:-len(END)])


def digests(written):
    """What the written turns hold, a row per conversation; each is read as a stream in order of its turns."""
    def read(batches):
        own = None

        def closed():
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([own["id"]], pa.int64()), "n_turns": pa.array([own["n"]], pa.int64()),
                "turns_sha256": [own["turns"].hexdigest()], "loss_chars": pa.array([own["loss"]], pa.int64()),
                "loss_sha256": [own["masked"].hexdigest()], "formatted_chars": pa.array([own["chars"]], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if own is None or own["id"] != row["conv_id"]:
                    if own is not None:
                        yield closed()
                    own = {"id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "masked": hashlib.sha256(), "loss": 0, "chars": 0}
                role, text = parsed(row["formatted"])
                own["n"] += 1
                own["turns"].update(f"{role}\n{text}\n".encode())
                own["chars"] += len(row["formatted"])
                masked = unescaped(row["formatted"][row["loss_start"]:row["loss_start"] + row["loss_chars"]])
                own["masked"].update(masked.encode())
                own["loss"] += len(masked)
        if own is not None:
            yield closed()

    return written.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def written_digests(turns):
    """Format ``turns`` into a new folder in the shared place and give the digests of what it holds."""
    return digests(write(turns, new_path(turns.sparkSession, "chats")))
