"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .shared import PIECES, pieces, summed
from .spans import IN_WORD, LOWER, TEXT, blocks, mixed, runs, span_hashes

#: Words are hashed to this many rows of the vector table; no word is left out.
BUCKETS = 8192
DIMENSIONS = 64
#: Entries of +1 or -1 in the index vector of a word.
ENTRIES = 2
#: Words to either side that make up the context of a word.
WINDOW = 2

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _tokens(data, offsets):
    """(bucket, row) of words and of runs of signs, in order."""
    data = LOWER[data]
    word, space = IN_WORD[data], _SPACE[data]
    first, one = runs(word, offsets), runs(~word & ~space, offsets)
    starts, ends, row = (np.concatenate(pair) for pair in zip(first, one, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends, row = starts[order], ends[order], row[order]
    return (span_hashes(data, starts, ends) >> np.uint64(64 - 13)).astype(np.int64), row


def _index_vectors():
    """(dimension, sign) of the entries of every bucket's index vector."""
    draws = mixed(np.arange(BUCKETS * ENTRIES, dtype=np.uint64) + np.uint64(1))
    return (draws % np.uint64(DIMENSIONS)).astype(np.int64).reshape(BUCKETS, ENTRIES), np.where(
        draws >> np.uint64(63), 1, -1).reshape(BUCKETS, ENTRIES)


def word_vectors(docs):
    """The table (BUCKETS x DIMENSIONS) of unit vectors: sums of the index vectors of the words around each word, over all texts."""
    def contexts(batches):
        place, sign = _index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS, np.float64)  # whole numbers, exact up to 2 ** 53
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                bucket, row = _tokens(data, offsets)
                word, other = [], []
                for gap in range(1, WINDOW + 1):
                    near = row[gap:] == row[:-gap]
                    left, right = bucket[:-gap][near], bucket[gap:][near]
                    word += [left, right]
                    other += [right, left]
                word, other = np.concatenate(word), np.concatenate(other)
                cells = (word[:, None] * DIMENSIONS + place[other]).ravel()
                total += np.bincount(cells, weights=sign[other].ravel(), minlength=len(total))
        yield pieces(total)

    table = summed(docs.select("text").mapInArrow(contexts, PIECES), BUCKETS * DIMENSIONS).reshape(BUCKETS, DIMENSIONS).astype(np.float64)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norms > 0, norms, 1)).astype(np.float32)


def _pooled(data, offsets, table):
    """Mean and spread of the word vectors of every text, and the logarithm of its words; zeros without words."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 2 * DIMENSIONS + 2), np.float32)
    bucket, row = _tokens(data, offsets)
    if not len(bucket):
        return out
    counts = np.bincount(row * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(np.float32)
    sizes = counts.sum(axis=1, keepdims=True)
    n = np.maximum(sizes, 1)
    mean, square = counts @ table / n, counts @ (table * table) / n
    out[:, :DIMENSIONS] = mean
    out[:, DIMENSIONS:2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[:, -2] = np.log1p(sizes[:, 0])
    out[:, -1] = (counts > 0).sum(axis=1) / n[:, 0]  # share of different words
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _hidden(x, net):
    return np.tanh(x @ net["w1"] + net["b1"])


def logits(features, net):
    """The network's output for rows of pooled features."""
    return _hidden((features - net["mean"]) / net["scale"], net) @ net["w2"] + net["b2"]


def train(features, labels, hidden=24, steps=600, rate=0.01, decay=1e-3, seed=7):
    """A two-layer network; a fifth of the rows sets the temperature and is not trained on.

    With one class only or no rows every score is the smoothed share of label 1.
    """
    labels = np.asarray(labels, np.float64)
    width = features.shape[1]
    net = {"mean": np.zeros(width), "scale": np.ones(width), "w1": np.zeros((width, 1)), "b1": np.zeros(1), "w2": np.zeros(1),
           "b2": float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))), "temperature": 1.0}
    if len(labels) < 10 or labels.min() == labels.max():
        return net
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(labels))
    held, own = order[:len(order) // 5], order[len(order) // 5:]
    scale = features[own].std(axis=0)
    net |= {"mean": features[own].mean(axis=0), "scale": np.where(scale > 1e-6, scale, 1)}
    x, y = (features[own] - net["mean"]) / net["scale"], labels[own]
    net |= {"w1": draw.normal(0, width ** -0.5, (width, hidden)), "b1": np.zeros(hidden), "w2": draw.normal(0, hidden ** -0.5, hidden)}
    moments = {k: [0.0, 0.0] for k in ("w1", "b1", "w2", "b2")}
    for step in range(1, steps + 1):
        h = _hidden(x, net)
        error = (_sigmoid(h @ net["w2"] + net["b2"]) - y) / len(y)
        back = np.outer(error, net["w2"]) * (1 - h * h)
        slopes = {"w1": x.T @ back + decay * net["w1"], "b1": back.sum(axis=0), "w2": h.T @ error + decay * net["w2"], "b2": error.sum()}
        for k, slope in slopes.items():
            moments[k] = [0.9 * moments[k][0] + 0.1 * slope, 0.999 * moments[k][1] + 0.001 * slope * slope]
            net[k] = net[k] - rate * (moments[k][0] / (1 - 0.9 ** step)) / (np.sqrt(moments[k][1] / (1 - 0.999 ** step)) + 1e-8)
    raw, truth = logits(features[held], net), labels[held]

    def loss(temperature):
        p = _sigmoid(raw / temperature).clip(1e-12, 1 - 1e-12)
        return -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()

    net["temperature"] = float(min(np.geomspace(0.25, 8, 121), key=loss))
    return net


def fit(docs, labelled, most_rows=10_000):
    """Word vectors over every text of ``docs`` and a network over ``labelled`` (doc_id, quality).

    The network sees a bounded sample of the labelled rows: all of them up to
    ``most_rows``, else about that many by a hash of doc_id. Labels that are
    null, and those of unknown or null documents, teach nothing; a document
    labelled twice teaches twice.
    """
    table = word_vectors(docs)
    labelled = labelled.select("doc_id", F.col("quality").cast("double").alias("quality")).where(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = most_rows / max(1, labelled.count())
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)) if share < 1 else labelled
    # About most_rows small rows, whatever the size of the tables.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def featured(batches):
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                vectors = [v.tobytes() for v in _pooled(data, offsets, sent.value)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(vectors)), batch.column(2).slice(row, len(vectors)), pa.array(vectors, pa.binary())],
                    ["doc_id", "quality", "vector"])

    rows = sample.select("doc_id", "text", "quality").mapInArrow(featured, "doc_id long, quality double, vector binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["quality"], r["vector"]))
    features = np.array([np.frombuffer(r["vector"], np.float32) for r in rows], np.float64).reshape(-1, 2 * DIMENSIONS + 2)
    return {"table": table, "net": train(features, [float(r["quality"] > 0) for r in rows])}


def score(docs, model, names=("score", "predicted"), keep=None):
    """Add the calibrated probability of label 1 and the prediction (1 from 0.5 on) to every row.

    A null or empty text is scored as a text without words. Columns of ``docs``
    under the given names are replaced, the others (or only those of ``keep``)
    stay; repeated rows stay repeated.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = docs.select(*kept).schema.add(names[0], "double").add(names[1], "integer")

    def scored(batches):
        table, net = sent.value["table"], sent.value["net"]
        for batch in batches:
            raw = [logits(_pooled(data, offsets, table).astype(np.float64), net) for _, data, offsets in blocks(batch.column(len(kept)))]
            p = _sigmoid(np.concatenate([np.zeros(0), *raw]) / net["temperature"])
            columns = [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*kept, *names])

    return docs.select(*kept, F.col("text").alias(TEXT)).mapInArrow(scored, schema)
