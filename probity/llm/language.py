"""Language identification by the nearest centroid of normalised TF-IDF n-gram vectors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import PIECES, pieces, summed
from .spans import TEXT, blocks

BUCKETS = 4096
UNKNOWN = "und"
#: Texts of fewer than 2 ** SHORT_BAND - 1 n-grams say too little to be far from a language.
SHORT_BAND = 6

# a-z keep their own class, bytes beyond ASCII their low bits, all else is a gap.
_CLASS = np.zeros(256, np.uint32)
_CLASS[ord("a"):ord("z") + 1] = _CLASS[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_CLASS[0x80:] = 27 + (np.arange(0x80, 0x100) & 31)


def gram_counts(data, offsets):
    """Counts (rows x BUCKETS) of the hashed 2- and 3-grams of every text; n-grams never cross texts."""
    rows = len(offsets) - 1
    counts = np.zeros((rows, BUCKETS), np.float32)
    if len(data) < 2:
        return counts
    classes = _CLASS[data]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    flat = np.zeros(rows * BUCKETS, np.int64)
    code = classes
    for size in (2, 3):
        if len(data) < size:
            break
        code = (code[:1 - size or None] if size == 2 else code[:-1]) * np.uint32(64) + classes[size - 1:]
        bucket = ((code + np.uint32(size << 20)) * np.uint32(2654435761)) >> np.uint32(20)
        first, last = row[:1 - size], row[size - 1:]
        # A gap in the middle or at both ends says nothing; one at an end marks the edge of a word.
        told = (first == last) & ((code & np.uint32(63)) + (code >> np.uint32(6 * (size - 1))) > 0)
        flat += np.bincount(first[told] * BUCKETS + bucket[told], minlength=rows * BUCKETS)
    return flat.reshape(rows, BUCKETS).astype(np.float32)


def _vectors(counts, idf):
    weights = np.log1p(counts) * idf
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights / np.where(norms > 0, norms, 1)


def _clustered(vectors, clusters, rounds=12):
    """Spherical k-means; starts from far apart rows, so the same rows give the same centroids."""
    centres = [vectors.mean(axis=0)]
    nearest = vectors @ centres[0]
    for _ in range(min(clusters, len(vectors)) - 1):
        centres.append(vectors[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, vectors @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        centres = np.array([vectors[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(norms > 0, norms, 1)
    return centres.astype(np.float32)


def _band(counts):
    return np.log2(1 + counts.sum(axis=1)).astype(np.int64).clip(0, 31)


def fit(labelled, clusters=4, rows_per_language=250, most_languages=200, slack=0.5):
    """Learn centroids from ``labelled`` (doc_id, text, lang).

    Document frequencies cover every labelled row. The centroids come from a
    bounded sample: at most ``rows_per_language`` rows (the smallest hashes of
    doc_id) of each language, for at most ``most_languages`` languages. A text
    is rejected if its best cosine is under ``slack`` times the lowest of the
    sample's rows of its length or longer (lengths in powers of two); one of
    under 63 n-grams isn't. Rows
    without a language or text teach nothing; without any the model is empty.
    """
    labelled = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                total[:-1] += (gram_counts(data, offsets) > 0).sum(axis=0)
            total[-1] += batch.num_rows
        yield pieces(total)

    total = summed(labelled.select("text").mapInArrow(frequencies, PIECES), BUCKETS + 1)
    idf = (np.log((1 + total[-1]) / (1 + total[:-1])) + 1).astype(np.float32)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return {"languages": [], "idf": idf, "centres": np.zeros((0, BUCKETS), np.float32), "owner": [], "floors": {}}
    # The prefilter leaves about twice the sample, so that the ranks move few rows.
    draw = F.xxhash64(F.col("doc_id"), F.lit(5))
    chance = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (2 * rows_per_language + 50) / n))])
    drawn = labelled.select("doc_id", "lang", draw.alias("draw")).where(
        F.pmod("draw", F.lit(1 << 20)) < chance[F.col("lang")] * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = drawn.withColumn("rank", rank).where(F.col("rank") <= rows_per_language).select("doc_id", "lang")
    # At most rows_per_language * most_languages ids.
    sample = labelled.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).select("lang", "text")

    def counted(batches):
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                sent = [c.astype("<u2" if c.max(initial=0) < 65536 else "<u4") for c in gram_counts(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sent)), pa.array([c.tobytes() for c in sent], pa.binary())], ["lang", "counts"])

    rows = sample.mapInArrow(counted, "lang string, counts binary").collect()
    languages, centres, owner, floors = sorted({r["lang"] for r in rows}), [], [], {}
    for k, language in enumerate(languages):
        counts = sorted(r["counts"] for r in rows if r["lang"] == language)
        counts = np.array([np.frombuffer(c, "<u2" if len(c) == 2 * BUCKETS else "<u4") for c in counts], np.float32)
        vectors = _vectors(counts, idf)
        own = _clustered(vectors[vectors.any(axis=1)], clusters) if vectors.any() else np.zeros((0, BUCKETS), np.float32)
        centres.append(own)
        owner += [k] * len(own)
        best, band = (vectors @ own.T).max(axis=1, initial=0), _band(counts)
        lowest, floor = 1.0, np.zeros(32)
        for b in range(31, -1, -1):  # a shorter text is never held to more than a longer one
            lowest = min([lowest, *best[band == b]])
            floor[b] = lowest
        floor[:SHORT_BAND] = 0
        floors[k] = (slack * floor).astype(np.float32)
    return {"languages": languages, "idf": idf, "centres": np.concatenate(centres), "owner": owner, "floors": floors}


def _has_letter(data, offsets):
    """True for every text with a letter of any script."""
    folded = data | 32
    ascii_letter = (folded >= ord("a")) & (folded <= ord("z"))
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for row in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        text = data[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8", "replace")
        found[row] = any(map(str.isalpha, text))
    return found


def predict(docs, model, names=("lang_pred", "score", "rejected"), keep=None):
    """Add the predicted language, its cosine (0 to 1) and whether it is rejected to every row of ``docs``.

    A null text and one without a letter get ``und``, 0 and rejected; so does
    any text if the model is empty. Columns of ``docs`` under the given names
    are replaced; all others (or only those of ``keep``) stay as they are.
    Repeated rows stay repeated.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")

    def scored(batches):
        model = sent.value
        owner = np.array(model["owner"], np.int64)
        labels = np.array([*model["languages"], UNKNOWN], dtype=object)
        floors = np.array([*(model["floors"][k] for k in range(len(model["languages"]))), np.zeros(32)])
        for batch in batches:
            own, score, far = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
            for _, data, offsets in blocks(batch.column(len(kept))):
                counts = gram_counts(data, offsets)
                if len(owner):
                    near = _vectors(counts, model["idf"]) @ model["centres"].T
                    best = near.argmax(axis=1)
                    cosine, language = near[np.arange(len(near)), best], owner[best]
                else:
                    cosine, language = np.zeros(len(counts)), np.full(len(counts), -1)
                told = _has_letter(data, offsets) & (language >= 0)
                language = np.where(told, language, len(labels) - 1)
                own.append(language)
                score.append(np.where(told, cosine.clip(0, 1), 0))
                far.append(~told | (cosine < floors[language, _band(counts)]))
            columns = [pa.array(labels[np.concatenate(own)], pa.string()), pa.array(np.concatenate(score), pa.float64()),
                       pa.array(np.concatenate(far), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*kept, *names])

    return docs.select(*kept, F.col("text").alias(TEXT)).mapInArrow(scored, schema)
