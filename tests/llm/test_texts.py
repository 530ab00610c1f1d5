"""Operators on single texts: quality, language, decontamination, repeats, token files."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probity.llm import decontaminate, language, pretokens, quality, repeats, token_files
from probity.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def pandas(df, key="doc_id"):
    return df.toPandas().sort_values(key).reset_index(drop=True)


def test_quality_of_held_out_documents(spark):
    directory = "/root/testdata/sf0.01"
    got = QUERIES["op1_quality_classifier"](spark, directory).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    labels = spark.read.parquet(f"{directory}/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_edge_cases(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None), (99, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model)
    assert set(got.columns) == set(odd.columns) | {"predicted"} and got.count() == odd.count()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.score(nothing, quality.fit(nothing, labels.where("false"))).count() == 0


def test_calibrated_network_learns_and_one_class_gives_a_constant():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(600, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.train(x, y)
    p = 1 / (1 + np.exp(-quality.logits(x, net) / net["temperature"]))
    assert ((p > 0.5) == y).mean() > 0.9
    same = quality.train(x, np.ones(600))
    assert np.ptp(quality.logits(x, same)) == 0


def test_language_of_held_out_documents(spark):
    directory = "/root/testdata/sf0.01"
    got = QUERIES["op5_language_id"](spark, directory).toPandas()
    truth = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    held = truth[truth.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.rejected.mean() < 0.01


def test_language_edge_cases(odd, nothing):
    model = language.fit(odd)
    got = language.predict(odd, model)
    assert got.count() == odd.count() and {"score", "shard", "key"} <= set(got.columns)
    und = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6}
    assert got.where("lang_pred = 'und' and not rejected").count() == 0
    empty = language.fit(nothing)
    assert {r["lang_pred"] for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.predict(nothing, model).count() == 0


def test_far_texts_are_rejected(documents):
    model = language.fit(documents)
    far = documents.limit(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("zqxj vkwq jjxz "), 60).alias("text"))
    assert language.predict(far, model).head()["rejected"]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, length=10):
    windows = {}
    for item, text in items:
        own = plain_words(text)
        for s in range(max(1, len(own) - length + 1) if own else 0):
            windows.setdefault(tuple(own[s:s + length]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(own) - n + 1):
                if tuple(own[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(own[s:s + n])]
        names = ",".join(sorted(found))
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("pass_bytes", [1 << 25, 400])
def test_decontamination_against_brute_force(spark, documents, odd, small, pass_bytes):
    docs = documents.select("doc_id", "text").unionAll(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    bench = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text").limit(12).unionAll(
        spark.createDataFrame([("short", "the mat and"), ("none", "..."), ("null", None), ("w", "word " * 12)], "item_id string, text string"))
    bench = spark.createDataFrame(bench.collect(), "item_id string, text string")
    found = decontaminate.contamination(docs, bench, pass_bytes=pass_bytes).select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0)
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is None, r))
    assert got == plain_contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])


def test_decontamination_of_nothing(spark, odd, nothing):
    bench = spark.createDataFrame([("a", "the cat sat")], "item_id string, text string")
    assert decontaminate.digests(nothing, bench).count() == 0
    assert decontaminate.digests(odd, bench.where("false")).where("n_hit > 0").count() == 0


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "one two extra three four"), (2, "one two three four"), (3, "four three"), (4, "one four")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "one two three four")], "item_id string, text string")
    got = {r["doc_id"]: (r["items"], r["near"]) for r in decontaminate.contamination(docs, bench, slop=1).collect()}
    assert got == {1: ([], ["a"]), 2: (["a"], ["a"]), 3: ([], []), 4: ([], [])}


@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(values):
    assert repeats.suffix_array(values).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def plain_repeats(rows, length=50):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - length + 1):
            own = raw[s:s + length]
            first[own] = min(first.get(own, 1 << 62), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if first[raw[s:s + length]] < doc:
                gone[s:s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark):
    draw = np.random.default_rng(5)
    shared = ["".join(draw.choice(list("abcé "), 70)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, shared[0]), (2, shared[0]), (3, shared[0][:49]), (4, shared[0][:50]), (5, "z" * 400), (6, "z" * 120), (7, shared[1] * 40)]
    for doc in range(8, 60):
        parts = ["".join(draw.choice(list("abcé "), int(draw.integers(0, 60)))) for _ in range(5)]
        parts += [s[int(draw.integers(0, 15)):int(draw.integers(40, 70))] for s in shared]
        rows.append((doc, "".join(draw.permutation(parts))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in repeats.without_repeats(docs).collect()) == plain_repeats(rows)


def test_hot_anchors_are_split_and_give_the_same_answers(spark, monkeypatch):
    draw = np.random.default_rng(6)
    footer = "".join(draw.choice(list("abcdefgh "), 58))
    rows = [(k, "".join(draw.choice(list("abcdefgh "), int(draw.integers(0, 60)))) + footer[int(draw.integers(0, 5)):] + str(k)) for k in range(90)]
    rows += [(k + 100, text) for k, text in rows[:9]] + [(3, rows[4][1]), (3, rows[3][1]), (200, None), (201, footer)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    largest, plain = [], repeats._marks

    def watched(contexts, *args):
        largest.append(contexts.groupBy("hash").count().agg(F.max("count")).head()[0] or 0)
        return plain(contexts, *args)

    monkeypatch.setattr(repeats, "_marks", watched)
    wanted = plain_repeats(rows)
    for kinds, here in ((5, 4), (5, 1), (5, 25), (1000, 4)):
        got = sorted(tuple(r) for r in repeats.without_repeats(docs, kinds, here).collect())
        assert got == wanted and (largest.pop() <= 5) == (kinds == 5)


@given(st.lists(st.integers(0, 1 << 22), max_size=60), st.integers(1, 3))
def test_suffix_array_of_large_numbers(values, kinds):
    values = [v % kinds + (1 << 22) * (v % 2) for v in values] + values[:5]
    assert repeats.suffix_array(values).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 30), st.integers(0, 50), st.integers(0, 12)), min_size=1, max_size=12))
def test_one_span_for_every_anchor(drawn):
    """Of texts around an anchor, the strings that a smaller doc_id has as well, by their first and last place."""
    draw = np.random.default_rng(7)
    sides, anchor = draw.integers(97, 99, (2, 80)).astype(np.uint8), b"0123456789" * 2
    rows = []
    for group, doc, low, high, other in sorted(drawn, key=lambda x: x[:2]):
        before, after = sides[0][other // 4:][:30].tobytes()[30 - low:], sides[1][other % 4:][:high].tobytes()[:30]
        rows.append((group, doc, len(before), before + bytes([48 + group]) + anchor[1:] + after))
    wanted = []
    for k, (group, doc, left, text) in enumerate(rows):
        earlier = [t for g, d, _, t in rows if g == group and d < doc]
        own = [s for s in range(left + 1) if s + 50 <= len(text) and any(text[s:s + 50] in t for t in earlier)]
        wanted += [(k, own[0], own[-1])] if own else []
    found = repeats._repeats(*(np.array([r[k] for r in rows]) for k in range(3)), pa.array([b"cut off", *(r[3] for r in rows)])[1:])
    assert list(zip(*(x.tolist() for x in found), strict=True)) == wanted


def test_arrays_are_built_over_few_bytes(monkeypatch):
    """Sorted anchors of many batches: every array is over whole groups, of about ARRAY_BYTES."""
    draw, calls, plain = np.random.default_rng(8), [], repeats._repeats
    text = "".join(draw.choice(list("abcd"), 80)).encode()
    hashes = np.sort(draw.integers(0, 400, 20_000))
    keys = np.arange(len(hashes))
    table = pa.RecordBatch.from_arrays(
        [pa.array(hashes), pa.array(keys % 7), pa.array(keys), pa.array(np.full(len(keys), 40, np.int32)), pa.array(np.full(len(keys), 30, np.int32)),
         pa.array([text[:79] + bytes([65 + k % 5]) for k in keys])], ["hash", "ord", "key", "at", "left", "around"])

    def watched(hashes, *rest):
        calls.append(hashes)
        return plain(hashes, *rest)

    class Contexts:
        """Takes the function that each task runs."""
        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, task, schema):
            return list(task(table.slice(low, 1000) for low in range(0, len(keys), 1000)))

    monkeypatch.setattr(repeats, "_repeats", watched)
    got = repeats._marks(Contexts())
    assert np.concatenate(calls).tolist() == hashes.tolist() and len(calls) > 3
    assert all(a[-1] != b[0] for a, b in zip(calls, calls[1:]))
    assert max(len(c) * len(text) for c in calls) <= repeats.ARRAY_BYTES + 100 * len(text)
    # One span for each row: all but the smallest doc_id's have their whole strings elsewhere, up to the last byte at least.
    spans = {k: (n >> repeats.END_BITS, n & ((1 << repeats.END_BITS) - 1)) for b in got for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert set(spans) == set(keys[keys % 7 > 0].tolist()) | {k for k in spans if k % 7 == 0} and set(spans.values()) <= {(10, 89), (10, 90)}


def test_repeats_of_empty_texts_alone(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "")], "doc_id long, text string").coalesce(1)
    empty = hashlib.sha256().hexdigest()
    assert sorted((tuple(r) for r in repeats.without_repeats(docs).collect()), key=str) == sorted([(k, 0, 0, 0, empty) for k in (1, 2, 2, None)], key=str)


def test_repeats_edge_cases(odd, nothing):
    got = repeats.without_repeats(odd).collect()
    assert len(got) == odd.count()
    told = {r["doc_id"]: r for r in got}
    assert told[1]["n_removed"] == 0 and told[2]["n_removed"] == told[2]["n_bytes"] and told[4]["n_bytes"] == told[5]["n_bytes"] == 0
    assert repeats.without_repeats(nothing).count() == 0


LATIN = st.text(st.characters(max_codepoint=0xFF, exclude_categories=("Cs",)), max_size=60)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(LATIN, st.text(max_size=20), st.text(st.sampled_from(" \n'stredvlmLA1.\xa0"), max_size=30)), max_size=12))
def test_token_ids_are_the_library_s(texts):
    texts = [t for t in texts if not re.search("[\ud800-\udfff]", t)]
    ids, counts = pretokens.token_ids(pa.array(texts, pa.string()), BPE)
    tokenizer = pretokens.table_of(BPE).tokenizer
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=300), st.integers(1, 9))
def test_coded_blocks_round_trip(ids, lanes):
    freq = token_files.frequency_table(np.bincount(ids, minlength=8))
    assert int(freq.sum()) == 1 << token_files.SCALE
    block = token_files.encode_block(ids, [len(ids)], freq, lanes=lanes, every=4)
    got, sizes = token_files.decode_block(block, freq)
    assert got.tolist() == ids and sizes.tolist() == [len(ids)]
    if len(ids) > 4 * lanes:
        assert token_files.decode_block(block, freq, first_step=4)[0].tolist() == ids[4 * lanes:]
    damaged = bytes([block[0]]) + block[1:-9] + bytes([block[-9] ^ 1]) + block[-8:]
    with pytest.raises(ValueError):
        token_files.decode_block(damaged, freq)


def test_token_files_against_the_library(odd, nothing, documents):
    tokenizer = pretokens.table_of(BPE).tokenizer
    docs = documents.select("doc_id", "text").unionAll(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 9000).alias("doc_id"), "text"))
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.written_digests(docs, BPE, 50_257).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert token_files.written_digests(odd, BPE, 50_257).count() == odd.count()
    assert token_files.written_digests(nothing, BPE, 50_257).count() == 0
