"""Byte-level BPE, vector codes and the filter audit: against a library, brute force, SQL and edge cases."""

import base64
import hashlib
import math
import re
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st

from probity.llm import byte_pairs, codes, filter_audit
from probity.llm.queries import ORACLES, QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- Byte-level BPE --------------------------------------------------------------------

LETTERS = st.text(alphabet="ab'stremvdl 19²½ªéß×÷\x85\x1c\x1f\n\t!?#<|>日本😀\xa0", max_size=30)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), LETTERS, st.text(max_size=20)), max_size=6))
@example(texts=["ab" * 20_000, "a" * 20_001, None, "", "it's 're 'RE  \n\n x"])
def test_ids_are_those_of_the_library(vocabulary, library, texts):
    ids, counts = vocabulary.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, start, end in zip(texts, ends - counts, ends, strict=True):
        assert ids[start:end].tolist() == library.encode_ordinary(text or "")
    data, sizes = vocabulary.decode(ids, counts)
    assert data.tobytes() == "".join(t or "" for t in texts).encode() and sizes.sum() == len(data)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_perfect(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    hashed = byte_pairs.PerfectHash(keys)
    assert sorted(hashed(keys).tolist()) == list(range(n))
    others = hashed(np.arange(500, dtype=np.uint64))
    assert ((others >= -1) & (others < max(n, 1))).all()
    with pytest.raises(ValueError):
        byte_pairs.PerfectHash(np.array([5, 5], np.uint64))


def test_every_token_is_found_whole_or_merged(vocabulary):
    assert sorted(vocabulary.ids.tolist()) == list(range(50_256))
    data, sizes = vocabulary.decode(np.arange(50_256), np.ones(50_256, np.int64))
    assert sizes.sum() == vocabulary.sizes.sum() == len(data)


def test_merges_of_own_ranks():
    # "abc" is no token; the pair of least rank goes first, the leftmost of equals.
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"aa": 301, b"aaaa": 302}
    assert byte_pairs.merged(b"abc", ranks, 4) == [97, 299]
    assert byte_pairs.merged(b"aaaaa", ranks, 4) == [302, 97]
    assert byte_pairs.merged(b"aaa", ranks, 4) == [301, 97]
    with pytest.raises(ValueError):
        byte_pairs.Vocabulary({b"a": 0}, "x")


def test_own_patterns_and_long_links(monkeypatch, vocabulary, library):
    monkeypatch.setattr(byte_pairs, "LONG", 4)
    own = byte_pairs.Vocabulary.read(PATH, r"\S+|\s+")
    other = tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks=library._mergeable_ranks, special_tokens={})
    text = "unlikelywordsofanysize and-some/paths=of&others   " * 20
    assert own.encode(pa.array([text]))[0].tolist() == other.encode_ordinary(text)


def test_forgetting_changes_nothing(monkeypatch, vocabulary, library):
    monkeypatch.setattr(byte_pairs, "POOL", 10)
    monkeypatch.setattr(byte_pairs, "BLOCK", 64)
    texts = [f"quxzz{i} vrrbt{i % 3} and more" for i in range(40)]
    assert vocabulary.encode(pa.array(texts))[0].tolist() == [i for t in texts for i in library.encode_ordinary(t)]


def test_op11_matches_the_library(spark, small, library):
    want = {}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall():
        ids = library.encode_ordinary(text or "")
        want[doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = QUERIES["op11_byte_pair_tokens"](spark, small).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_tokens_edge_cases(spark, odd, nothing, vocabulary, library):
    tokens = byte_pairs.encode(odd.withColumnRenamed("key", "Token_IDs"), vocabulary)
    rows = byte_pairs.decode(tokens, vocabulary, into="decoded").collect()
    assert len(rows) == odd.count() and "Token_IDs" not in tokens.columns and set(odd.columns) - {"key"} < set(tokens.columns)
    for r in rows:
        assert r["token_ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert byte_pairs.decode(byte_pairs.encode(nothing, vocabulary), vocabulary).count() == 0
    some = spark.createDataFrame([([1, 2],), (None,), ([],)], "token_ids array<int>")
    assert [r["decoded"] is None for r in byte_pairs.decode(some, vocabulary).collect()] == [False, True, False]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_pairs.decode(spark.createDataFrame([([999_999],)], "token_ids array<int>"), vocabulary).collect()


# --- Vector codes -------------------------------------------------------------------------

def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract, literally, with Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    part = lambda v, p: v[p * w:(p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            chosen = {}
            for _, v, _ in kept:
                chosen.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(chosen[i]) for c in zip(*chosen[i], strict=True)] if i in chosen else e for i, e in enumerate(books[p])]
    out, sums = [], {}
    for i, v, label in kept:
        best = [near(part(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in best), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in rows], SCHEMA)


def test_op12_matches_the_plain_form(spark, small):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{small}/embeddings.parquet'").fetchall()
    got = sorted((tuple(r) for r in QUERIES["op12_vector_codes"](spark, small).collect()), key=str)
    assert got == plain_codes(rows)


def test_codes_edge_cases(spark):
    draw = np.random.default_rng(3)
    rows = [(i // 2, [float(x) for x in draw.normal(size=32).astype(np.float32)], [None, 1, 2][i % 3]) for i in range(90)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[1][1], None), (700, None, 1), (701, [None] + rows[0][1][1:], 1),
             (702, [math.nan] + rows[0][1][1:], 2), (703, [-math.inf] + rows[0][1][1:], 2), (704, [0.0] * 32, 2), (705, [-0.0] * 32, 3)]
    got = sorted((tuple(r) for r in codes.compressed(frame_of(spark, rows)).collect()), key=str)
    assert got == plain_codes(rows)
    # Fewer vectors than entries, none at all, and vectors without components.
    assert sorted((tuple(r) for r in codes.compressed(frame_of(spark, rows[:3])).collect()), key=str) == plain_codes(rows[:3])
    assert codes.compressed(frame_of(spark, rows[:3]).where("false")).count() == 0
    assert {tuple(r)[:4] for r in codes.compressed(frame_of(spark, [(1, [], 1), (2, [], None)])).collect()} == {(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)}
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(frame_of(spark, [(1, [1.0] * 17, 1)]))
    with pytest.raises(Exception, match="share codebooks"):
        codes.compressed(frame_of(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)])).count()


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (3e9, -2e9, 1.5 * i, 7e7 * i)] * 4, 1) for i in range(70)]
    got = sorted((tuple(r) for r in codes.compressed(frame_of(spark, rows)).collect()), key=str)
    want = plain_codes(rows)
    assert [(i, c, h) for i, c, _, _, h in got] == [(i, c, h) for i, c, _, _, h in want]
    for (_, _, error, total, _), (_, _, e, t, _) in zip(got, want, strict=True):
        assert error == (e if e < 1 << 63 else None) and (total == t or t >= 1 << 63 or any(w[2] >= 1 << 63 for w in want))


def test_one_label_holds_nearly_all(spark):
    rows = [(i, [float(i % 7)] * 16, 1 if i % 50 else i) for i in range(3000)]
    got = codes.compressed(frame_of(spark, rows)).toPandas()
    labels = {i: 1 if i % 50 else i for i in range(3000)}
    sums = got.groupby(got.vec_id.map(labels)).error.sum()
    assert (got.label_error == got.vec_id.map(labels).map(sums)).all()


# --- Filter audit ---------------------------------------------------------------------------

def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}  # a null id is nobody's
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first, fails = {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = "".join(f for f, c in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            re.search(r"[#$%&*|]", text) is not None, i is not None and first[text] < i), strict=True) if c)
        fails.append((part or "", failed, i in good, i in toxic))
    out = []
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total, rows = {}, []
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                name, done = order[step - 1], set(order[:step - 1])
                gone = [f for f in own if name in f[1] and not done & set(f[1])]
                failing = sum(name in f[1] for f in own)
                kept = sum(not (done | {name}) & set(f[1]) for f in own)
                total[name] = total.get(name, 0) + len(gone)
                rows.append([part, order, step, kept, len(gone), failing - len(gone), sum(f[1] == name for f in own),
                             sum(f[2] for f in gone), sum(f[3] for f in gone), name])
        out += [(*r[:-1], total[r[-1]]) for r in rows]
    return sorted(out)


def audit_of(spark, docs, labels):
    return filter_audit.audited(
        spark.createDataFrame([(*d, "k", 3, True) for d in docs], "doc_id long, text string, lang string, part string, step int, good boolean"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_audit_matches_the_plain_form(spark, small):
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{small}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{small}/labels.parquet'").fetchall()
    got = QUERIES["op13_filter_audit"](spark, small)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)


def test_audit_edge_cases(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    docs += [(50, "SHOUT", ""), (49, "SHOUT", None), (None, "SHOUT", "en"), (51, "word " * 60_000, "en"), (1, "another text of id 1", "de"),
             (60, None, "fr"), (61, "", "fr"), (62, " \t\n", "fr"), (63, "x\x0by\x1cz\xa0w", "fr")]
    docs += [(1000 + i, "one text again and again", "hot") for i in range(500)]
    labels = [(1, 1, 0), (1, 0, 1), (3, None, 1), (None, 1, 1), (50, 1, None), (1003, 1, 1), (1003, 1, 1), (99_999, 1, 1)]
    assert sorted(tuple(r) for r in audit_of(spark, docs, labels).collect()) == plain_audit(docs, labels)
    assert audit_of(spark, docs, labels).where("false").count() == 0
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audited(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_filter_audit"])
def test_sql_says_the_same(spark, small, name):
    from oracle import compare, duck

    assert compare(QUERIES[name](spark, small), duck(small), ORACLES[name]) == []
