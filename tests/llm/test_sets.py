"""Operators on whole tables: shards, mixing, near-duplicates, chats, and the pipeline."""

import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from probity.llm import chat, mixing, near, shards, spans, vectors
from probity.llm.components import components, stars
from probity.llm.queries import QUERIES


def parents(n, links):
    own = list(range(n))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40))
def test_stars_join_what_is_linked(links):
    a, b = np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64)
    node, root = stars(a, b, 21)
    assert parents(21, links) == parents(21, list(zip(node.tolist(), root.tolist(), strict=True)))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards_are_even_and_gapless(spark, small):
    got = QUERIES["op2_sharding"](spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert len(got) == docs.count() and got.shard.between(0, 39).all()
    weights = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert weights.max() - weights.min() <= 2 * got["size"].max()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_a_heavy_text_is_parted_and_light_groups_are_not(spark):
    rows = [(i, "the same text again") for i in range(2000)] + [(10_000 + i, f"text {i // 2} of two" + "x" * (i // 2 % 50)) for i in range(2000)]
    got = shards.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).toPandas()
    weights = got.groupby("shard")["size"].sum()
    assert weights.max() < 1.05 * weights.mean()
    heavy = got[got.doc_id < 10_000]
    assert heavy.shard.nunique() > 1
    light = got[got.doc_id >= 10_000].groupby("text_crc32").shard.nunique()
    assert (light > 1).sum() <= 7


def test_sharding_edge_cases(odd, nothing):
    got = shards.sharded(odd, target_bytes=400)
    assert got.count() == odd.count()
    assert shards.sharded(nothing, shards=4).count() == 0 and shards.sharded(nothing, target_bytes=10).count() == 0
    sizes = {r["doc_id"]: r["size"] for r in got.collect()}
    assert sizes[4] == sizes[5] == 16


def test_mixing_meets_its_targets(spark):
    got = QUERIES["op7_source_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    posterior = np.array(got.posterior.tolist())
    assert np.allclose(posterior.sum(axis=1), 1) and (got.rate >= 0).all()
    shares = (posterior * (got.rate * got.n_tokens).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(shares / shares.sum(), [0.2, 0.4, 0.2, 0.2], atol=1e-3)
    assert ((got.copies - got.rate).abs() < 1).all()


def test_fit_with_rates_at_zero_is_the_constrained_least_squares_solution(spark):
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.3, 0.3, 0.3], 60)
    n = draw.integers(1, 50, 60)
    rows = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double")
    rates, told = mixing.fitted(rows, [1.0, 0.0, 0.0], steps=200)
    own = rates.toPandas()
    assert (own.rate >= 0).all() and (own.rate == 0).any()
    a = (own[["p0", "p1", "p2"]].to_numpy() * own.n_tokens.to_numpy()[:, None])
    slope = (a @ (a.T @ own.rate.to_numpy() - told["targets"])) / own.n_tokens.to_numpy()
    scale = n.sum()
    assert (slope[own.rate > 1e-6] < 0.02 * scale).all() and (slope > -0.02 * scale).all()


def test_mixing_edge_cases(spark, odd, nothing):
    labelled = odd.select("doc_id", "text", F.col("lang").alias("domain"))
    got = mixing.mixed(odd, labelled, {"en": 1, "de": 1})
    assert got.count() == odd.count() and got.where("rate is null or rate < 0").count() == 0
    applied = mixing.applied(odd, got)
    assert applied.columns == odd.columns
    assert mixing.mixed(nothing, labelled, {"en": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(odd, labelled, {"xx": 1})


def test_mixing_with_keep_all_loses_no_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain"))
    plan = mixing.mixed(docs, labelled, {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}, keep_all=True)
    got = plan.toPandas()
    assert (got.rate >= 1).all() and (got.copies >= 1).all()
    totals = (np.array(got.posterior.tolist()) * (got.rate * got.n_tokens).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(totals / totals.sum(), [0.2, 0.4, 0.2, 0.2], atol=1e-3)
    after = corpus_pipeline.mixing_stage(spark, docs, "/root/testdata/sf0.01")
    assert docs.select("doc_id").exceptAll(after.select("doc_id").distinct()).count() == 0
    two = mixing.mixed(docs, labelled, {"de": 0.5, "es": 0.5}, keep_all=True).toPandas()  # unnamed domains stay, too
    assert (two.copies >= 1).all()
    shares = (np.array(two.posterior.tolist()) * (two.rate * two.n_tokens).to_numpy()[:, None]).sum(axis=0)
    assert shares[0] == pytest.approx(shares[2], rel=2e-3)


def plain_groups(rows, weights):
    sets, first, links = [], {}, []
    for k, (doc, text) in enumerate(rows):
        raw = text.encode()
        _, shingle, count = near.shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        sets.append((shingle, (count * weights[near._bucket(shingle)]).astype(np.float32)))
        own = (shingle.tobytes(), count.tobytes()) if len(shingle) else raw
        if own in first:
            links.append((first[own], k))
        first.setdefault(own, k)
    for i in range(len(sets)):
        links += [(j, i) for j in range(i) if len(sets[i][0]) and len(sets[j][0]) and near.weighted_jaccard(*sets[i], *sets[j]) >= near.SIMILARITY]
    return [rows[k][0] for k in parents(len(rows), links)]


def test_near_duplicates_against_brute_force(spark, documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    draw = np.random.default_rng(11)
    base = [str(draw.integers(0, 10**6)) for _ in range(120)]
    chain = 100_000
    for step in range(12):  # a chain whose ends are not alike
        base = [*base[:step * 8], *(f"new{step}w{k}" for k in range(6)), *base[step * 8 + 6:]]
        rows.append((chain + step, " ".join(base)))
    rows += [(200_000, ""), (200_001, ""), (200_002, "!!"), (200_003, "one two"), (200_004, "One, TWO!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["group_id"] for r in near.near_groups(docs).collect()}
    want = plain_groups(rows, near.rarity(docs))
    assert [got[doc] for doc, _ in rows] == want
    assert got[chain + 11] == chain and got[200_001] == 200_000 and got[200_002] == 200_002 and got[200_004] == 200_003


def test_large_groups_in_blocks_give_the_same(spark, monkeypatch):
    draw = np.random.default_rng(2)
    base = [str(x) for x in draw.integers(0, 10**6, 100)]
    rows = []
    for k in range(60):
        own = list(base)
        own[k] = f"other{k}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "BLOCK", 8)
    whole = {r["doc_id"]: r["group_id"] for r in near.near_groups(docs).collect()}
    monkeypatch.setattr(near, "COMPONENT", 4)
    parted = {r["doc_id"]: r["group_id"] for r in near.near_groups(docs).collect()}
    assert whole == parted == dict.fromkeys(range(60), 0)


def test_near_duplicate_edge_cases(odd, nothing):
    got = near.near_groups(odd).collect()
    assert len(got) == odd.count()
    assert {r["group_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert all(r["kept"] for r in got if r["doc_id"] in (None, 4))
    assert near.near_groups(nothing).count() == 0


def plain_vectors(rows, threshold=0.98):
    able = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and len(v) and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for i in able:
        for j in able:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links.append((i, j))
    counts = np.bincount([x for pair in links for x in pair], minlength=len(rows))
    return [(rows[k][0], int(counts[k]), rows[p][0]) for k, p in enumerate(parents(len(rows), links))]


def test_vectors_against_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + draw.normal(size=16) * 0.08).astype(np.float32).tolist(), k % 3 if k % 11 else None) for k in range(400)]
    rows += [(500 + k, rows[0][1], rows[0][2] if k % 2 else 1) for k in range(30)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] * 16, 1), (604, [], 1), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    got = vectors.near_vectors(df, leaf=40)
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id").collect())) == sorted(plain_vectors(rows))
    assert got.where("kept != (vec_id = component_id)").count() == 0


def test_vector_edge_cases(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1e300, 0.0], 1), (3, [1.0, 0.0], None)],
                               "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect())
    assert got == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert vectors.near_vectors(df.where("false")).count() == 0


TURNS = [(1, 0, "user", "hi <|assistant|>\n</s>"), (1, 1, "assistant", "[INST] \\ <\\| <\\\\|</s>"), (1, 2, "assistant", None), (2, 5, None, "no role"),
         (None, 0, "user", "no conversation"), (3, 1, "assistant", "é日本"), (3, 0, "a|>\nb", ""), (3, 1, "assistant", "é日本")]


def test_chats_come_back_as_they_were(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.written_digests(df).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: t[1])
        turns = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (
            len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.written_digests(df.where("false")).count() == 0


def test_all_conversations_are_formatted(spark, small):
    got = QUERIES["op6_chat_formatting"](spark, small)
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    assert got.agg(F.sum("n_turns")).head()[0] == turns.count() + 2
    assert got.where("conv_id = -1").head()["loss_chars"] == len("</s>[INST] ok [/INST]")


@given(st.lists(st.tuples(st.text("<[|\\>/sINT]é\n ", max_size=12), st.text(max_size=8)), min_size=1, max_size=8))
def test_no_mark_is_left_in_a_text(pairs):
    import pyarrow as pa

    pairs = [(a.encode("utf-8", "ignore").decode(), b.encode("utf-8", "ignore").decode()) for a, b in pairs]
    out, _, _ = chat.formatted_batch(pa.array([b for _, b in pairs]), pa.array([a for a, _ in pairs]))
    for (text, role), made in zip(pairs, out.to_pylist(), strict=True):
        assert chat.parsed(made) == (role, text)
        assert made.count("</s>") == made.count("<|") == made.count("|>") == 1 and "[INST]" not in made


def test_pipeline_stages(spark, odd, nothing):
    directory = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, directory)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        if name != "source_mixing":
            assert after.exceptAll(kept).count() == 0
            assert after.count() > 0.85 * kept.count()
        kept = after
    ids = {r["doc_id"] for r in kept.collect()}
    groups = near.near_groups(docs).where("doc_id = group_id").select("doc_id")
    assert ids <= {r["doc_id"] for r in groups.collect()}
    last = corpus_pipeline.sharding_stage(spark, kept, directory)
    assert last.count() == kept.count()
    for table in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, directory).columns == table.columns, name
            assert stage(spark, nothing, directory).count() == 0


def test_decontamination_stage_judges_every_row_by_its_text(spark):
    directory = "/root/testdata/sf0.001"
    passage = spark.read.parquet(f"{directory}/benchmark.parquet").orderBy(F.length("text").desc()).head()["text"]
    docs = spark.createDataFrame([(None, f"before {passage} after"), (None, "clean"), (1, "clean, too"), (1, passage), (2, None)], "doc_id long, text string")
    got = corpus_pipeline.decontamination_stage(spark, docs, directory).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.where("text is null or text like 'clean%'").collect())


def test_spans_never_cross_rows():
    data = np.frombuffer(b"aabb", np.uint8)
    starts, ends, row = spans.runs(np.ones(4, bool), np.array([0, 2, 2, 4]))
    assert list(zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True)) == [(0, 2, 0), (2, 4, 2)]
    one = spans.span_hashes(data, np.array([0, 2]), np.array([2, 4]))
    assert one[0] != one[1]
