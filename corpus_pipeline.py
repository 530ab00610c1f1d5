"""The corpus pipeline: each stage reads what the one before has kept, whole, and leaves the columns of ``documents``.

STAGES lists (name, function); a function takes (spark, docs, directory) and
returns a DataFrame. ``run`` writes every stage's result to the shared folder and
reads it again for the next.
"""

from pyspark.sql import functions as F

from probity.llm import decontaminate, language, mixing, near, shards
from probity.llm.queries import MIX
from probity.llm.registry import table
from probity.llm.shared import stored

#: Bytes that a shard of the finished corpus should have.
SHARD_BYTES = 4 << 20


def language_stage(spark, docs, directory):
    """Without the documents that language identification rejects: null texts, texts without letters, texts far from every language."""
    names = ("__lang", "__cosine", "__rejected")
    told = language.predict(docs, language.fit(docs), names)
    return told.where(~F.col("__rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark, docs, directory):
    """One document of every group of near-duplicates: the one with the smallest doc_id; of repeated rows one."""
    kept = near.near_groups(docs).where("kept").select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).withColumn("__id", F.col("doc_id").cast("long"))
    one = known.join(kept.withColumnRenamed("doc_id", "__id").hint("shuffle_hash"), "__id", "left_semi").dropDuplicates(["__id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()).withColumn("__id", F.lit(None).cast("long"))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark, docs, directory):
    """Without the documents that hold a window of the benchmark.

    Texts are judged, not ids: rows without an id like others, rows of one id apart.
    """
    told = docs.withColumn("__hash", F.xxhash64("text"))
    found = decontaminate.contamination(told.select(F.col("__hash").alias("doc_id"), "text"), table(spark, directory, "benchmark"))
    # Few rows: the hashes of texts with a hit.
    hit = found.where(F.col("n_hit") > 0).select(F.col("doc_id").alias("__hash")).distinct()
    return told.join(hit.hint("shuffle_hash"), "__hash", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark, docs, directory):
    """Documents repeated so that the languages' tokens have the target shares; every document stays."""
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain"))
    there = {r["domain"] for r in labelled.where(F.col("domain").isin(list(MIX))).select("domain").distinct().collect()}
    if not there:  # nothing to learn from: nothing to mix
        return docs
    plan = stored(mixing.mixed(docs, labelled, {k: v for k, v in MIX.items() if k in there}, keep_all=True), "mixing-plan")
    return mixing.applied(docs, plan)


def sharding_stage(spark, docs, directory):
    """Every row's shard and slot; the shards hold about SHARD_BYTES each."""
    return shards.sharded(docs, target_bytes=SHARD_BYTES)


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained models and iterative fits have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, directory):
    docs = table(spark, directory, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, directory), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, directory)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
