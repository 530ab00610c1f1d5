"""One query for every operator, over its whole table."""

from pyspark.sql import functions as F

from . import (
    audit_sql, byte_pairs, chat, codes, decontaminate, filter_audit, language, mixing, near, quality, repeats, shards, token_files, vectors,
)
from .registry import ORACLES, QUERIES, register, table

__all__ = ["ORACLES", "QUERIES"]


def crc_of_id(df):
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@register("op1_quality_classifier")
def op1_quality_classifier(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_of_id(docs) % 3 == 1, F.lit(False))
    model = quality.fit(docs, table(spark, directory, "labels").where(~held_out))
    return quality.score(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


@register("op5_language_id")
def op5_language_id(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_of_id(docs) % 5 == 0, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


@register("op10_token_files")
def op10_token_files(spark, directory):
    import public_tokenizers

    return token_files.written_digests(
        table(spark, directory, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257)


@register("op4_decontamination")
def op4_decontamination(spark, directory):
    return decontaminate.digests(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@register("op2_sharding")
def op2_sharding(spark, directory):
    return shards.sharded(table(spark, directory, "documents"), shards=40)


#: The contract's extra conversation.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@register("op6_chat_formatting")
def op6_chat_formatting(spark, directory):
    turns = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    return chat.written_digests(turns.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")))


@register("op9_embedding_neighbours")
def op9_embedding_neighbours(spark, directory):
    return vectors.near_vectors(table(spark, directory, "embeddings"))


@register("op8_minhash_near_duplicates")
def op8_minhash_near_duplicates(spark, directory):
    return near.near_groups(table(spark, directory, "documents"))


#: Shares of the tokens that the languages are mixed to.
MIX = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


@register("op7_source_mixing")
def op7_source_mixing(spark, directory):
    docs = table(spark, directory, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    return mixing.mixed(docs, docs, MIX)


@register("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark, directory):
    return repeats.without_repeats(table(spark, directory, "documents"))


@register("op11_byte_pair_tokens")
def op11_byte_pair_tokens(spark, directory):
    import public_tokenizers

    return byte_pairs.digests(table(spark, directory, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@register("op12_vector_codes", audit_sql.CODES)
def op12_vector_codes(spark, directory):
    return codes.compressed(table(spark, directory, "embeddings"))


@register("op13_filter_audit", audit_sql.FILTERS)
def op13_filter_audit(spark, directory):
    return filter_audit.audited(table(spark, directory, "documents"), table(spark, directory, "labels"))
