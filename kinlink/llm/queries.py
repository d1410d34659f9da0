"""The registered queries of this subpackage: one thin query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.llm.oracles import ORACLES  # noqa: F401
from kinlink.llm.shared import table


def op1_suffix_array_dedup(spark, sf_dir):
    from kinlink.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op2_token_counts(spark, sf_dir):
    from kinlink.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    from kinlink.llm.quality import score_quality

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op4_embedding_near_dedup(spark, sf_dir):
    from kinlink.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark, sf_dir):
    from kinlink.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark, sf_dir):
    from kinlink.llm.decontam import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark, sf_dir):
    from kinlink.llm.pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


def op8_toxicity(spark, sf_dir):
    from kinlink.llm.toxicity import score_toxicity

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op9_ngram_jaccard_join(spark, sf_dir):
    from kinlink.llm.ngram_join import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    from kinlink.llm.secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_token_counts, op3_quality_classifier, op4_embedding_near_dedup, op5_mixing, op6_decontamination, op7_pii, op8_toxicity, op9_ngram_jaccard_join, op10_secret_scan)}

