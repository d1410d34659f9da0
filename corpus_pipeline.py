"""From raw documents to a training mixture, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. run() writes what
a stage returns as Parquet to the shared folder and hands it, reread, to the
next; a lost executor costs at most the stage that was running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinlink.llm import decontam, mixing, ngram_join, secrets, toxicity
from kinlink.llm.shared import cut, remove, shared_folder, table


def drop_toxic(spark, docs, sf_dir):
    """Drops documents with a toxicity of 0.3 or more; keeps all where the labels lack a class and no model can be trained."""
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), learn, untrained=0.0, out="__kl_toxicity").where("__kl_toxicity < 0.3").drop("__kl_toxicity")


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps one row of every group of linked rows: of the smallest doc_id (null: after all others), then of the smallest key.

    Rows are told apart by a 64-bit digest of doc_id and text, so texts under
    one doc_id are judged one by one. Rows without words link with nothing and stay.
    """
    key = "__kl_key"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = ngram_join.near_duplicate_groups(keyed.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0")
    rows = groups.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("n")).withColumnRenamed("doc_id", key)
    rows = cut(rows.join(keyed.select(key, "doc_id").distinct(), key))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)).alias("best"), F.count("*").alias("keys")).where("keys > 1")
    gone = rows.join(best, "component").where(f"{key} <> best.{key}").select(key)
    kept = keyed.join(gone, key, "left_anti")
    again = rows.where("n > 1").select(key)
    if not again.isEmpty():
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Drops documents that hold a window of a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Replaces secrets in the texts; n_chars follows."""
    done = secrets.redact(secrets.find_secrets(docs, out="__kl_secrets"), spans="__kl_secrets").select(docs.columns)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else done


def mix(spark, docs, sf_dir):
    """What the mixture takes of each document: taken words and copies, 0 for those left out."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("decontamination", drop_contaminated), ("secret_scan", redact_secrets), ("mixing", mix)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what a stage wrote goes once the next one has written."""
    docs = table(spark, sf_dir, "documents")
    home, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
