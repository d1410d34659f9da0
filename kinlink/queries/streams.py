"""Queries of the streaming extensions, run to completion over all events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinlink.queries import query
from kinlink.sources.store import shared_folder
from kinlink.streaming import live


@query("stream_latest_state", "SELECT user_id AS source_row_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS action, count(*) AS n FROM events GROUP BY 1")
def stream_latest_state(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    log = s.select(F.col("user_id").alias("source_row_id"), F.col("event_type").alias("action"), F.lit("x").alias("operator"), F.col("ts").alias("operated_at"), F.col("event_id").alias("seq"))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # the whole state replaces the last one with every batch: a replay writes the same
    state = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/state")
    live.state_stream(log).writeStream.outputMode("complete").foreachBatch(state).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/state").select("source_row_id", "action", "n")
