"""Streams: source rows matched as they arrive, and review states as they change.

Extensions: what they compute per batch is what the batch plans compute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.config import MatchConfig
from kinlink.plans import matching


def match_stream(stream: DataFrame, target: DataFrame, config: MatchConfig, sink: Callable[[DataFrame, DataFrame, int], None], source_ordinal: str, target_ordinal: str, checkpoint: str, **trigger):
    """Starts a query that matches each micro-batch against the catalog and hands (items, candidates, epoch) to `sink`; a sink that overwrites by epoch makes replays harmless."""

    def one(batch: DataFrame, epoch: int) -> None:
        sink(*matching.match(batch, target, config, source_ordinal, target_ordinal), epoch)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def state_stream(log: DataFrame) -> DataFrame:
    """Latest action of each row of a review log; for update or complete output."""
    return log.groupBy("source_row_id").agg(F.max_by(F.struct("action", "operator", "operated_at"), F.struct("operated_at", "seq")).alias("r"), F.count("*").alias("n")).select("source_row_id", "r.action", "r.operator", "r.operated_at", "n")


def activity_stream(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Reviews by action in event-time windows; later rows than the watermark allows are left out."""
    return log.withWatermark("operated_at", late).groupBy(F.window("operated_at", width), "action").agg(F.count("*").alias("n")).select("window.start", "action", "n")
