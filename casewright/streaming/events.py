"""Streaming forms of batch operators, an extension: the reference has no streams.

Both functions take streaming or batch DataFrames; callers choose sink and trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.classifier import RulePack, message_hits


def flagged_messages(messages: DataFrame, rules: RulePack | None = None) -> DataFrame:
    """Messages (profile_id, message_index, text) with a hit in any category; stateless."""
    hits = message_hits(messages, rules)
    names = [c for c in hits.columns if c not in ("profile_id", "message_index", "silenced")]
    total = sum((F.col(c) for c in names), F.lit(0))
    return hits.withColumn("hits", total).where("hits > 0").select("profile_id", "message_index", "hits")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
