"""Hash matching on hash values only: the first stored hash within reach, in order of insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import blocks

LIMIT = 10


def match_first(queries: DataFrame, stored: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_hash, label, distance, confidence, requires_human_review) for each distinct query.

    Among stored hashes within ``limit`` bits the one inserted first wins, even if another is nearer.
    Queries ask an index of pieces of the stored hashes for all pieces that a hash within reach may have (see
    ``blocks``). A query without a match has null label and needs no review; any match does.
    """
    distinct = queries.select("query_hash").distinct()
    # of equal hashes only the one inserted first can win
    held = stored.withColumn("held", blocks.number(F.col("hash"))).where("held is not null").groupBy("held").agg(F.min(F.struct("position", "label")).alias("e")).select("held", "e.position", "e.label")
    cut = blocks.pieces(held.count(), limit)
    asked = blocks.asking(distinct.withColumn("asked", blocks.number(F.col("query_hash"))).where("asked is not null"), "asked", cut)
    near = asked.join(blocks.entered(held, "held", cut), ["which", "value"]).withColumn("distance", F.bit_count(F.col("asked").bitwiseXOR(F.col("held")))).where(F.col("distance") <= limit)
    first = near.groupBy("query_hash").agg(F.min(F.struct("position", "distance", "label")).alias("m"))
    out = distinct.join(first, "query_hash", "left")
    return out.select("query_hash", "m.label", F.col("m.distance").cast("int").alias("distance"), F.round(1 - F.col("m.distance") / 64, 3).alias("confidence"), F.col("m").isNotNull().alias("requires_human_review"))


def layers(found: DataFrame) -> DataFrame:
    """Result of the layered check; the adapters beyond the local list need approval and stay disabled."""
    return found.withColumn("layer", F.when(F.col("label").isNotNull(), "local").otherwise("none")).withColumn("external_adapters", F.lit("disabled"))


#: Detection adapters; those beyond the local list need an approval that this engine does not have.
ADAPTERS = (("local_database", True), ("photodna", False), ("ncmec", False))


def adapter_status(spark: SparkSession) -> DataFrame:
    """(adapter, status) of every adapter."""
    rows = ", ".join(f"('{name}', '{'active' if on else 'disabled (approval pending)'}')" for name, on in ADAPTERS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(adapter, status)")
