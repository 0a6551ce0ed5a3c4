"""Readers of collected files: tolerant JSON payloads, text lists, file listings, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def payloads(artifacts: DataFrame, schema: str | T.StructType, column: str = "raw_data") -> DataFrame:
    """``artifacts`` with the JSON of ``column`` as struct ``payload``; rows that hold no object are left out."""
    return artifacts.withColumn("payload", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})).where(F.col(column).rlike(r"^\s*\{") & F.col("payload").isNotNull())


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``value``."""
    return spark.read.text(path)


#: Keys that an entry of the network authority may have.
ENTRY_KEYS = ("asn", "organization", "category", "source", "confidence")


def authority(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a network authority file, an object with ``asns`` or a bare list, with their position and
    ``extra_keys``, the keys that an entry should not have."""
    whole = spark.read.text(path, wholetext=True)
    # entries stay texts at first, so that unknown keys are seen
    listed = F.coalesce(F.from_json("value", "asns array<string>")["asns"], F.from_json("value", "array<string>"))
    rows = whole.select(F.posexplode(listed).alias("position", "raw"))
    entry = F.from_json("raw", ", ".join(f"{k} string" for k in ENTRY_KEYS))
    extra = F.array_except(F.json_object_keys("raw"), F.array(*map(F.lit, ENTRY_KEYS)))
    return rows.select("position", entry.alias("e"), F.coalesce(extra, F.array().cast("array<string>")).alias("extra_keys")).select("position", "e.*", "extra_keys")


def file_records(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Files below ``path`` whose name starts with ``prefix``: name, size and content hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("file_name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).where(F.col("file_name").startswith(prefix))


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows to a Parquet table; readers see complete commits only."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines with nulls kept, replacing the folder."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
