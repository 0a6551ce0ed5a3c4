"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes all that its predecessor kept and hands on whole rows of ``documents``; its decisions
take effect on the rows or their texts. ``run`` writes every stage's result as Parquet in the shared
scratch folder and rereads it, so a lost executor never costs more than one stage. The stages take
empty tables, nulls, repeated rows and extra columns as their operators do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewright.llm import packing, quality, secret_scan, simhash, suffixes
from casewright.operators.scratch import Scratch
from casewright.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that failed."""
    return _counted(quality.keep_good(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one of smallest id.

    Rows of one id are documents of their own, in the order of their texts and other columns, so only a
    near copy of another row ever goes. Rows without an id stay as they are.
    """
    named = docs.where("doc_id is not null")
    if not _repeats(named):
        kept = named.join(_first_of_each(named, "doc_id"), "doc_id", "left_semi").select(*docs.columns)
    else:
        number = "number"
        while number in docs.columns:
            number += "_"
        order = [F.col("doc_id"), F.col("text"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))))]
        rows = Scratch(spark, "numbered").keep(named.orderBy(*order).withColumn(number, F.monotonically_increasing_id()), "rows")
        kept = rows.join(_first_of_each(rows, number), number, "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def _first_of_each(docs: DataFrame, key: str) -> DataFrame:
    """The keys, unique in ``docs``, of the documents that stand for their components."""
    found = simhash.near_duplicates(docs, key).where("doc_id = component_id")
    return found.select(F.col("doc_id").cast(docs.schema[key].dataType).alias(key))


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier 100-byte string; emptied documents go.

    A cut inside a multi-byte character drops the rest of that character.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = suffixes.remove_repeats(docs, carry=others, texts=True)
    found = found.where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    return _counted(found.select("doc_id", "text", "row.*").select(*docs.columns))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret span replaced by a mark."""
    return _counted(secret_scan.mask_column(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, with the digest of their ids."""
    import public_tokenizers

    packed = packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, brought up to date with the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("pack_sequences", pack_sequences),
]

#: Fingerprints, repeats, lexing and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.sweep()
        docs = kept
    return docs
