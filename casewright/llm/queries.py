"""The thin queries ``opN_<name>``: each applies its operator to the whole table and derives digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import bytebpe, embeddings, licenses, packing, pii, quality, reassembly, repair, secret_scan, simhash, suffixes, url_filter, warc
from .oracle import ORACLE_SQL as ORACLE_SQL


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, url_filter.QUERY_RULES))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no file names: ids stand for a tree of two levels below each source, in which the
    first document of a directory is its licence file."""
    k = F.col("doc_id")
    outer, inner = F.concat(F.lit("d"), F.expr("doc_id div 256").cast("string")), F.concat(F.lit("d"), F.expr("doc_id div 16").cast("string"))
    path = F.concat_ws("/", "source", outer, F.when(k % 256 != 0, inner), F.when(k % 16 == 0, "LICENSE").otherwise(F.concat(k.cast("string"), F.lit(".txt"))))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(number, pii.BASE), F.sha2(pii.shown(base), 256).alias("base_sha256"), pii.shown(F.col("spans")).alias("spans"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    coded = bytebpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = bytebpe.decode(coded, ranks)
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*secret_scan.BASE_KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(number, secret_scan.BASE_KINDS), F.sha2(secret_scan.shown(base), 256).alias("base_sha256"), secret_scan.shown(spans).alias("spans"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassembly.digested(reassembly.reassemble(reassembly.arrivals(table(spark, sf_dir, "conversations"))))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_embeddings": op5_embeddings,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_secrets": op9_secrets,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_reassembly": op11_reassembly,
    "op12_repair": op12_repair,
    "op13_warc": op13_warc,
}