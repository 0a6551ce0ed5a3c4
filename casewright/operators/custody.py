"""Tamper-evident custody log: chain hashes, verification, evidence ids and manifests.

The hash of an entry covers all its fields and the hash before it. Building a chain is a fold, which
streams over the sorted entries; verification is not: every link and every content hash is recomputed in
parallel. A log is sharded by chain (one per case), so nothing spans more than one chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256 as digest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import json_text

GENESIS = "0" * 64
# The fields that the hash of an entry covers, besides the hash before it, in order of name.
CONTENT = ("action", "analyst", "artifact_id", "case_id", "notes", "sha256", "target_id", "timestamp")
NUMBERS = ("artifact_id", "target_id")


def canonical(log: DataFrame) -> tuple[Column, Column]:
    """An entry as compact JSON in ASCII, keys in order, nulls kept: the parts before and after the value
    of the previous hash. A field that the log does not have is null."""

    def shown(name: str) -> Column:
        if name not in log.columns:
            return F.lit("null")
        return F.coalesce(F.col(name).cast("long").cast("string") if name in NUMBERS else json_text(F.col(name).cast("string")), F.lit("null"))

    def fields(names: tuple[str, ...]) -> Column:
        return F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), shown(n)) for n in names))

    cut = CONTENT.index("notes") + 1
    return F.concat(F.lit("{"), fields(CONTENT[:cut]), F.lit(',"previous_hash":')), F.concat(F.lit(","), fields(CONTENT[cut:]), F.lit("}"))


def build_chain(log: DataFrame, chain: str = "case_id", known: DataFrame | None = None) -> DataFrame:
    """``log`` with previous_hash and entry_hash, chained by log_id within ``chain``.

    Chains go on from the last hashed entry of ``known``, a log that is chained already, else from the
    genesis hash. Entries of a chain are hashed one after the other as they stream by, whatever their number.
    """
    names = log.columns
    start = F.lit(GENESIS)
    rows = log
    if known is not None:
        last = known.where("entry_hash is not null").groupBy(F.col(chain).alias("__chain")).agg(F.max_by("entry_hash", "log_id").alias("__last"))
        rows = rows.join(last, F.col(chain).eqNullSafe(F.col("__chain")), "left")
        start = F.coalesce("__last", start)
    head, tail = canonical(log)
    rows = rows.select(*names, F.col(chain).cast("string").alias("__key"), start.alias("__start"), head.alias("__head"), tail.alias("__tail"))
    rows = rows.repartition(chain).sortWithinPartitions(chain, "log_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str | None] | None = None
        last = GENESIS
        for batch in batches:
            before, hashes = [], []
            for key, start, head, tail in zip(*(batch.column(len(names) + k).to_pylist() for k in range(4)), strict=True):
                if now != (key,):
                    now, last = (key,), start
                before.append(last)
                last = digest(f'{head}"{last}"{tail}'.encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[*names, "previous_hash", "entry_hash"])

    schema = T.StructType([*log.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    return rows.mapInArrow(run, schema)


#: Entries that a range of log_id holds when a log is cut for verification.
RANGE = 50_000


def verify_chain(log: DataFrame, chain: str = "case_id", entries: int = RANGE) -> DataFrame:
    """One row per chain: intact, entries checked, the first broken entry and why.

    At each entry the link is tested first, then the content. Rows without a hash are older than the
    chain and are left out.

    The log is cut into ranges of log_id of about ``entries`` rows. Links within a range are tested there, so one
    chain of any length spreads over all tasks; what a range needs from others, the last hash before it and
    the number of entries before it, comes from a table of one row per chain and range.
    """
    rows = log.where("entry_hash is not null")
    span = rows.agg(F.min("log_id").alias("low"), F.max("log_id").alias("high"), F.count("*").alias("n")).first()
    ranges = max(1, span.n // entries)
    width = 1 if span.n == 0 else (span.high - span.low) // ranges + 1
    # contents are hashed before the rows are dealt, and only the verdict travels with them
    head, tail = canonical(rows)
    content = F.sha2(F.concat(head, F.coalesce(json_text(F.col("previous_hash")), F.lit("null")), tail), 256) == F.col("entry_hash")
    rows = rows.select(F.col(chain).alias("chain"), F.expr(f"(log_id - {span.low or 0}) div {width}").alias("part"), "log_id", "previous_hash", "entry_hash", content.alias("same"))
    within = Window.partitionBy("chain", "part").orderBy("log_id")
    rows = rows.withColumn("expected", F.lag("entry_hash").over(within)).withColumn("position", F.row_number().over(within))
    broken = F.when((F.col("position") > 1) & ~F.col("previous_hash").eqNullSafe(F.col("expected")), "broken link").when(~F.col("same"), "content does not match its hash")
    found = rows.groupBy("chain", "part").agg(
        F.count("*").alias("n"), F.min(F.struct("position", "log_id", "previous_hash")).alias("first"), F.max_by("entry_hash", "position").alias("last"),
        F.min(F.when(broken.isNotNull(), F.struct("position", "log_id", broken.alias("why")))).alias("bad"),
    )
    along = Window.partitionBy("chain").orderBy("part")
    found = found.withColumn("expected", F.lag("last", 1, GENESIS).over(along)).withColumn("before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bad = F.when(~F.col("first.previous_hash").eqNullSafe(F.col("expected")), F.struct(F.col("first.position").alias("position"), F.col("first.log_id").alias("log_id"), F.lit("broken link").alias("why"))).otherwise(F.col("bad"))
    placed = found.select("chain", "n", F.when(bad.isNotNull(), F.struct((F.col("before") + bad["position"]).alias("position"), bad["log_id"].alias("log_id"), bad["why"].alias("why"))).alias("bad"))
    out = placed.groupBy("chain").agg(F.sum("n").alias("entries"), F.min("bad").alias("bad"))
    return out.select(F.col("chain").alias(chain), F.col("bad").isNull().alias("intact"), F.coalesce(F.col("bad.position") - 1, F.col("entries")).cast("long").alias("entries_checked"), F.col("bad.log_id").alias("broken_log_id"), F.col("bad.why").alias("reason"))


def uuid5(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Name-based version-5 UUID as text; the default namespace is the one for URLs."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def evidence_id(artifact_id: Column, sha256: Column) -> Column:
    return uuid5(F.concat_ws(":", artifact_id.cast("string"), sha256))


def valid_evidence(sha256: Column, source: Column, collector: Column) -> Column:
    """Whether a record has a 64-digit hash and named source and collector."""
    named = lambda c: F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", "") != "", F.lit(False))
    return F.coalesce(sha256.rlike("^[0-9a-fA-F]{64}$"), F.lit(False)) & named(source) & named(collector)


def manifest(targets: DataFrame, artifacts: DataFrame, custody: DataFrame) -> DataFrame:
    """One row per artifact with its evidence id, case, hash and the number and last time of the case's
    custody events. Events meet the targets, so artifacts with their hashes move once, to their targets."""
    events = custody.groupBy("case_id").agg(F.count("*").alias("custody_events"), F.max("timestamp").alias("last_event"))
    rows = artifacts.join(targets.select("target_id", "case_id", "platform").join(events, "case_id", "left"), "target_id")
    return rows.select("case_id", "artifact_id", evidence_id(F.col("artifact_id"), F.col("sha256")).alias("evidence_id"), "platform", "sha256", F.coalesce("custody_events", F.lit(0).cast("long")).alias("custody_events"), "last_event")


def verify_package(manifest_rows: DataFrame, actual: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Status of every file of a manifest and of files beyond it: ok, altered, missing or unlisted."""
    held = actual.select(key, F.col("sha256").alias("actual_sha256"))
    rows = manifest_rows.select(key, "sha256").join(held, key, "full")
    status = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("actual_sha256").isNull(), "missing").when(F.col("sha256") == F.col("actual_sha256"), "ok").otherwise("altered")
    return rows.select(key, status.alias("status"))


def custody_manifest(targets: DataFrame, artifacts: DataFrame, custody: DataFrame) -> DataFrame:
    """One row per artifact (case_id, artifact_id, evidence_id, platform, module_name, artifact_type, sha256,
    collected_at, custody_events): its evidence record with every custody event on it, in order of log_id."""
    event = F.struct("log_id", F.col("timestamp").cast("string").alias("timestamp"), "action", "analyst", "notes")
    events = custody.where("artifact_id is not null").groupBy("artifact_id").agg(F.array_sort(F.collect_list(event)).alias("custody_events"))
    rows = artifacts.join(targets.select("target_id", "case_id", "platform"), "target_id").join(events, "artifact_id", "left")
    listed = F.coalesce("custody_events", F.array().cast(events.schema["custody_events"].dataType))
    return rows.select("case_id", "artifact_id", evidence_id(F.col("artifact_id"), F.col("sha256")).alias("evidence_id"), "platform", "module_name", "artifact_type", "sha256", "collected_at", listed.alias("custody_events"))


def manifest_header(manifest_rows: DataFrame, notes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per case: number of artifacts, events and notes, and whether its chain withstood
    verification; a case without a chain says that none is available."""
    sizes = manifest_rows.groupBy("case_id").agg(F.count("*").alias("artifact_count"), F.sum(F.size("custody_events")).alias("event_count"))
    written = notes.groupBy("case_id").agg(F.count("*").alias("note_count"))
    rows = sizes.join(written, "case_id", "left").join(verdicts, "case_id", "left")
    return rows.select("case_id", "artifact_count", "event_count", F.coalesce("note_count", F.lit(0).cast("long")).alias("note_count"), F.col("intact").isNotNull().alias("chain_available"), F.col("intact").alias("chain_intact"), F.col("entries_checked").alias("chain_entries"))


def sealed_package(files: DataFrame, version: str = "1.0") -> DataFrame:
    """(case_id, manifest, manifest_sha256) from files (case_id, file_name, sha256): the manifest lists the
    files in order with their hashes, and its own hash seals it."""
    rows = files.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("file_name", "sha256"))).alias("files"))
    body = F.to_json(F.struct("case_id", "files", F.lit(version).alias("package_version")))
    return rows.select("case_id", body.alias("manifest"), F.sha2(body, 256).alias("manifest_sha256"))


def seal_holds(packages: DataFrame) -> DataFrame:
    """(case_id, intact): whether each manifest still has the hash that its seal records."""
    return packages.select("case_id", F.coalesce(F.sha2("manifest", 256) == F.col("manifest_sha256"), F.lit(False)).alias("intact"))
