"""Retention: which cases are due, what a purge would remove, and the purge as a new table version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def due(cases: DataFrame, as_of: str, days: int, created: str = "created_at", exempt: Column | None = None) -> DataFrame:
    """Cases older than ``days`` at ``as_of``, with their age in whole days. A case whose time cannot be
    read is not due; ``exempt`` marks cases that stay whatever their age."""
    at = F.try_to_timestamp(F.col(created))
    rows = cases.withColumn("age_days", F.floor((F.to_timestamp(F.lit(as_of)).cast("long") - at.cast("long")) / 86400).cast("long"))
    old = at < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    return rows.where(F.coalesce(old, F.lit(False)) & (F.lit(True) if exempt is None else ~exempt))


def dry_run(due_cases: DataFrame, targets: DataFrame, artifacts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per due case the rows that a purge would remove. Nothing is changed."""
    mine = targets.join(due_cases.select("case_id"), "case_id", "left_semi").select("target_id", "case_id")

    def number(rows: DataFrame, name: str) -> DataFrame:
        return mine.join(rows.groupBy("target_id").agg(F.count("*").alias("n")), "target_id").groupBy("case_id").agg(F.sum("n").alias(name))

    out = due_cases.select("case_id", "age_days").join(mine.groupBy("case_id").agg(F.count("*").alias("targets")), "case_id", "left")
    out = out.join(number(artifacts, "artifacts"), "case_id", "left").join(number(analyses, "analyses"), "case_id", "left")
    return out.na.fill(0, ["targets", "artifacts", "analyses"])


def purge_event(due_cases: DataFrame, as_of: str, analyst: str) -> DataFrame:
    """The custody rows that must be written before anything is removed."""
    return due_cases.select("case_id", F.lit("retention_purge").alias("action"), F.lit(as_of).alias("timestamp"), F.lit(analyst).alias("analyst"))


def purged(due_cases: DataFrame, cases: DataFrame, targets: DataFrame, artifacts: DataFrame, analyses: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table. The custody log is never part of a purge; callers commit its rows first,
    then write these as a new version, children before parents."""
    gone = due_cases.select("case_id")
    lost = targets.join(gone, "case_id", "left_semi").select("target_id")
    return {
        "artifacts": artifacts.join(lost, "target_id", "left_anti"),
        "analyses": analyses.join(lost, "target_id", "left_anti"),
        "targets": targets.join(gone, "case_id", "left_anti"),
        "cases": cases.join(gone, "case_id", "left_anti"),
    }
