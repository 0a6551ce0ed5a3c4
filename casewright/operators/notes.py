"""Analyst notes: validated, stripped, and recorded in the custody log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _stripped(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"^\s+|\s+$", "")


def valid(notes: DataFrame) -> DataFrame:
    """Notes with a case, an analyst and content, the content stripped; the others are left out."""
    return notes.where(F.col("case_id").isNotNull() & (F.coalesce("analyst", F.lit("")) != "") & (_stripped("note") != "")).withColumn("note", _stripped("note"))


def custody_rows(notes: DataFrame) -> DataFrame:
    """The entries that valid notes leave in the custody log, ready to be chained in order of ``log_id``."""
    text = F.concat(
        F.lit("note "), F.col("note_id").cast("string"), F.when(F.coalesce("finding_ref", F.lit("")) != "", F.concat(F.lit(" on finding "), F.col("finding_ref"))).otherwise(""),
        F.when(F.col("target_id").isNotNull(), F.concat(F.lit(" (target "), F.col("target_id").cast("string"), F.lit(")"))).otherwise(""),
    )
    return valid(notes).select(F.col("note_id").alias("log_id"), F.col("created_at").alias("timestamp"), F.lit("analyst_note_added").alias("action"), "case_id", "analyst", text.alias("notes"))


def of_finding(notes: DataFrame, case_id, finding_ref: str | None = None) -> DataFrame:
    """Notes of a case, of one finding if it is named, by number."""
    rows = notes.where(F.col("case_id") == case_id)
    return (rows if finding_ref is None else rows.where(F.col("finding_ref") == finding_ref)).orderBy("note_id")


def audit_events(rows: DataFrame, event: str, *fields: str) -> DataFrame:
    """Rows as events of the audit log (event, case_id, analyst, details as JSON); hashes are cut to
    sixteen digits, missing analysts are the system. Alerts and escalations are warnings."""
    short = lambda c: F.when(F.length(c) > 16, F.concat(F.substring(c, 1, 16), F.lit("..."))).otherwise(F.col(c))
    details = F.to_json(F.struct(*((short(f) if f == "sha256" else F.col(f)).alias(f) for f in fields)))
    analyst = F.col("analyst") if "analyst" in rows.columns else F.lit(None).cast("string")
    level = "warning" if event in ("tier2_alert", "tier3_escalation") else "info"
    return rows.select(F.lit(event).alias("event"), F.lit(level).alias("level"), "case_id", F.coalesce(analyst, F.lit("system")).alias("analyst"), details.alias("details"))
