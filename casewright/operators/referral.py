"""Referral summaries of cases, redacted unless asked otherwise. Nothing is ever filed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .redaction import redact_frame
from .reporting import first_per, tier


def referral(cases: DataFrame, targets: DataFrame, analyses: DataFrame, artifacts: DataFrame, redacted: bool = True, protected: tuple[str, ...] = (), policy: str = "standard") -> DataFrame:
    """One row per case: subjects with their latest score, highest score and tier, evidence and notice.

    Handles of the subjects and scores are kept; all other text is masked.
    """
    latest = first_per(analyses, ["target_id"], F.desc("analyzed_at"), F.desc("result_id"), F.desc_nulls_last("risk_score")).select("target_id", "risk_score")
    subjects = targets.join(latest, "target_id", "left").groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("target_id", "platform", "username", "risk_score"))).alias("subjects"), F.max("risk_score").alias("max_score")
    )
    evidence = targets.select("target_id", "case_id").join(artifacts, "target_id").groupBy("case_id").agg(F.count("*").alias("artifacts"), F.count_distinct("sha256").alias("distinct_hashes"))
    out = cases.join(subjects, "case_id", "left").join(evidence, "case_id", "left")
    out = out.withColumns({"tier": tier(F.col("max_score")), "notice": F.lit("lead for human review; filing is a human decision")})
    return redact_frame(out, protected, policy, keep=("subjects", "notice")) if redacted else out


def document(cases: DataFrame, targets: DataFrame, analyses: DataFrame, artifacts: DataFrame, packages: DataFrame | None = None, redacted: bool = True, protected: tuple[str, ...] = (), policy: str = "standard") -> DataFrame:
    """One row per case with the five sections of a referral: reporting, incident, subjects, supporting
    evidence, and provenance. ``packages`` (case_id, manifest_sha256) are sealed packages; a case without
    one says so. Text is masked unless asked otherwise; hashes and times stay, they are how a recipient
    checks the evidence."""
    optional = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    newest = F.max(F.struct("analyzed_at", "result_id", "risk_score", optional(analyses, "analysis_type").alias("analysis_type"))).alias("x")
    latest = analyses.groupBy("target_id").agg(newest).select("target_id", "x.risk_score", "x.analysis_type")
    subject = F.struct("target_id", "platform", F.col("username").alias("reported_username"), optional(targets, "platform_user_id").alias("platform_user_id"), "risk_score", F.col("analysis_type").alias("assessment_type"))
    subjects = targets.join(latest, "target_id", "left").groupBy("case_id").agg(F.array_sort(F.collect_list(subject)).alias("subjects"), F.max("risk_score").alias("highest"))
    item = F.struct("artifact_id", optional(artifacts, "module_name").alias("collected_by_module"), optional(artifacts, "artifact_type").alias("artifact_type"), "sha256", optional(artifacts, "collected_at").alias("collected_at"))
    evidence = artifacts.join(targets.select("target_id", "case_id"), "target_id").groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("artifacts"))
    out = cases.join(subjects, "case_id", "left").join(evidence, "case_id", "left")
    out = out.withColumn("sealed", F.lit(None).cast("string")) if packages is None else out.join(packages.select("case_id", F.col("manifest_sha256").alias("sealed")), "case_id", "left")
    none = F.coalesce("artifacts", F.array().cast(out.schema["artifacts"].dataType))
    out = out.select(
        "case_id", F.struct(F.lit("open-source lead for review by a person").alias("context"), optional(cases, "case_name").alias("case_name"), optional(cases, "analyst_name").alias("analyst")).alias("reporting"),
        F.struct(optional(cases, "description").alias("concern"), optional(cases, "created_at").alias("opened_at"), optional(cases, "status").alias("status"), F.col("highest").alias("highest_risk_score")).alias("incident"),
        F.coalesce("subjects", F.array().cast(out.schema["subjects"].dataType)).alias("subjects"), F.struct(F.size(none).alias("artifact_count"), none.alias("artifacts")).alias("supporting_evidence"),
        F.struct(F.coalesce("sealed", F.lit("no sealed package")).alias("sealed_package"), F.lit("a view for sharing; the sealed package is the record").alias("note")).alias("provenance"),
    )
    return redact_frame(out, protected, policy, keep=("supporting_evidence", "provenance")) if redacted else out
