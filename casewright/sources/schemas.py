"""Schemas of the case store, for reading and for empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Tables and their columns. Times stay texts, as they come in two forms.
DDL = {
    "cases": "case_id string not null, case_name string not null, description string, created_at string, analyst_name string, status string",
    "targets": "target_id long not null, case_id string not null, platform string not null, username string not null, platform_user_id string, added_at string, notes string",
    "artifacts": "artifact_id long not null, target_id long not null, module_name string not null, artifact_type string not null, raw_data string, processed_data string, file_path string, sha256 string not null, collected_at string",
    "evidence_log": "log_id long not null, timestamp string, action string not null, case_id string, artifact_id long, target_id long, analyst string, sha256 string, notes string, entry_hash string, previous_hash string",
    "analysis_results": "result_id long not null, target_id long not null, analysis_type string, findings string, risk_score double, analyst_notes string, analyzed_at string",
    "entities": "entity_id string not null, case_id string not null, canonical_handle string not null, promoted_by string not null, promoted_at string not null, source_candidate_id string, analyst_note string",
    "entity_members": "member_id long not null, entity_id string not null, profile_id string not null, platform string not null, username string not null, justification string",
    "analyst_notes": "note_id long not null, case_id string not null, target_id long, finding_ref string, analyst string not null, note string not null, created_at string not null",
}
STATUSES = ("open", "closed", "archived")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of a table: missing ones are null, others go."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def problems(df: DataFrame, name: str) -> DataFrame:
    """Rows that the table would refuse, with the first reason: a null where none may stand, or a status
    that does not exist."""
    reason = F.lit(None).cast("string")
    if name == "cases":
        reason = F.when(~F.col("status").isin(*STATUSES), "unknown status").otherwise(reason)
    for f in reversed([f for f in schema(name) if not f.nullable]):
        reason = F.when(F.col(f.name).isNull(), f"{f.name} is missing").otherwise(reason)
    return df.withColumn("problem", reason).where("problem is not null")
