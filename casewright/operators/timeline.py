"""One event shape for every source of a case, in a stable order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = ("case_id", "timestamp", "kind", "description", "source_table", "source_ref", "analyst", "target_id", "sha256", "detail")


def normalised_time(raw: Column) -> Column:
    """ISO text in UTC; text that is no time stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), raw, F.lit(""))


def _event(df: DataFrame, **columns: Column) -> DataFrame:
    blank = {"analyst": F.lit(""), "target_id": F.lit(None).cast("long"), "sha256": F.lit(""), "detail": F.lit("")}
    return df.select(*((columns.get(c) if c in columns else blank[c]).alias(c) for c in COLUMNS))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def build(cases: DataFrame, targets: DataFrame, artifacts: DataFrame | None = None, analyses: DataFrame | None = None, custody: DataFrame | None = None, notes: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """All events of all cases. Custody rows without a case belong to the case of their target."""
    key = F.col("case_id")
    owner = targets.select("target_id", "case_id")
    parts = []
    if "created_at" in cases.columns:
        parts.append(_event(cases, case_id=key, timestamp=normalised_time(F.col("created_at")), kind=F.lit("case_opened"), description=F.concat(F.lit("Case '"), _text("case_name"), F.lit("' opened")), source_table=F.lit("cases"), source_ref=_text("case_id"), analyst=_text("analyst_name")))
    parts.append(_event(targets, case_id=key, timestamp=normalised_time(F.col("added_at")), kind=F.lit("target_added"), description=F.concat(F.lit("Target "), _text("platform"), F.lit(":"), _text("username"), F.lit(" added to case")), source_table=F.lit("targets"), source_ref=_text("target_id"), target_id=F.col("target_id")))
    if artifacts is not None:
        parts.append(_event(artifacts.join(owner, "target_id"), case_id=key, timestamp=normalised_time(F.col("collected_at")), kind=F.lit("artifact_collected"), description=F.concat(_text("module_name"), F.lit(" collected "), _text("artifact_type"), F.lit(" artifact")), source_table=F.lit("artifacts"), source_ref=_text("artifact_id"), target_id=F.col("target_id"), sha256=_text("sha256")))
    if analyses is not None:
        parts.append(_event(analyses.join(owner, "target_id"), case_id=key, timestamp=normalised_time(F.col("analyzed_at")), kind=F.lit("analysis_recorded"), description=F.lit("analysis recorded"), source_table=F.lit("analysis_results"), source_ref=_text("result_id"), target_id=F.col("target_id"), detail=F.when(F.col("risk_score").isNotNull(), F.format_string("risk_score=%.2f", F.col("risk_score").cast("double"))).otherwise("")))
    if custody is not None:
        named = custody if "target_id" in custody.columns else custody.withColumn("target_id", F.lit(None).cast("long"))
        direct = named.where("case_id is not null")
        by_target = named.where("case_id is null").drop("case_id").join(owner, "target_id")
        rows = direct.unionByName(by_target.select(*direct.columns))
        parts.append(_event(rows, case_id=key, timestamp=normalised_time(F.col("timestamp")), kind=F.concat(F.lit("custody_"), F.coalesce("action", F.lit("entry"))), description=F.coalesce("notes", "action", F.lit("custody entry")), source_table=F.lit("evidence_log"), source_ref=_text("log_id"), target_id=F.col("target_id"), **{c: _text(c) for c in ("analyst", "sha256") if c in rows.columns}))
    if notes is not None:
        parts.append(_event(notes, case_id=key, timestamp=normalised_time(F.col("created_at")), kind=F.lit("analyst_note"), description=_text("note"), source_table=F.lit("analyst_notes"), source_ref=_text("note_id"), analyst=_text("analyst"), target_id=F.col("target_id") if "target_id" in notes.columns else F.lit(None).cast("long"), detail=F.when(F.col("finding_ref").isNotNull(), F.concat(F.lit("finding_ref="), F.col("finding_ref"))).otherwise("")))
    if entities is not None:
        parts.append(_event(entities, case_id=key, timestamp=normalised_time(F.col("promoted_at")), kind=F.lit("entity_promoted"), description=F.concat(F.lit("Entity "), _text("entity_id"), F.lit(" ('"), _text("canonical_handle"), F.lit("') resolved by analyst decision")), source_table=F.lit("entities"), source_ref=_text("entity_id"), analyst=_text("promoted_by")))
    return reduce(DataFrame.unionByName, parts)


def ordered(events: DataFrame) -> DataFrame:
    """Events of each case together, by time text, source and reference text; the cases themselves stand
    in no order, so no range of them is sampled and a case never spans two parts."""
    return events.repartition("case_id").sortWithinPartitions("case_id", "timestamp", "source_table", "source_ref")


def serialised(events: DataFrame) -> DataFrame:
    """(case_id, events): the timeline of each case as one JSON text, its events in order."""
    event = F.struct(*(F.col(c) for c in COLUMNS if c != "case_id"))
    rows = events.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "source_table", "source_ref", event.alias("event")))).alias("all"))
    return rows.select("case_id", F.to_json(F.transform("all", lambda x: x["event"]), {"ignoreNullFields": "false"}).alias("events"))


def chosen(events: DataFrame, kind: str | None = None, target_id: int | None = None) -> DataFrame:
    """Events whose kind starts with ``kind``, of one target."""
    out = events if kind is None else events.where(F.col("kind").startswith(kind))
    return out if target_id is None else out.where(F.col("target_id") == target_id)
