"""Case reporting: registries, histograms, latest and peak scores, counts and timelines of scores.

Every function takes and returns DataFrames and runs no action. Sides are aggregated by case before they
are joined, so no join fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TIERS = ("tier1", "tier2", "tier3", "unscored")
TIER2, TIER3 = 2.0, 7.0


def tier(score: Column) -> Column:
    """1, 2 or 3; null stays null. The bands are contiguous."""
    return F.when(score >= TIER3, 3).when(score >= TIER2, 2).when(score.isNotNull(), 1)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def scored_targets(targets: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every analysis with its target's case and platform."""
    return targets.select("target_id", "case_id", "platform").join(analyses, "target_id")


def primary_platform(targets: DataFrame) -> DataFrame:
    """The most frequent platform of each case; ties go to the alphabetically first."""
    counts = targets.groupBy("case_id", "platform").agg(F.count("*").alias("n"))
    return counts.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("by"), "platform"))["platform"].alias("primary_platform"))


def _newest() -> Column:
    """The newest analysis of a group by time, then id, then score."""
    return F.max(F.struct("analyzed_at", "result_id", "risk_score", "target_id"))


def latest_signal(targets: DataFrame, analyses: DataFrame) -> DataFrame:
    """The newest analysis of each case by time, then id, then score."""
    rows = scored_targets(targets, analyses).groupBy("case_id").agg(_newest().alias("x"))
    return rows.select("case_id", "x.result_id", "x.target_id", F.col("x.risk_score").alias("latest_risk"), "x.analyzed_at")


def peak_risk(targets: DataFrame, analyses: DataFrame) -> DataFrame:
    """Highest score, number of scores that are not null and last time of each case."""
    return scored_targets(targets, analyses).groupBy("case_id").agg(F.max("risk_score").alias("peak_risk"), F.count("risk_score").alias("analysis_count"), F.max("analyzed_at").alias("last_analyzed"))


def case_registry(cases: DataFrame, targets: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row per case with counts, primary platform, latest and peak score; unscored cases last.

    Targets and analyses are joined once, and both scores come from one aggregation over them.
    """
    counts = targets.groupBy("case_id").agg(F.count("*").alias("target_count"))
    scores = scored_targets(targets, analyses).groupBy("case_id").agg(_newest().alias("x"), F.max("risk_score").alias("peak_risk"), F.count("risk_score").alias("analysis_count"))
    scores = scores.select("case_id", F.col("x.risk_score").alias("latest_risk"), "x.analyzed_at", "peak_risk", "analysis_count")
    out = cases.join(counts, "case_id", "left").join(primary_platform(targets), "case_id", "left").join(scores, "case_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"target_count": F.coalesce("target_count", zero), "analysis_count": F.coalesce("analysis_count", zero)})
    return out.orderBy(F.col("peak_risk").desc_nulls_last(), F.desc("case_id"))


def case_summary(targets: DataFrame, artifacts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per case: targets, artifacts, analyses, and its platforms with their counts as text."""
    by_platform = targets.groupBy("case_id", "platform").agg(F.count("*").alias("n"))
    platforms = by_platform.groupBy("case_id").agg(F.sum("n").alias("targets"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("platform", "n"))), lambda x: F.concat_ws("=", x["platform"], x["n"].cast("string"))), ";").alias("platforms"))

    def number(rows: DataFrame, name: str) -> DataFrame:
        return targets.select("target_id", "case_id").join(rows.groupBy("target_id").agg(F.count("*").alias("n")), "target_id").groupBy("case_id").agg(F.sum("n").alias(name))

    out = platforms.join(number(artifacts, "artifacts"), "case_id", "left").join(number(analyses, "analyses"), "case_id", "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"artifacts": F.coalesce("artifacts", zero), "analyses": F.coalesce("analyses", zero)})


def tier_histogram(cases: DataFrame, targets: DataFrame, analyses: DataFrame) -> DataFrame:
    """Number of cases in each tier of their latest score; all four buckets are present."""
    scored = cases.select("case_id").join(latest_signal(targets, analyses), "case_id", "left")
    found = scored.select(F.coalesce(F.concat(F.lit("tier"), tier(F.col("latest_risk")).cast("string")), F.lit("unscored")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    every = cases.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{x}')" for x in TIERS) + " AS t(bucket)")
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def platform_histogram(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """Number of cases by primary platform, ``unknown`` where a case has no target."""
    rows = cases.select("case_id").join(primary_platform(targets), "case_id", "left")
    return rows.groupBy(F.coalesce("primary_platform", F.lit("unknown")).alias("platform")).agg(F.count("*").alias("n"))


def module_counts(artifacts: DataFrame) -> DataFrame:
    """Artifacts by module and type, and their total, as one grouping-set aggregation."""
    counts = artifacts.rollup("module_name", "artifact_type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return counts.where("level in (0, 3)").select(F.coalesce("module_name", F.lit("total")).alias("module_name"), F.coalesce("artifact_type", F.lit("")).alias("artifact_type"), "n")


def risk_timeline(targets: DataFrame, analyses: DataFrame) -> DataFrame:
    """Scored analyses of each case in time order, with the change since the one before."""
    rows = scored_targets(targets, analyses).where("risk_score is not null")
    w = Window.partitionBy("case_id").orderBy("analyzed_at", "result_id", "risk_score", "platform")
    return rows.select("case_id", "result_id", "platform", "analyzed_at", "risk_score", F.row_number().over(w).alias("position"), (F.col("risk_score") - F.lag("risk_score").over(w)).alias("change"))


def case_text(targets: DataFrame, artifacts: DataFrame, default: str = "no artifacts collected") -> DataFrame:
    """All artifact labels of a case as one text in artifact order; ``default`` where there are none."""
    label = F.concat_ws(":", "module_name", "artifact_type")
    rows = targets.select("case_id", "target_id").join(artifacts.select("target_id", "artifact_id", label.alias("label")), "target_id", "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("artifact_id").isNotNull(), F.struct("artifact_id", "label")))), lambda x: x["label"]), " ")
    return rows.groupBy("case_id").agg(joined.alias("text")).select("case_id", F.when(F.col("text") == "", default).otherwise(F.col("text")).alias("text"))


def latest_payload(targets: DataFrame, artifacts: DataFrame, kind: str) -> DataFrame:
    """The newest artifact of one type in each case, by id."""
    rows = artifacts.where(F.col("artifact_type") == kind).join(targets.select("target_id", "case_id"), "target_id")
    return rows.groupBy("case_id").agg(F.max_by("sha256", "artifact_id").alias("sha256"), F.max("artifact_id").alias("artifact_id"))


def repaired_ids(cases: DataFrame, prefix: str = "CASE-") -> DataFrame:
    """Case ids as text, with the prefix where it is missing."""
    text = F.col("case_id").cast("string")
    return cases.select("case_id", F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text)).alias("repaired_id"))


def matching_cases(cases: DataFrame, targets: DataFrame, analyses: DataFrame, like: str) -> DataFrame:
    """Analyses of the cases whose name matches a pattern: a three-way inner join."""
    chosen = cases.where(F.col("case_name").like(like)).select("case_id", "case_name")
    return chosen.join(targets.select("case_id", "target_id", "platform"), "case_id").join(analyses, "target_id").select("case_name", "platform", "result_id", "risk_score")
