"""Confusion matrices, threshold sweeps and seeded synthetic profiles."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .profiles import any_term

# Targets, sweep, night hours.
TARGETS = {"fpr_max": 0.15, "fnr_max": 0.15, "f1_min": 0.70, "precision_min": 0.75, "recall_min": 0.80}
SWEEP = (10, 44)
NIGHT = (22, 23, 0, 1, 2, 3)
GAME_MARKERS = ("condo", "18plus", "adult", "private_rp", "secretmeet", "nokids", "mature", "hidden")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fpr, fnr and accuracy to tp, fp, tn, fn; empty denominators give 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp), "accuracy": _ratio(tp + tn, tp + fp + tn + fn)})
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _matrix(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn")]


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row with the matrix, the rates and whether all targets are met."""
    out = rates(rows.agg(*_matrix(predicted, actual)))
    met = (F.col("fpr") <= TARGETS["fpr_max"]) & (F.col("fnr") <= TARGETS["fnr_max"]) & (F.col("f1") >= TARGETS["f1_min"]) & (F.col("precision") >= TARGETS["precision_min"]) & (F.col("recall") >= TARGETS["recall_min"])
    return out.withColumn("targets_met", met)


def tier_accuracy(rows: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Per expected tier: rows, correct ones, and their share."""
    return rows.groupBy(F.col(expected).alias("tier")).agg(F.count("*").alias("total"), F.count_if(F.col(predicted) == F.col(expected)).alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 4))


def sweep(rows: DataFrame, score: str, actual: Column) -> DataFrame:
    """The matrix at each threshold 1.0, 1.1, ... 4.4 in one pass: scores are counted by the highest
    threshold they reach, and the counts are summed from above."""
    lo, hi = SWEEP
    step = F.least(F.lit(hi), F.floor(F.col(score) * 10 + 1e-9).cast("int"))
    binned = rows.select(step.alias("step"), actual.alias("actual")).groupBy("step").agg(F.count_if("actual").alias("p"), F.count_if(~F.col("actual")).alias("n"))
    thresholds = rows.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("t"))
    # at most one bin for each of the 35 thresholds above the first, and the bins below it
    met = binned.withColumn("step", F.when(F.col("step") < lo, lo - 1).otherwise(F.col("step"))).groupBy("step").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = F.coalesce(F.col("step") >= F.col("t"), F.lit(False))
    total = lambda on, c: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).cast("long")
    counts = thresholds.join(F.broadcast(met)).groupBy("t").agg(total(above, "p").alias("tp"), total(above, "n").alias("fp"), total(~above, "n").alias("tn"), total(~above, "p").alias("fn"))
    return rates(counts.withColumn("threshold", F.col("t") / 10).drop("t"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of highest f1 among those that meet the targets; the lowest one wins a tie."""
    ok = swept.where((F.col("fpr") <= TARGETS["fpr_max"]) & (F.col("recall") >= TARGETS["recall_min"]) & (F.col("f1") >= TARGETS["f1_min"]))
    return ok.orderBy(F.desc("f1"), "threshold").limit(1)


def flagged_games(games: Column) -> Column:
    """How many games of an array hold a marker in their name."""
    return F.size(F.filter(F.coalesce(games, F.array().cast("array<string>")), lambda g: any_term(g, GAME_MARKERS)))


def late_night(hours: Column) -> Column:
    return F.exists(hours, lambda h: h.isin(*NIGHT))


def synthetic_profiles(spark: SparkSession, safe: int = 50, threat: int = 50, edge: int = 10, seed: int = 42) -> DataFrame:
    """Invented profiles with an expected tier; the same seed gives the same rows."""
    rng = random.Random(seed)
    shape = {"safe": (1, (200, 2000), (5, 120), 0.02), "threat": (3, (1, 25), (150, 500), 0.9), "edge_case": (2, (15, 60), (80, 220), 0.4)}
    rows = []
    for kind, n in (("safe", safe), ("threat", threat), ("edge_case", edge)):
        tier, age, friends, hidden = shape[kind]
        for k in range(n):
            rows.append((f"{kind}-{seed}-{k}", kind, rng.randint(*age), rng.randint(*friends), rng.random() < hidden, rng.random() < hidden, [rng.choice(NIGHT if kind == "threat" else range(8, 21)) for _ in range(6)], tier))
    return spark.createDataFrame(rows, "profile_id string, profile_type string, account_age_days int, friend_count int, is_tor boolean, is_vpn boolean, active_hours array<int>, expected_tier int")
