"""The manifest's artifacts, the widest rows, are moved once."""

from casewright.operators import custody
from pyspark.sql import functions as F


def test_artifacts_move_once(spark):
    targets = spark.createDataFrame([(1, 7, "p"), (2, 8, "q"), (3, None, "r")], "target_id long, case_id long, platform string")
    artifacts = spark.createDataFrame([(10, 1, "a"), (20, 2, "b"), (30, 3, "c"), (40, 4, "d")], "artifact_id long, target_id long, sha256 string")
    log = spark.createDataFrame([(7, "t1"), (7, "t2"), (9, "t3")], "case_id long, timestamp string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = custody.manifest(targets, artifacts, log)
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        got = sorted(tuple(r) for r in rows.select("artifact_id", "case_id", "platform", "sha256", "custody_events", F.col("last_event")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(10, 7, "p", "a", 2, "t2"), (20, 8, "q", "b", 0, None), (30, None, "r", "c", 0, None)]
    # the join of artifacts is the outer one, so nothing is joined behind it
    first = next(line for line in plan.splitlines() if "Join" in line)
    assert "target_id" in first
