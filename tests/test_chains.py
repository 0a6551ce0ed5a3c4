"""Verification over ranges of a chain against the plain walk along it."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import custody


def walked(entries, content_ok):
    """(intact, checked, broken id, reason) of one chain's (log_id, previous, hash) in order."""
    expected = custody.GENESIS
    for k, (log_id, previous, own) in enumerate(entries):
        if previous != expected:
            return False, k, log_id, "broken link"
        if not content_ok[log_id]:
            return False, k, log_id, "content does not match its hash"
        expected = own
    return True, len(entries), None, None


@pytest.mark.parametrize("size", [1, 7, 50_000])
def test_verdicts_equal_the_walk(spark, size):
    """Intact chains, one hot one, removed, altered and re-linked entries, first and last ones too."""
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 600)
    rows = [(k, rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, None]), f"note {k}") for k in sorted(ids)]
    log = spark.createDataFrame(rows, "log_id long, case_id int, notes string")
    chained = {r.log_id: r.asDict() for r in custody.build_chain(log).collect()}
    of = {}
    for k in sorted(chained):
        of.setdefault(chained[k]["case_id"], []).append(k)
    ok = dict.fromkeys(chained, True)
    for case, how in ((2, "drop first"), (3, "drop middle"), (4, "alter last"), (5, "alter middle"), (6, "relink")):
        k = of[case][0 if how.endswith("first") else -1 if how.endswith("last") else len(of[case]) // 2]
        if how.startswith("drop"):
            del chained[k]
        elif how.startswith("alter"):
            chained[k]["notes"], ok[k] = "altered", False
        else:
            chained[k]["previous_hash"], ok[k] = "f" * 64, False
    kept = [chained[k] for k in sorted(chained)]
    table = spark.createDataFrame([(r["log_id"], r["case_id"], r["notes"], r["previous_hash"], r["entry_hash"]) for r in kept] + [(1, 1, "old", None, None)], "log_id long, case_id int, notes string, previous_hash string, entry_hash string")
    got = {r.case_id: (r.intact, r.entries_checked, r.broken_log_id, r.reason) for r in custody.verify_chain(table, entries=size).collect()}
    want = {case: walked([(r["log_id"], r["previous_hash"], r["entry_hash"]) for r in kept if r["case_id"] == case], ok) for case in of}
    assert got == want and sum(not v[0] for v in got.values()) == 5
    assert custody.verify_chain(table.where(F.lit(False))).collect() == []
