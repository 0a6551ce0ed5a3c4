"""Pairs by lists: pairs within groups and neighbours by brute force, split lists, and nothing moved by pair."""

import random

import pytest

from casewright.operators import correlation, overlap


def some_rows(n=90):
    rng = random.Random(5)
    return [(k, f"n{int(rng.paretovariate(0.7)) % 60}") for k in range(n) for _ in range(6)] + [(k, "hub") for k in range(0, n, 2)]


@pytest.mark.parametrize("block", [3, 4096])
def test_pairs_of_a_group_are_those_of_all_pairs_in_it(spark, block):
    table = spark.createDataFrame(some_rows(), "profile_id long, node string")
    groups = spark.createDataFrame([(k, k % 4 if k % 5 else None) for k in range(80)], "profile_id long, group long")
    rows = lambda df: {(r.a, r.b, r.shared, r.distinctive, r.together, round(r.score, 9)) for r in df.collect()}
    every = rows(overlap.sharing(table))
    assert rows(overlap.sharing(table, block=block)) == every
    group = {k: k % 4 for k in range(80) if k % 5}
    assert rows(overlap.sharing(table, groups=groups, block=block)) == {p for p in every if p[0] in group and p[1] in group and group[p[0]] == group[p[1]]}


@pytest.mark.parametrize("block", [3, 4096])
def test_neighbours(spark, block):
    table = spark.createDataFrame([*some_rows(), (500, "alone")], "profile_id long, node string")
    sets = {}
    for k, x in some_rows():
        sets.setdefault(k, set()).add(x)
    want = {k: sorted(j for j in sets if j != k and sets[j] & own) for k, own in sets.items()}
    assert {r.node: r.others for r in overlap.neighbours(table, block).collect()} == {k: v for k, v in want.items() if v}


def test_no_pair_is_moved(spark):
    table = spark.createDataFrame(some_rows(), "profile_id long, node string")
    for found in (correlation.network_overlap(table), overlap.overlapping(table, 2, 0.0)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        moving = [line for line in plan.splitlines() if "Exchange hashpartitioning(a#" in line]
        assert len(moving) == 1 and "b#" not in moving[0] and plan.index(moving[0]) > plan.index("Generate inline")
        assert "Join" not in plan[: plan.index("Generate inline")]
