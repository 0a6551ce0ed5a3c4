"""Set overlap against all pairs, on skewed sets, whatever the bounds and however lists are split."""

import math
import random

import pytest

from casewright.operators import correlation, overlap


def some_sets(seed, n=120):
    """Sets of 0 to 30 members out of a few popular and many rare ones; one member nearly everybody has."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        mine = {f"n{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice([0, 1, 2, 5, 30]))} | ({"hub"} if k % 3 else set())
        rows += [(k, x) for x in mine]
    return rows


def all_pairs(rows, least_shared, least_score):
    sets, degree = {}, {}
    for k, x in set(rows):
        sets.setdefault(k, set()).add(x)
        degree[x] = degree.get(x, 0) + 1
    weight = {x: 1.0 if d <= 1 else 1 / math.log2(d + 1) for x, d in degree.items()}
    out = {}
    for a in sets:
        for b in sets:
            both = sets[a] & sets[b]
            score = min(1.0, sum(weight[x] for x in both) / math.log2(len(sets[a] | sets[b]) + 1))
            if a < b and both and len(both) >= least_shared and score >= least_score:
                out[a, b] = (len(both), sum(degree[x] <= 20 for x in both), len(sets[a] | sets[b]), round(score, 9))
    return out


@pytest.mark.parametrize(("least_shared", "least_score", "block"), [(1, 0.0, 4096), (3, 0.0, 7), (1, 0.25, 7), (2, 0.1, 40), (1, 1.0, 5), (9, 0.3, 4096)])
def test_equals_all_pairs(spark, least_shared, least_score, block):
    rows = some_sets(least_shared)
    table = spark.createDataFrame(rows * 2 + [(None, "hub"), (5, None)], "profile_id long, node string")
    found = overlap.overlapping(table, least_shared, least_score, block).collect()
    got = {(r.a, r.b): (r.shared, r.distinctive, r.together, round(r.score, 9)) for r in found}
    assert len(found) == len(got) and got == all_pairs(rows, least_shared, least_score)
    assert overlap.overlapping(table.where("false"), least_shared, least_score, block).collect() == []


def test_same_measure_as_of_all_sharing_pairs(spark):
    table = spark.createDataFrame(some_sets(4), "profile_id long, node string")
    rounded = lambda df: {(r.a, r.b, r.shared, r.distinctive, r.together, round(r.score, 9)) for r in df.collect()}
    assert rounded(overlap.overlapping(table)) == rounded(correlation.network_overlap(table))


def test_few_candidates(spark):
    """A member that everybody has brings no pair together where more must be shared."""
    rows = [(k, "hub") for k in range(600)] + [(k, f"own{k}-{j}") for k in range(600) for j in range(4)] + [(k, f"two{k // 2}") for k in range(600)]
    sets = overlap.weighed(spark.createDataFrame(rows, "profile_id long, node string"))
    assert overlap.candidates(sets, 2).count() == 300 and overlap.candidates(sets, 1, 0.3).count() == 0 and overlap.candidates(sets, 1, 0.15).count() == 300


@pytest.mark.parametrize("block", [1, 3, 100])
def test_a_split_list_meets_every_pair_once(spark, block):
    entries = spark.createDataFrame([(k, "hub") for k in range(50)], "profile_id long, node string")
    assert sorted((r.a, r.b) for r in overlap.meetings(entries, None, block).collect()) == [(a, b) for a in range(50) for b in range(a + 1, 50)]
