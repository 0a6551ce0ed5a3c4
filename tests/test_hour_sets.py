"""Hour overlap against plain Python, however sets are dealt into blocks, and in more than one task."""

import random

import pytest

from casewright.operators import correlation


def weight(hours):
    return sum(0.2 if 18 <= h <= 22 else 0.4 if 9 <= h <= 17 else 1.0 if h <= 5 else 0.6 for h in sorted(hours))


@pytest.mark.parametrize("size", [3, 128])
def test_every_two_sets_that_meet(spark, monkeypatch, size):
    monkeypatch.setattr(correlation, "HOUR_SETS", size)
    rng = random.Random(size)
    own = {k: frozenset(rng.sample(range(24), rng.choice([1, 2, 9]))) for k in range(60)}
    rows = spark.createDataFrame([(k, h) for k, hs in own.items() for h in hs], "profile_id long, hour int")
    mask = lambda hs: sum(1 << h for h in hs)
    times = {s: list(own.values()).count(s) for s in own.values()}
    want = {(mask(x), mask(y)): (times[x], times[y], pytest.approx(weight(x & y) / weight(x | y), abs=1e-12)) for x in times for y in times if mask(x) < mask(y) and x & y}
    found = correlation.hour_overlap(rows)
    got = {(r.mask_a, r.mask_b): (r.profiles_a, r.profiles_b, r.score) for r in found.collect()}
    assert got == want and found.count() == len(want)
    assert size > 3 or found.rdd.getNumPartitions() > 24
