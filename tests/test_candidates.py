"""Candidates of correlation: none of the leads is lost, whatever data the profiles lack."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import blocks, correlation, matching

TEXTS = ["I was there, really!", "You and me... it is.", "So what? No.", "The end.", "Fine, the best!", "It is on.", "WHO knows", "ok"]


def profiles(spark, seed, n=70):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        nodes = sorted({f"n{int(rng.paretovariate(0.7)) % 25}" for _ in range(rng.randint(0, 5))})
        rows.append((
            k, rng.choice([None, "zxqvwkjh", "zxqvwkjq", "gamer", "qwvz" + rng.choice("abcd"), "plok"]), rng.sample(TEXTS, rng.choice([0, 0, 5, 6])), sorted(rng.sample(range(6), rng.choice([0, 2, 3]))), nodes,
            {x: rng.choice([1, 2, 3]) if int(x[1:]) > 3 else 40 for x in nodes}, rng.choice([None, f"{rng.getrandbits(4):016x}", f"{rng.getrandbits(64):016x}"]), rng.choice([None, f"{rng.getrandbits(5):016x}"]),
        ))
    return correlation.profiles(spark.createDataFrame(rows, "profile_id long, username string, messages array<string>, active_hours array<int>, connections array<string>, connection_degrees map<string,long>, avatar_phash string, avatar_dhash string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_no_lead_is_lost(spark, seed):
    p = profiles(spark, seed)
    every = p.alias("l").join(p.alias("r"), F.col("l.profile_id") < F.col("r.profile_id")).select(F.col("l.profile_id").alias("a"), F.col("r.profile_id").alias("b"))
    leads = {(r.a, r.b) for r in correlation.score_pairs(p, every).where("is_lead").select("a", "b").collect()}
    found = {(r.a, r.b) for r in correlation.lead_candidates(p).collect()}
    assert leads and leads <= found


@pytest.mark.parametrize(("near", "n"), [(8, 10), (8, 10**5), (10, 10**3), (10, 10**6), (3, 10**9)])
def test_pieces_find_every_near_hash_and_no_other_often(spark, near, n):
    """Every hash within reach meets a query, whatever the cut; pieces asked for come once."""
    rng = random.Random(near)
    cut = blocks.pieces(n, near)
    asked = [rng.getrandbits(64) for _ in range(8)]
    stored = [(q, q ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(near + 1)))) for q in asked for _ in range(60)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    q = spark.createDataFrame([(signed(x),) for x in asked], "asked long")
    s = spark.createDataFrame([(signed(a), signed(b)) for a, b in stored], "of long, held long")
    rows = blocks.asking(q, "asked", cut)
    assert rows.count() == rows.distinct().count() == len(asked) * sum(blocks._ball(bits, radius) for _, bits, radius in cut)
    met = rows.join(blocks.entered(s, "held", cut), ["which", "value"]).where("asked = of").select("of", "held").distinct().count()
    assert met == len(set(stored))


def test_cost_of_a_query_grows_far_slower_than_the_index():
    cost = {n: blocks.cost(n, blocks.pieces(n, 10)) for n in (10**3, 10**6, 10**9)}
    assert cost[10**6] < 6_000 and cost[10**9] < 10**6 and cost[10**3] < 600
    assert all(blocks.pieces(10**3, near)[0][1] <= blocks.pieces(10**9, near)[0][1] for near in (0, 1, 8, 10))


def test_first_stored_hash_wins_among_many(spark):
    """Against all stored hashes, with crowds of near ones and equal ones."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    stored = [(f"{flip(rng.choice(base), rng.randrange(14)):016x}", f"s{k}", k) for k in range(3000)]
    asked = [f"{flip(x, rng.randrange(6)):016x}" for x in base for _ in range(3)] + ["0" * 16, "bad"]
    got = {r.query_hash: (r.label, r.distance) for r in matching.match_first(spark.createDataFrame([(x,) for x in asked], "query_hash string"), spark.createDataFrame(stored, "hash string, label string, position long")).collect()}
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {x: next(((label, bits(x, h)) for h, label, _ in stored if bits(x, h) <= 10), (None, None)) if x != "bad" else (None, None) for x in asked}
    assert got == want
