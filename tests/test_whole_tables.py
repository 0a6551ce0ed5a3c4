"""Linkage and graph queries over whole tables: no order line, pair or stored hash is left out."""

import math
from collections import defaultdict
from itertools import combinations

import pytest

from casewright.operators import graph
from casewright.plans.catalogue import QUERIES
from casewright.sources import domain
from casewright.sources.tables import table

def parts_of_customers(spark, sf_dir):
    owner = {r.o_orderkey: r.o_custkey for r in table(spark, sf_dir, "orders").collect()}
    nodes = defaultdict(set)
    for r in table(spark, sf_dir, "lineitem").collect():
        if r.l_orderkey in owner:
            nodes[owner[r.l_orderkey]].add(r.l_partkey)
    return nodes


def test_connections_take_all_order_lines(spark, sf_dir):
    want = {(p, n) for p, own in parts_of_customers(spark, sf_dir).items() for n in own}
    assert {(r.profile_id, r.node) for r in domain.connections(spark, sf_dir).collect()} == want


def test_network_overlap_by_brute_force(spark, sf_dir):
    nodes = parts_of_customers(spark, sf_dir)
    degree = defaultdict(int)
    for own in nodes.values():
        for n in own:
            degree[n] += 1
    want = {}
    for a, b in combinations(sorted(nodes), 2):
        both = nodes[a] & nodes[b]
        if both:
            evidence = sum(1 if degree[n] <= 1 else 1 / math.log2(degree[n] + 1) for n in both)
            together = len(nodes[a] | nodes[b])
            want[a, b] = (len(both), sum(degree[n] <= 20 for n in both), together, pytest.approx(min(1.0, evidence / math.log2(together + 1)), abs=1e-8))
    got = {(r.a, r.b): (r.shared, r.distinctive, r.together, r.score) for r in QUERIES["network_overlap_pairs"](spark, sf_dir).collect()}
    assert got == want


def test_every_stored_hash_is_searched(spark, sf_dir):
    held = sorted((r.profile_id, r.phash) for r in domain.avatars(spark, sf_dir).collect())
    want = {}
    for q in {h for _, h in held}:
        first = next((k, (int(q, 16) ^ int(h, 16)).bit_count()) for k, h in held if (int(q, 16) ^ int(h, 16)).bit_count() <= 10)
        want[q] = (f"stored-{first[0]}", first[1])
    got = {r.query_hash: (r.label, r.distance) for r in QUERIES["hash_match_first"](spark, sf_dir).collect()}
    assert got == want


def test_paths_have_no_limit_unless_asked(spark):
    chain = spark.createDataFrame([(k, k + 1, 1.0, True, False) for k in range(1, 10)], "a long, b long, strength double, is_lead boolean, has_contradiction boolean")
    assert {(r.node, r.hops, r.via) for r in graph.shortest_paths(chain, 1).collect()} == {(k, k - 1, k - 1 or None) for k in range(1, 11)}
    assert graph.shortest_paths(chain, 1, max_hops=3).count() == 4


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1]


def test_handle_pairs_keep_every_possible_lead(spark, sf_dir):
    rarity = {r.handle: r.rarity for r in QUERIES["handle_rarity"](spark, sf_dir).collect()}
    ratios = {(a, b): 2 * common(a, b) / (len(a) + len(b)) for a, b in combinations(sorted(rarity), 2)}
    want = {p for p, x in ratios.items() if x >= 0.6 or x * (rarity[p[0]] + rarity[p[1]]) / 2 >= 0.2}
    got = {(r.a, r.b): r.ratio for r in QUERIES["handle_similarity_pairs"](spark, sf_dir).collect()}
    assert got.keys() == want and any(x < 0.6 for x in got.values())
    assert all(x == pytest.approx(ratios[p], abs=1e-8) for p, x in got.items())
def test_graph_queries_take_all_connections(spark, sf_dir):
    """Neighbours, groups and inner edges rest on every two customers with a part in common."""
    nodes = parts_of_customers(spark, sf_dir)
    want = {(a, b) for a, b in combinations(sorted(nodes), 2) if nodes[a] & nodes[b]}
    got = {(r.node, int(other)) for r in QUERIES["graph_neighbours"](spark, sf_dir).collect() for other in r.neighbours.split(",")}
    assert got == want | {(b, a) for a, b in want}
    nation = {r.node: r.entity for r in table(spark, sf_dir, "customer").selectExpr("c_custkey AS node", "c_nationkey AS entity").collect()}
    inside = {(a, b) for a, b in want if nation[a] == nation[b]}
    assert {(r.source, r.target) for r in QUERIES["graph_links"](spark, sf_dir).collect()} == inside
    assert sum(r.edges for r in QUERIES["graph_risk_inputs"](spark, sf_dir).collect()) == sum(r.edges for r in QUERIES["canonical_graph"](spark, sf_dir).collect()) == len(inside)
    first = min(nodes, key=lambda k: (-sum(k in pair for pair in want), k))
    assert {r.node for r in QUERIES["shortest_path_bounded"](spark, sf_dir).where("hops = 1").collect()} == {a + b - first for a, b in want if first in (a, b)}
