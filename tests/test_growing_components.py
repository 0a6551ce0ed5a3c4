"""Components that grow batch by batch against all edges at once."""

import random

import pytest

from casewright.operators.components import GrowingComponents, connected_components
from casewright.operators.scratch import Scratch


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_equal_one_run(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(5, 5), (None, 3)]
    table = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    want = {(r.node, r.component) for r in connected_components(table(edges), Scratch(spark, "whole")).collect()}
    rng.shuffle(edges)
    growing = GrowingComponents(Scratch(spark, "growing"))
    written = [growing.add(table(edges[k::4])) for k in range(4)] + [growing.add(table(edges[:10])), growing.add(table([]))]
    assert {(r.node, r.component) for r in growing.labels().collect()} == want
    # a node is written once, when it stops being the smallest of its component; repeats write nothing
    assert sum(written) == len(want) and written[-2:] == [0, 0]


def test_a_batch_writes_no_more_than_it_joins(spark):
    growing = GrowingComponents(Scratch(spark, "growing"), "string")
    chain = lambda p, n: [(f"{p}{k:03d}", f"{p}{k + 1:03d}") for k in range(n)]
    table = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    assert growing.labels().collect() == []
    assert growing.add(table(chain("b", 60) + chain("c", 60))) == 120
    assert growing.add(table([("c030", "b059")])) == 1  # two large groups become one by a single row
    assert growing.add(table([("a", "b000")])) == 1
    assert {r.component for r in growing.labels().collect()} == {"a"}
