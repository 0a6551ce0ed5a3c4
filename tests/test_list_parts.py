"""Neighbours from lists that move once for each part of their profiles: rows moved, and any kind of ids by brute force."""

import random

import pytest

from casewright.operators import overlap


def some_rows(copies, name=lambda k: k, n=60):
    rng = random.Random(2)
    plain = {(k, rng.randrange(40)) for k in range(n) for _ in range(6)}
    return [(name(k + c * n), f"{c}:{x}") for c in range(copies) for k, x in plain]


def brute(rows):
    of, sets = {}, {}
    for k, x in rows:
        of.setdefault(x, set()).add(k)
        sets.setdefault(k, set()).add(x)
    found = {k: sorted(set().union(*(of[x] for x in own)) - {k}) for k, own in sets.items()}
    return {k: v for k, v in found.items() if v}


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("kind, name", [("long", lambda k: k), ("long", lambda k: k * 7919 % 240 - 100), ("long", lambda k: 2**40 + k), ("long", lambda k: 2**31 - 120 + k), ("int", lambda k: k), ("string", lambda k: f"p{k}")])
def test_neighbours_in_parts(spark, monkeypatch, kind, name, block):
    monkeypatch.setattr(overlap, "PART_PAIRS", 100)
    rows = some_rows(4, name)
    rows += [(k, "hub") for k in sorted({k for k, _ in rows})[::3]]
    found = overlap.neighbours(spark.createDataFrame([*rows, *rows[:9], (None, "hub"), (rows[0][0], None)], f"profile_id {kind}, node string"), block)
    assert found.schema["others"].dataType.elementType == found.schema["node"].dataType and found.schema["node"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    got = found.collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.others for r in got} == brute(rows)


def test_a_list_goes_to_few_parts(spark, monkeypatch):
    kept, plain = [], overlap.dealt_lists
    monkeypatch.setattr(overlap, "PART_PAIRS", 2000)
    monkeypatch.setattr(overlap, "dealt_lists", lambda *given: kept.append((given[0], given[1], plain(*given))) or kept[-1][2])
    rows = some_rows(20)
    table = spark.createDataFrame(rows, "profile_id long, node string")
    assert {r.node: r.others for r in overlap.neighbours(table).collect()} == brute(rows)
    ((listed, parts, dealt),) = kept
    members = listed.selectExpr("sum(size(m))").first()[0]
    assert parts >= 10 and dealt.count() < 2.5 * listed.count() < 0.5 * members
    # a profile of a list is in one part of it
    assert dealt.selectExpr("sum(size(mine))").first()[0] == members and dealt.selectExpr("explode(mine) AS a", "part").distinct().groupBy("a").count().where("count > 1").isEmpty()


def test_no_rows(spark):
    assert overlap.neighbours(spark.createDataFrame([], "profile_id long, node string")).collect() == []
