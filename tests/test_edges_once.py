"""Edges of purchases are found once a query, and their rows are moved once."""

from collections import Counter

import pytest

from casewright.operators import overlap
from casewright.plans import catalogue, linkage


@pytest.mark.parametrize("name", ["entity_promotion", "entity_members", "edge_justification", "path_with_evidence", "identity_components_in_batches"])
def test_edges_are_found_once(spark, sf_dir, monkeypatch, name):
    calls, plain = [], overlap.overlapping
    monkeypatch.setattr(linkage.O, "overlapping", lambda *given, **more: calls.append(1) or plain(*given, **more))
    catalogue.QUERIES[name](spark, sf_dir).collect()
    assert len(calls) == 1


def test_counted_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (1, "b"), (3, "b"), (3, "b"), (3, "alone"), (4, "only"), (4, "only"), (None, "a"), (2, None)]
    table = spark.createDataFrame(rows, "profile_id long, node string")
    sets = {(k, n) for k, n in rows if k is not None and n is not None}
    degree, size = Counter(n for _, n in sets), Counter(k for k, _ in sets)
    found = overlap.counted(table)
    assert sorted((r.profile_id, r.node, r.degree, r["size"]) for r in found.collect()) == sorted((k, n, degree[n], size[k]) for k, n in sets if degree[n] > 1)
    # the nodes of single sets are not written down
    written = spark.read.parquet(*found.inputFiles()).select("node").distinct().collect()
    assert {r.node for r in written} == {"a", "b", None}
