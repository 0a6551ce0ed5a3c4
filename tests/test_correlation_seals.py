"""Seals of correlation artifacts, streamed by pieces: equal to those of the whole texts, and no case in one row."""

import hashlib
import json
import random

import pyarrow as pa
import pytest

from casewright.operators import assembly
from casewright.plans import catalogue

SCORED = "a {0}, b {0}, strength double, is_lead boolean, contradiction_note string, rationale array<string>"


def some(spark, kind, name):
    rng = random.Random(4)
    case = lambda k: (None, 7, 8, 9, 10)[k % 5]
    component = {k: min(j for j in range(60) if j % 6 == k % 6) if k % 4 == 0 else k for k in range(60)}
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(300)})
    pairs = sorted((*sorted((name(a), name(b))), rng.random(), rng.random() < 0.5, rng.choice([None, 'a "note", 😀']), rng.choice([None, [], ["avatar: near", 'said "x"\n']])) for a, b in pairs if case(a) != 9)
    scored = spark.createDataFrame(pairs, SCORED.format(kind))
    # 10 has one profile only, and no pairs; the ones of 70 and more have pairs but no group
    scored = scored.where("a not in (%s)" % ", ".join(repr(name(k)) for k in range(60) if case(k) == 10)).unionByName(spark.createDataFrame([(name(70), name(71), 0.5, True, None, ["x"])], SCORED.format(kind)))
    groups = spark.createDataFrame([(name(k), name(component[k])) for k in range(60) if case(k) != 10 or k == 4], f"profile_id {kind}, component_id {kind}")
    keys = spark.createDataFrame([(name(k), case(k)) for k in range(60)] + [(name(70), 70), (name(71), 70)], f"profile_id {kind}, case_id int")
    return scored, groups, keys


@pytest.mark.parametrize("records", [3, 10_000])
@pytest.mark.parametrize("kind, name", [("long", lambda k: 3 * k), ("string", lambda k: f'p:"{k}"')])
def test_seals_are_those_of_the_whole_texts(spark, kind, name, records):
    given = some(spark, kind, name)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, records)
    try:
        got = {r.case_id: r for r in assembly.correlation_seals(*given).collect()}
    finally:
        spark.conf.set(setting, before)
    whole = {r.case_id: r for r in assembly.sealed_correlation(*given).collect()}
    assert got.keys() == whole.keys() == {None, 7, 8, 9, 10}
    for k, r in whole.items():
        assert (got[k].sha256, got[k].size, got[k].module_name, got[k].artifact_type) == (r.sha256, len(r.raw_data.encode()), r.module_name, r.artifact_type)
        assert got[k].groups == len(json.loads(r.raw_data)["groups"])
        assert got[k].sha256 == hashlib.sha256(r.raw_data.encode()).hexdigest()


def test_no_more_than_a_batch_is_held():
    """A case of many batches passes as a stream."""
    taken = [0]

    def batches():
        row = lambda kind, texts: pa.RecordBatch.from_pydict({"case_id": [1] * len(texts), "kind": [kind] * len(texts), "first": [None] * len(texts), "component_id": [None] * len(texts), "text": texts}, schema=pa.schema([("case_id", pa.int32()), ("kind", pa.int32()), ("first", pa.int64()), ("component_id", pa.int64()), ("text", pa.string())]))
        yield row(0, ['{"case_id":1,"groups":['])
        yield row(1, ["5"])
        for k in range(500):
            taken[0] += 1
            yield row(2, [f'{{"a":{k}}}'] * 10)

    (found,) = [r for b in assembly._written(batches()) for r in b.to_pylist()]
    text = '{"case_id":1,"groups":[[5]],"pairwise":[' + ",".join(f'{{"a":{k}}}' for k in range(500) for _ in range(10)) + "]}"
    assert taken == [500] and found == {"case_id": 1, "groups": 1, "size": len(text), "sha256": hashlib.sha256(text.encode()).hexdigest()}


def test_no_case_is_one_row(spark, sf_dir):
    found = catalogue.QUERIES["sealed_correlation"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "from_json" not in plan and found.columns == ["case_id", "artifact_type", "groups", "sha256"] and found.count() == 25
