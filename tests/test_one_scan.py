"""One scan tells which messages match any rule; the counts stay those of every rule."""

import re

import pytest
from pyspark.sql import functions as F

from casewright.operators import classifier as C


@pytest.mark.parametrize("ascii_only", [False, True])
def test_counts(spark, ascii_only):
    pack = C.RulePack({"a": (0.5, "a", (r"\bhow\s+old\b", r"\bone|two")), "b": (0.5, "b", (r"\bkeep\b", r"[xy]z", r"\b(more|less)\s+of\b"))}, ascii=ascii_only)
    texts = ["how old are you, how OLD", "twotwo", "stone one", "xz keep yz", "nothing", "", "less  of it", "Keep", "howold", "two\nkeep"]
    rows = spark.createDataFrame(list(enumerate(texts)), "profile_id long, text string").withColumn("message_index", F.lit(0))
    found = {r.profile_id: (r.a, r.b) for r in C.message_hits(rows, pack).collect()}
    for k, text in enumerate(texts):
        assert found[k] == tuple(sum(len(re.findall(f"(?i)(?:{p})", text)) for p in pack.rules[c][2]) for c in "ab"), text


def test_one_pattern():
    assert C._any((r"\bab", r"\bc|d")) == r"\b(?:(?:ab))|(?:\bc|d)"
    assert C._any((r"\b(a)\1",)) is None and C._any(()) is None
