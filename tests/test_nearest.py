"""Nearest rows under a predicate on their other columns, against a search over all of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import correlation


@pytest.mark.parametrize("block", [7, 100_000])
def test_predicate(spark, block):
    rng = random.Random(block)
    rows = [(k, k % 2, [rng.gauss(0, 1) for _ in range(6)], rng.choice(["a", "b", None])) for k in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, source string")
    got = [tuple(r) for r in correlation.nearest(table.where("vec_id < 10"), table, 3, block, F.col("source") == "a").select("query_id", "rank", "vec_id").collect()]
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.hypot(*x) / math.hypot(*y)
    want = []
    for q, label, e, _ in rows[:10]:
        near = sorted((-cosine(e, f), k) for k, other, f, source in rows if other == label and k != q and source == "a")
        want += [(q, rank, k) for rank, (_, k) in enumerate(near[:3], 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("block", "asked"), [(7, 3), (100_000, 16_384)])
def test_equals_row_by_row(spark, monkeypatch, block, asked):
    """Copies, zero, null, short and infinite vectors rank as the plain expression ranks them."""
    monkeypatch.setattr(correlation, "ASKED", asked)
    rng = random.Random(1)
    vectors = [[rng.choice([-1.0, 0.5, 3.0]) for _ in range(4)] for _ in range(40)] + [[0.0] * 4, None, [1.0, None, 2.0, 1.0], [1.0], [float("inf"), 1.0, 1.0, 1.0], [1e-180] * 4, [1e180] * 4]
    rows = [(k, [0, 1, None][k % 7 % 3], vectors[k % len(vectors)]) for k in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    q, r = table.where("vec_id % 3 = 0").alias("q"), table.alias("r")
    met = q.join(r, (F.col("q.label") == F.col("r.label")) & (F.col("q.vec_id") != F.col("r.vec_id")))
    every = met.select(F.col("q.vec_id").alias("query_id"), F.col("r.vec_id").alias("vec_id"), correlation.X.cosine(F.col("q.embedding"), F.col("r.embedding")).alias("similarity"))
    want = every.withColumn("rank", F.row_number().over(correlation.Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where("rank <= 4")
    plain = lambda df: sorted((x.query_id, x.rank, x.vec_id, str(x.similarity)) for x in df.collect())
    assert plain(correlation.nearest(table.where("vec_id % 3 = 0"), table, 4, block)) == plain(want)
