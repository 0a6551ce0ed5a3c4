"""Connected components by contraction, entirely as joins and aggregations.

Each round points every node at its smallest smaller neighbour, doubles the pointers until they end in
roots, and replaces both ends of every edge by their roots. Rounds stop when no edge is left. All state
is a table in the shared scratch folder; nothing is gathered on the driver but one count a step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that is not the smallest of its component.

    ``edges`` is undirected; self loops and repeats are allowed, rows with a null end are ignored.
    Callers ``coalesce`` the missing nodes to themselves. A hub costs no more than its edge count: the
    minimum is combined map-side, and the joins leave edge sides free for adaptive skew splitting.
    """
    a, b = F.col(src), F.col(dst)
    edges = scratch.keep(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges"
    )
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ptr = scratch.keep(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), "up")
        while True:
            far = ptr.select(F.col("node").alias("up"), F.col("up").alias("further"))
            jumped = scratch.keep(ptr.join(far, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "jump")
            scratch.drop(ptr)
            ptr = jumped
            if ptr.where("moved").isEmpty():
                break
        ptr = _tracked(ptr.select("node", "up"), jumped)
        lo = ptr.select(F.col("node").alias("lo"), F.col("up").alias("lo_root"))
        hi = ptr.select(F.col("node").alias("hi"), F.col("up").alias("hi_root"))
        moved = edges.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b"))
        fresh = scratch.keep(moved.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
        scratch.drop(edges)
        edges = fresh
        rounds.append(ptr)
    if not rounds:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))

    def follow(low: DataFrame, high: DataFrame) -> DataFrame:
        """Labels of earlier rounds carried on to the roots of the next round, plus that round's own."""
        step = high.select(F.col("node").alias("up"), F.col("up").alias("further"))
        return low.join(step, "up", "left").select("node", F.coalesce("further", "up").alias("up")).unionByName(high.select("node", "up"))

    return reduce(follow, rounds).select("node", F.col("up").alias("component"))


def _tracked(df: DataFrame, kept: DataFrame) -> DataFrame:
    df._casewright_path = kept._casewright_path
    return df


class GrowingComponents:
    """Components of edges that come in batches.

    State is a forest that is only appended to: one row (node, up) for each node that has stopped being the
    smallest of its component, in a partition of the batch in which it did. A batch looks up the roots of its own
    ends, contracts the edges between roots and writes the roots that lost; components without a new edge
    are neither read beyond that lookup nor written. Batches in any order give the same components.
    """

    def __init__(self, scratch: Scratch, kind: str = "long"):
        self._scratch, self._kind = scratch, kind
        self._spark = scratch.spark
        self._path, self._batches = scratch.path("forest"), 0

    def _forest(self) -> DataFrame:
        schema = f"node {self._kind}, up {self._kind}, batch int"
        return self._spark.read.schema(schema).parquet(self._path) if self._batches else self._spark.createDataFrame([], schema)

    def _roots(self, nodes: DataFrame) -> DataFrame:
        """(node, root) of distinct nodes; a chain of the forest has at most one step for each batch."""
        here = self._scratch.keep(nodes.withColumn("root", F.col("node")), "roots")
        step = self._forest().select(F.col("node").alias("root"), "up")
        while self._batches:
            moved = self._scratch.keep(here.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
            self._scratch.drop(here)
            here = moved
            if here.where("moved").isEmpty():
                break
        return here.select("node", "root")

    def add(self, edges: DataFrame, src: str = "src", dst: str = "dst") -> int:
        """Take a batch of undirected edges; the number of rows that it wrote."""
        kept = self._scratch.keep(edges.select(F.col(src).cast(self._kind).alias("a"), F.col(dst).cast(self._kind).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "batch")
        roots = self._roots(kept.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        between = kept.join(roots.select(F.col("node").alias("a"), F.col("root").alias("src")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("dst")), "b")
        lost = connected_components(between.select("src", "dst"), self._scratch)
        at = f"{self._path}/batch={self._batches}"
        lost.select("node", F.col("component").alias("up")).write.parquet(at)
        self._batches += 1
        return self._spark.read.parquet(at).count()

    def labels(self) -> DataFrame:
        """(node, component) for every node that is not the smallest of its component."""
        return self._roots(self._forest().select("node")).select("node", F.col("root").alias("component"))
