"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many random lines. On each line they are sorted, and a query's window holds the
vectors close to it there; a pair whose number of common windows over all lines reaches a count
calibrated for recall is verified by its cosine. Window counts alone would be quadratic: two unrelated
vectors still share every fourth window. So the sorted list of a line is cut into cells by the signs of a
few further projections, more of them the more vectors a label has, and so many lines are cut that a pair
at the threshold is missed with a chance below ``1 - RECALL``.

Equal vectors are one candidate. Windows are counted on projections rounded to a byte each, which travel
instead of the vectors; only vectors with a partner that passes the count are fetched and compared.
Long lists are cut into tiles that are compared pair by pair of tiles in different tasks; each returns
link counts and a forest of links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..operators.scratch import Scratch

#: Chance that a pair exactly at the threshold meets in a cell and window, and passes both counts.
RECALL = 0.9995
#: Half-width of a query's window on a sorted line, and of a counted one, in standard deviations of the
#: projected distance of a pair at the threshold.
REACH, WINDOW = 2.5, 1.0
#: Lines whose windows are counted, and those counted first.
LINES, FIRST = 64, 16
#: Steps of a rounded projection for one unit of length.
STEPS = 32
#: Vectors that a cell should hold, and most that are compared as one tile.
CELL, TILE = 2048, 2048
_SEED = 20240717


class Plan(NamedTuple):
    """Cut lines, sign bits for each line's cells, counted lines, least counts (of the first lines, of all),
    half-widths of windows (sorted, counted)."""

    cuts: int
    bits: int
    lines: int
    least: tuple[int, int]
    reach: float
    window: float


def _least(lines: int, inside: float, miss: float) -> int:
    """The largest count that a pair at the threshold fails with a chance of at most ``miss``."""
    fails, count = 0.0, 0
    while fails + (p := math.comb(lines, count) * inside**count * (1 - inside) ** (lines - count)) <= miss:
        fails, count = fails + p, count + 1
    return max(count, 1)


@lru_cache(maxsize=256)
def plan_for(bits: int, threshold: float) -> Plan:
    """The smallest number of cut lines that reaches ``RECALL`` with cells of ``bits`` signs."""
    distance, miss = math.sqrt(max(0.0, 2 - 2 * threshold)), (1 - RECALL) / 3
    met = (1 - math.acos(threshold) / math.pi) ** bits * (2 * NormalDist().cdf(REACH) - 1)
    cuts = max(2, math.ceil(math.log(miss) / math.log(1 - met)))
    lines, inside = max(LINES, cuts), 2 * NormalDist().cdf(WINDOW) - 1
    return Plan(cuts, bits, lines, (_least(FIRST, inside, miss), _least(lines, inside, miss)), REACH * distance, WINDOW * distance)


@lru_cache(maxsize=64)
def _directions(plan: Plan, size: int) -> np.ndarray:
    """Gaussian directions: the lines first, then ``bits`` sign directions for each cut line."""
    return np.random.default_rng(_SEED).standard_normal((plan.lines + plan.cuts * plan.bits, size)).T.copy()


def _projected(plan: Plan, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions on the lines, cells on the cut lines)."""
    seen = unit @ _directions(plan, unit.shape[1])
    signs = (seen[:, plan.lines :] >= 0).reshape(len(unit), plan.cuts, plan.bits)
    return seen[:, : plan.lines], signs @ (1 << np.arange(plan.bits, dtype=np.int64))


def _rounded(spots: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(spots * STEPS), -127, 127).astype(np.int8)


def _unit(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    rows = np.concatenate([np.asarray(x.values, np.float64) for x in column]).reshape(-1, size)
    # scaled first, so that no square overflows or vanishes
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


_PLACE = "group long, key long, shape long, rep long, signature binary"
#: Bits for the cell in a key, for the signs in a shape, and for the side in a marked rep.
_CELL_BITS, _SIGN_BITS = 32, 6


def _places(threshold: float, keys_only: bool):
    """(rep, vector, group, bits, size) to one row for each cut line: the key of its line and cell, and as
    signature the rounded projections and the cells on all cut lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = batch.column(4).to_numpy().astype(np.int64) << _SIGN_BITS | batch.column(3).to_numpy()
            for shape in np.unique(shapes).tolist():
                plan, mine = plan_for(shape & (1 << _SIGN_BITS) - 1, threshold), np.flatnonzero(shapes == shape)
                for at in range(0, len(mine), 1024):
                    part = batch.take(pa.array(mine[at : at + 1024]))
                    n = part.num_rows
                    spots, cells = _projected(plan, _unit(part.column(1), shape >> _SIGN_BITS))
                    key = np.tile(np.arange(plan.cuts) << _CELL_BITS, n) + cells.ravel()
                    group, rep = (np.repeat(part.column(k).to_numpy(), plan.cuts) for k in (2, 0))
                    if keys_only:
                        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(key)], names=["group", "key"])
                        continue
                    places = cells.astype(_cell_kind(plan)).view(np.uint8).reshape(n, -1)
                    signature = [x.tobytes() for x in np.hstack([_rounded(spots).view(np.uint8), places])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group), pa.array(key), pa.array(np.full(len(key), shape)), pa.array(rep), pa.array([x for x in signature for _ in range(plan.cuts)], pa.binary())], names=["group", "key", "shape", "rep", "signature"]
                    )

    return run


def _cell_kind(plan: Plan) -> str:
    return "<u1" if plan.bits <= 8 else "<u4"


def _tile(rows: pa.Table, threshold: float) -> tuple[pa.Table, Plan, int, int, np.ndarray | None]:
    """The rows of one tile pair by rep, its plan, vector length and line, and the sides of the rows if
    they are from two different tiles."""
    rows = rows.take(pa.array(np.argsort(rows.column("marked").to_numpy(), kind="stable")))
    pair, shape = rows.column("pair")[0].as_py(), rows.column("shape")[0].as_py()
    side = None if pair >> 32 == pair & 0xFFFFFFFF else rows.column("marked").to_numpy() & 1
    return rows, plan_for(shape & (1 << _SIGN_BITS) - 1, threshold), shape >> _SIGN_BITS, rows.column("key")[0].as_py() >> _CELL_BITS, side


def _windows(on_line: np.ndarray, reach: float, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that lie in each other's window on a line, in lots; each is seen from its lower end."""
    sweep = np.argsort(on_line, kind="stable")
    spots = on_line[sweep]
    for lo in range(0, len(sweep), 128):
        mine = sweep[lo : lo + 128]
        end = np.searchsorted(spots, spots[min(lo + 127, len(sweep) - 1)] + reach, "right")
        other = sweep[lo:end]
        ok = spots[lo:end][None, :] - spots[lo : lo + len(mine)][:, None] <= reach
        ok &= np.arange(lo, lo + len(mine))[:, None] < np.arange(lo, end)[None, :]
        if side is not None:
            ok &= side[mine][:, None] != side[other][None, :]
        a, b = np.nonzero(ok)
        for at in range(0, len(a), 1 << 15):
            yield mine[a[at : at + (1 << 15)]], other[b[at : at + (1 << 15)]]


def _promising(threshold: float):
    """The rows of a tile pair with a partner that passes the counts on rounded projections and has not
    surely met it on an earlier line. Rounding can add partners, never lose one."""

    def run(rows: pa.Table) -> pa.Table:
        rows, plan, _, line, side = _tile(rows, threshold)
        data = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        marks = np.ascontiguousarray(data[:, : plan.lines]).view(np.int8).astype(np.int16)
        cells = np.ascontiguousarray(data[:, plan.lines :]).view(_cell_kind(plan))
        wide, narrow = (math.floor(x * STEPS) + 1 for x in (plan.reach, plan.window))
        sure = plan.reach * STEPS - 1
        chosen = np.zeros(rows.num_rows, bool)
        for x, y in _windows(marks[:, line], wide, side):
            few = (np.abs(marks[x, :FIRST] - marks[y, :FIRST]) <= narrow).sum(axis=1) >= plan.least[0]
            x, y = x[few], y[few]
            many = (np.abs(marks[x] - marks[y]) <= narrow).sum(axis=1) >= plan.least[1]
            x, y = x[many], y[many]
            before = (cells[x, :line] == cells[y, :line]) & (np.abs(marks[x, :line] - marks[y, :line]) <= sure) & (np.abs(marks[x, :line]) < 127) & (np.abs(marks[y, :line]) < 127)
            new = ~before.any(axis=1)
            chosen[x[new]] = chosen[y[new]] = True
        return rows.select(["group", "key", "pair", "shape", "marked"]).filter(pa.array(chosen))

    return run


def _compare(threshold: float):
    """All pairs of one tile, or of two tiles, that meet first on this line: link counts and forest."""

    def run(rows: pa.Table) -> pa.Table:
        rows, plan, size, line, side = _tile(rows, threshold)
        rep, times = rows.column("marked").to_numpy() >> 1, rows.column("times").to_numpy()
        unit = _unit(rows.column("vector").combine_chunks(), size)
        spots, cells = _projected(plan, unit)
        n, links, root = len(rep), np.zeros(len(rep), np.int64), np.arange(len(rep))
        for x, y in _windows(spots[:, line], plan.reach, side):
            few = (np.abs(spots[x, :FIRST] - spots[y, :FIRST]) <= plan.window).sum(axis=1) >= plan.least[0]
            x, y = x[few], y[few]
            many = (np.abs(spots[x] - spots[y]) <= plan.window).sum(axis=1) >= plan.least[1]
            x, y = x[many], y[many]
            new = ~((cells[x, :line] == cells[y, :line]) & (np.abs(spots[x, :line] - spots[y, :line]) <= plan.reach)).any(axis=1)
            x, y = x[new], y[new]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[near], y[near]
            np.add.at(links, x, times[y])
            np.add.at(links, y, times[x])
            if len(x):
                root = _hooked(root, x, y)
        linked = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.table({"rep": rep[linked], "links": links[linked], "root": rep[root[linked]]})

    return run


def _hooked(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` with the links x - y added; every index points at the smallest of its component."""
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            return root
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def near_duplicates(rows: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per input row.

    Vectors link if their labels are equal and not null and their cosine, in double precision, reaches
    ``threshold``. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different length. ``component_id`` is the smallest vec_id reachable, the
    own one included; rows with a null vec_id have no links and a null component and are not kept.
    Repeated rows are vectors like any others and link with each other. Vectors may have any length.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "embeddings")
    element = getattr(rows.schema[vector].dataType, "elementType", None)
    kind = "float" if element is not None and element.simpleString() == "float" else "double"
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"), F.col(label).cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False)) & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(valid, F.col("vector")))
    same = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("times"))
    same = scratch.keep(same.withColumn("rep", F.monotonically_increasing_id()).withColumn("size", F.size("vector")), "distinct")
    # vectors of one label and length are a group; its number of vectors decides how finely it is cut
    groups = same.groupBy("label", "size").agg(F.count("*").alias("n")).where("n > 1").select("label", "size", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL))).cast("int").alias("bits"))
    placed = same.join(groups, ["label", "size"]).select("rep", "vector", F.xxhash64("label", "size").alias("group"), "bits", "size")
    keys = placed.mapInArrow(_places(threshold, True), "group long, key long")
    large = scratch.keep(keys.groupBy("group", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("group", "key", F.ceil(F.col("n") / TILE).cast("long").alias("tiles")), "large")
    dealt = placed.mapInArrow(_places(threshold, False), _PLACE).join(large, ["group", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    # every tile meets itself and each other tile of its list once
    met = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pair, side = F.shiftleft(F.least("tile", "mate"), 32).bitwiseOR(F.greatest("tile", "mate")), (F.col("tile") > F.col("mate")).cast("long")
    met = met.select("group", "key", pair.alias("pair"), "shape", F.shiftleft("rep", 1).bitwiseOR(side).alias("marked"), "signature")
    found = met.groupBy("group", "key", "pair").applyInArrow(_promising(threshold), "group long, key long, pair long, shape long, marked long")
    found = scratch.keep(found, "promising")
    scratch.sweep()
    known = same.select(F.col("rep").alias("__rep"), "vector", "times")
    pairs = found.join(known, F.shiftright("marked", 1) == F.col("__rep")).drop("__rep").groupBy("group", "key", "pair").applyInArrow(_compare(threshold), "rep long, links long, root long")
    pairs = scratch.keep(pairs, "pairs")

    links = pairs.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(pairs.select(F.col("rep").alias("src"), F.col("root").alias("dst")), scratch).select(F.col("node").alias("rep"), "component")
    every = same.select("label", "vector", "rep", "lowest", "times").join(links, "rep", "left").join(parts, "rep", "left")
    every = scratch.keep(every.select("label", "vector", "lowest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "every")
    first = every.groupBy("component").agg(F.min("lowest").alias("component_id"))
    out = rows.join(every.join(first, "component").select("label", "vector", "links", "component_id"), ["label", "vector"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
