"""SimHash near-duplicates by pigeonhole blocks.

64 bits are split into ``3 + r`` blocks; two fingerprints at most 3 bits apart agree on at least ``r`` of
them, so each choice of ``r`` blocks is one equality key. ``r`` grows with the number of different
fingerprints, which keeps the groups of a key small. Groups are compared inside one task and leave only
a spanning forest of links; groups above ``crowd`` members are never gathered but linked through common
neighbours by aggregation, which is linear in their size and just as exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..operators.scratch import Scratch

BITS, NEAR = 64, 3
#: Fingerprints for each value of a key that the choice of blocks aims at.
PER_KEY = 16
#: Groups up to this size are compared inside one task.
CROWD = 16_384
_LOT = 65_536


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles; zero if there is no word."""
    from xxhash import xxh64_digest

    words = data.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    total, set_bits = 0, np.zeros(BITS, np.int64)
    while lot := b"".join(map(xxh64_digest, islice(shingles, _LOT), repeat(seed))):
        rows = np.frombuffer(lot, np.uint8).reshape(-1, 8)
        total += len(rows)
        set_bits += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) per row. Null and empty texts have fingerprint zero; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(r: int) -> list[int]:
    """Signed masks of every choice of ``r`` of the ``NEAR + r`` blocks."""
    edges = [round(k * BITS / (NEAR + r)) for k in range(NEAR + r + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(choice)) for choice in combinations(blocks, r)]


def blocks_for(n: int) -> int:
    """How many blocks must agree so that ``n`` fingerprints spread over enough keys."""
    return next((r for r in range(1, 5) if n <= PER_KEY << (BITS * r // (NEAR + r))), 5)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)) <= NEAR


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one group, breadth first."""
    out, left = [], np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            hit = _near(fp[left], fp[k])
            found = left[hit]
            left = left[~hit]
            out += [(int(fp[k]), int(fp[j])) for j in found]
            queue += found.tolist()
    return out


def _linked_runs(first: np.ndarray, last: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Which runs [first, last) of equal keys hold a near pair; short runs are compared all at once."""
    size = last - first
    hit = size > 32
    for d in range(1, 32):
        runs = np.flatnonzero((size > d) & (size <= 32))
        if not len(runs):
            break
        pairs = np.repeat(first[runs], size[runs] - d) + _ramp(size[runs] - d)
        hit[np.repeat(runs, size[runs] - d)[_near(fp[pairs], fp[pairs + d])]] = True
    return hit


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _links_in_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest links of every key of rows (which, key, fp) sorted by which and key."""
    rest = [np.empty(0, np.int64)] * 3

    def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
        which, key, fp = rows
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (which[1:] != which[:-1])])
        ends = np.r_[starts[1:], len(key)]
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(_linked_runs(starts, ends, fp)):
            out += _forest(fp[starts[k] : ends[k]])
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    for batch in batches:
        rows = [np.concatenate([old, np.asarray(new, np.int64)]) for old, new in zip(rest, (c.to_numpy(zero_copy_only=False) for c in batch.columns), strict=True)]
        if not len(rows[0]):
            continue
        open_run = np.flatnonzero((rows[1] != rows[1][-1]) | (rows[0] != rows[0][-1]))
        cut = open_run[-1] + 1 if len(open_run) else 0
        rest = [x[cut:] for x in rows]
        if cut:
            yield emit([x[:cut] for x in rows])
    if len(rest[0]):
        yield emit(rest)


def _crowded_links(rows: DataFrame, masks: list[int], scratch: Scratch) -> DataFrame:
    """Links inside crowded keys. Every row is sent to the values at most two flips away (outside its
    key); a value that some row reaches with at most one flip joins all rows that reach it, each of them
    being within three flips of that row. Two rows three flips apart always share such a value."""
    flips = []
    for mask in masks:
        free = [_signed(1 << b) for b in range(BITS) if not mask >> b & 1]
        flips.append([0, *free, *(a ^ b for a, b in combinations(free, 2))])
    sent = None
    for which, values in enumerate(flips):
        near = len([b for b in range(BITS) if not masks[which] >> b & 1]) + 1
        part = rows.where(F.col("which") == which).select("which", "key", "fp", F.posexplode(F.array(*map(F.lit, values))).alias("k", "flip"))
        part = part.select("which", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"), (F.col("k") < near).alias("near"))
        sent = part if sent is None else sent.unionByName(part)
    hubs = sent.groupBy("which", "key", "hub").agg(F.min("fp").alias("src"), F.max("near").alias("near"), F.count("*").alias("n")).where("near and n > 1")
    return scratch.keep(sent.join(hubs.select("which", "key", "hub", "src"), ["which", "key", "hub"]).where("src <> fp").select("src", F.col("fp").alias("dst")).distinct(), "crowded")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most three differing bits. Equal
    fingerprints are collapsed before any comparison, so copies cost one row. Null and empty texts have
    fingerprint zero and link with each other like any others. Rows with a null doc_id carry no links of
    their own; they get the component of the rows that share their fingerprint, else null. Rows that
    share a doc_id are linked by it only through their fingerprints. Texts of any length are hashed
    whole, in lots of shingles. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.keep(fingerprints(docs, doc_id, text), "fingerprints")
    reps = scratch.keep(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    masks = block_masks(blocks_for(reps.count()))
    keyed = reps.select("fp", F.posexplode(F.array(*map(F.lit, masks))).alias("which", "mask")).select("which", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    sizes = scratch.keep(keyed.groupBy("which", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = keyed.join(sizes, ["which", "key"]).select("which", "key", "fp", "n")
    plain = shared.where(F.col("n") <= crowd).select(F.col("which").cast("long").alias("which"), "key", "fp")
    links = plain.repartition("which", "key").sortWithinPartitions("which", "key").mapInArrow(_links_in_sorted, "src long, dst long")
    if not sizes.where(F.col("n") > crowd).isEmpty():
        links = links.unionByName(_crowded_links(shared.where(F.col("n") > crowd), masks, scratch))
    labels = connected_components(links, scratch).select(F.col("node").alias("fp"), "component")
    grouped = scratch.keep(reps.join(labels, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "grouped")
    lowest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = scratch.keep(grouped.join(lowest, "component").select("fp", "component_id"), "labels")
    return fps.join(known, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
