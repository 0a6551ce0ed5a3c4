"""Removal of long repeats with a logarithmic family of sampled suffix arrays.

Only sampled suffixes are kept: every 100-byte window is sampled at its smallest 32-byte gram, so equal
windows are sampled at the same place, the anchor, and one suffix stands for some thirty windows, its
block: at most 68 bytes before the anchor and 100 from it on. A suffix array is a table of suffixes in
the order of their bytes, cut into parts by the gram.

A new batch is sorted together with the arrays of all existing levels, and one scan over the sorted rows
measures how many bytes each suffix shares with the one before it. Suffixes that share the whole gram may
match. Of equal blocks (told by a fingerprint of all their bytes) all but the earliest are repeats as a
whole; in the same scan levels of equal size merge with the batch into one level of the next size, like
a binary counter. Different blocks around one gram match in part at most. Their bytes are fetched at the
end and put in order twice, forwards from the anchor and backwards before it; the common lengths of
neighbours in both orders tell for every window which blocks hold it, byte by byte. Grams with very many
different blocks are dealt out window by window instead, by two hashes of the window, so that a frequent
gram spreads over all tasks.

Spark sorts, spills and deals the rows; the scans stream over them and hold one gram at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.scratch import Scratch
from . import grams
from .pieces import in_small_lots

#: Grams with more different blocks than this are compared window by window.
CROWD = 1 << 15
#: Bytes of text whose suffixes one task should sort.
PART = 128 << 20
#: Longest stretch of a block before its anchor, and from it on.
_BACK, _FORE = grams.WINDOW - grams.GRAM, grams.WINDOW
#: Entries gathered in a task before their repeats are settled.
_LOT = 1 << 17

# Kinds of rows. An entry is a suffix: ``at`` packs its position, block and role, ``what`` is the block's
# fingerprint. A repeat is a stretch of bytes from ``at`` to ``what``. Open and crowded rows are blocks
# still to be compared, ``at`` as in an entry and ``what`` a hash of the gram. A window is an entry
# whose gram is one of its hashes, ``what`` the other and ``at`` its start.
_ENTRY, _REPEAT, _OPEN, _CROWDED = 0, 1, 2, 3
_ROW = "kind int, gram binary, doc long, at long, what long"
_SCHEMA = pa.schema([("kind", pa.int32()), ("gram", pa.binary()), ("doc", pa.int64()), ("at", pa.int64()), ("what", pa.int64())])
# Roles in a merge: levels that are only read, levels that join the new one, the batch.
_READ, _JOINS, _NEW = 0, 1, 2


def _packed(pos: np.ndarray, back: np.ndarray, fore: np.ndarray, role: int = _NEW) -> np.ndarray:
    """Position of the anchor, distances back to the block's first and last window, role."""
    return pos.astype(np.int64) << 24 | back.astype(np.int64) << 16 | fore.astype(np.int64) << 8 | role


def _place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, at >> 16 & 255, at >> 8 & 255


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _stretches(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges [lo, hi) by document; overlapping and touching ranges become one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(doc):
        return doc, lo, hi
    base = np.cumsum(_first_of(doc)) * (1 << 33)  # keeps one document's ends below the next one's starts
    reach = np.maximum.accumulate(hi + base)
    new = np.ones(len(doc), bool)
    new[1:] = (lo + base)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], lo[at], (reach - base)[np.r_[at[1:], len(doc)] - 1]


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equally many bytes as a binary column."""
    n, width = rows.shape
    ends = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(kind: int, doc: np.ndarray, at: np.ndarray, what: np.ndarray, gram: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(doc)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.binary()) if gram is None else _binary(gram), *(pa.array(x, pa.int64()) for x in (doc, at, what))]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows in parts by gram, those without one by document, each part in order of its suffixes."""
    return rows.repartition(parts, F.when(F.col("kind") == _ENTRY, F.xxhash64("gram")).otherwise(F.col("doc"))).sortWithinPartitions("gram", "what", "doc", "at")


def _repeats(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    doc, lo, hi = _stretches(doc, lo, hi)
    return _rows(_REPEAT, doc, lo, hi)


def _covered(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Stretches of bytes that the windows of whole blocks cover."""
    pos, back, fore = _place(at)
    return _repeats(doc, pos - back, pos - fore + grams.WINDOW)


def _sampled_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, data) to the sampled suffixes, one for each different block of a lot, and the lot's repeats."""

    def settled(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, gram, doc, at, what = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, what, key))
        first = _first_of(key[order], what[order])
        again, kept = order[~first], order[first]
        yield _covered(doc[again], at[again])
        for lo in range(0, len(kept), 1 << 15):
            k = kept[lo : lo + (1 << 15)]
            yield _rows(_ENTRY, doc[k], at[k], what[k], gram[k])

    parts: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1)
        for lot in in_small_lots([x.as_buffer().size for x in texts], sizes=True):
            for segment in grams.segments(texts.slice(lot.start, lot.stop - lot.start).to_pylist()):
                at, first, last = grams.sampled(segment.h32, segment.starts())
                owner, pos = segment.locate(at)
                what = grams.block_hashes(segment.h64, at, first, last).view(np.int64)
                parts.append([segment.h32[at], segment.bytes_at(at), docs[lot][owner].astype(np.int64), _packed(pos, at - first, at - last), what])
                held += len(at)
            if held > _LOT:
                yield from settled(parts)
                parts, held = [], 0
    if parts:
        yield from settled(parts)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """gram (as rows of bytes), doc, at, what of entries."""
    gram = batch.column(1)
    ends = np.frombuffer(gram.buffers()[1], np.int32, len(gram) + 1, 4 * gram.offset)
    rows = np.frombuffer(gram.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(gram), -1)
    return [rows, *(batch.column(k).to_numpy() for k in (2, 3, 4))]


def _common(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before it; -1 for the first."""
    out = np.full(len(rows), -1)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        out[1:] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return out


def _merge_scan(crowd: int, lasting: bool = True):
    """Rows sorted by gram, fingerprint and place to repeats, open blocks and, if the level is to last, the
    entries of the new level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[np.ndarray] | None = None  # the last row of the batch before
        held: list[np.ndarray] | None = None  # different blocks of the gram that the batch before ended in
        crowded = False  # whether that gram has shown more than ``crowd`` of them already

        def blocks_of(kind: int, blocks: list[np.ndarray]) -> pa.RecordBatch:
            gram, doc, at, _ = blocks
            return _rows(kind, doc, at, grams.hashed(gram))

        def compared(blocks: list[np.ndarray]) -> pa.RecordBatch:
            """Grams with several blocks; nothing to compare if none of them is new."""
            group = np.cumsum(_common(blocks[0]) < grams.GRAM) - 1
            use = ((np.bincount(group) > 1) & (np.bincount(group, blocks[2] & 3 == _NEW) > 0))[group]
            return blocks_of(_OPEN, [x[use] for x in blocks])

        for batch in batches:
            entry = batch.column(0).to_numpy() == _ENTRY
            if not entry.all():
                yield batch.filter(pa.array(~entry))
                batch = batch.filter(pa.array(entry))
            if not batch.num_rows:
                continue
            rows = _columns(batch)
            seen = rows if before is None else [np.concatenate(x) for x in zip(before, rows, strict=True)]
            skip = 0 if before is None else 1
            same_gram = _common(seen[0])[skip:] == grams.GRAM
            first = ~same_gram
            first[1 - skip :] |= seen[3][1:] != seen[3][:-1]
            gram, doc, at, what = rows
            again = ~first & (at & 3 == _NEW)
            yield _covered(doc[again], at[again])
            if lasting:
                stays = first & (at & 3 > _READ)
                yield _rows(_ENTRY, doc[stays], at[stays], what[stays], gram[stays])
            before = [x[-1:] for x in rows]

            turn = np.flatnonzero(~same_gram)  # where a gram begins
            blocks = [x[first] for x in rows]
            of_old = int(first[: turn[0]].sum()) if len(turn) else len(blocks[0])
            if of_old:
                old = [x[:of_old] for x in blocks]
                if crowded:
                    yield blocks_of(_CROWDED, old)
                else:
                    held = old if held is None else [np.concatenate(x) for x in zip(held, old, strict=True)]
            if held is not None and len(held[0]) > crowd:
                yield blocks_of(_CROWDED, held)
                held, crowded = None, True
            if len(turn):
                if held is not None:
                    yield compared(held)
                last = int(first[: turn[-1]].sum())
                whole, held, crowded = [x[of_old:last] for x in blocks], [x[last:] for x in blocks], False
                if len(whole[0]):
                    sizes = np.diff(np.r_[np.flatnonzero(_common(whole[0]) < grams.GRAM), len(whole[0])])
                    large = np.repeat(sizes > crowd, sizes)
                    yield blocks_of(_CROWDED, [x[large] for x in whole])
                    yield compared([x[~large] for x in whole])
                if len(held[0]) > crowd:
                    yield blocks_of(_CROWDED, held)
                    held, crowded = None, True
        if held is not None:
            yield compared(held)

    return run


class SuffixFamily:
    """Levels of sampled suffix arrays over the batches added so far, in ascending order of document.

    ``add`` returns what the batch's merge found: repeats in it, and blocks of old and new documents that
    are still to be compared. An array is cut into ``parts`` by gram.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, parts: int, crowd: int = CROWD):
        self.spark, self.scratch, self.parts, self.crowd = spark, scratch, parts, crowd
        self.levels: dict[int, DataFrame] = {}

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """``batch`` has doc (long, not null, larger than in earlier batches) and data (binary). With the
        ``last`` batch the levels are scanned and dropped, and no new one is written."""
        rows = batch.select("doc", "data").mapInArrow(_sampled_suffixes, _ROW)
        size = next(k for k in range(len(self.levels) + 1) if k not in self.levels)
        for k, level in self.levels.items():
            role = _JOINS if k < size else _READ
            rows = rows.unionByName(level.where(F.col("kind") == _ENTRY).withColumn("at", F.col("at").bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(role))))
        merged = _dealt(rows, self.parts).mapInArrow(_merge_scan(self.crowd, not last), _ROW)
        if not last:
            merged = self.scratch.keep(merged, f"level{size}", compression="zstd")
        found = self.scratch.keep(merged.where(F.col("kind") != _ENTRY).drop("gram"), "found")
        self.scratch.drop(*(self.levels.pop(k) for k in (list(self.levels) if last else range(size))))
        if not last:
            self.levels[size] = merged
        del rows, merged
        self.scratch.sweep()
        return found


_BLOCK = "key long, doc long, at long, ahead binary, behind binary"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, data, open blocks) to the bytes of each block from its anchor on, and backwards before it."""
    for whole in batches:
        for lot in in_small_lots([x.as_buffer().size for x in whole.column(1)], sizes=True):
            batch = whole.slice(lot.start, lot.stop - lot.start)
            out: list[list] = [[], [], [], [], []]
            for doc, data, blocks in zip(*(batch.column(k) for k in range(3)), strict=True):
                data, doc, blocks = data.as_buffer().to_pybytes(), doc.as_py(), blocks.values
                at = blocks.field(1).to_numpy()
                for key, packed, pos, back, fore in zip(blocks.field(0).to_pylist(), at.tolist(), *(x.tolist() for x in _place(at)), strict=True):
                    for column, x in zip(out, (key, doc, packed, data[pos : pos - fore + grams.WINDOW], data[pos - back : pos][::-1]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(),) * 3 + (pa.binary(),) * 2, strict=True)], names=["key", "doc", "at", "ahead", "behind"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values as rows of ``width`` bytes, filled up with zeros."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    sizes = np.diff(ends)
    out = np.zeros((len(column), width), np.uint8)
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    into = np.repeat(np.arange(len(column)) * width - (ends[:-1] - ends[0]), sizes) + np.arange(len(flat))
    out.ravel()[into] = flat
    return out


def _later_windows(key: np.ndarray, doc: np.ndarray, at: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows of blocks that an earlier block of the same key holds as well.

    Rows come in the order of key and ``ahead``. The window that starts ``d`` bytes before the anchor is
    equal in two blocks if they share ``d`` bytes backwards and ``WINDOW - d`` forwards; blocks that do
    stand together in either order, between neighbours that share too little.
    """
    n, new = len(key), _first_of(key)
    forwards = np.where(new, -1, _common(ahead))
    order = np.lexsort([*behind.view(">u8").T[::-1], key])
    backwards = np.where(_first_of(key[order]), -1, _common(behind[order]))
    pos, back, fore = _place(at)
    oldest = np.lexsort((at, doc))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    group = np.empty(n, np.int64)
    for d in range(_BACK + 1):
        use = oldest[((fore <= d) & (d <= back))[oldest]]
        if len(use) > 1:
            group[order] = np.cumsum(backwards < d)
            same = (np.cumsum(forwards < grams.WINDOW - d) * (n + 1) + group)[use]
            again = np.ones(len(use), bool)
            again[np.unique(same, return_index=True)[1]] = False
            found.append((doc[use[again]], pos[use[again]] - d))
            held += int(again.sum())
        if found and (held > _LOT or d == _BACK):
            docs, start = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _repeats(docs, start, start + grams.WINDOW)
            found, held = [], 0


def _compared_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by key and bytes from the anchor on: the repeats among those of one key."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [*(batch.column(k).to_numpy() for k in range(3)), _matrix(batch.column(3), _FORE), _matrix(batch.column(4), -(-_BACK // 8) * 8)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        cut = int(np.flatnonzero(_first_of(rows[0]))[-1])
        held = [x[cut:] for x in rows]
        if cut:
            yield from _later_windows(*(x[:cut] for x in rows))
    if held is not None:
        yield from _later_windows(*held)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, data, crowded blocks) to two hashes of each of their windows, repeats in the lot settled."""
    for whole in batches:
        for lot in in_small_lots([x.as_buffer().size for x in whole.column(1)], sizes=True):
            batch = whole.slice(lot.start, lot.stop - lot.start)
            parts = []
            for doc, data, blocks in zip(*(batch.column(k) for k in range(3)), strict=True):
                data, doc = data.as_buffer(), doc.as_py()
                pos, back, fore = _place(blocks.values.field(1).to_numpy())
                for lo, hi in zip((pos - back).tolist(), (pos - fore).tolist(), strict=True):
                    h32, h64 = grams.gram_hashes(np.frombuffer(data[lo : hi + grams.WINDOW], np.uint8))
                    at = np.arange(hi - lo + 1)
                    parts.append([*grams.window_hashes(h32, h64, at), np.full(len(at), doc, np.int64), at + lo])
            if parts:
                one, two, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((start, doc, two, one))
                first = _first_of(one[order], two[order])
                again, kept = order[~first], order[first]
                yield _repeats(doc[again], start[again], start[again] + grams.WINDOW)
                yield _rows(_ENTRY, doc[kept], start[kept], two[kept].view(np.int64), one[kept].view(np.uint8).reshape(-1, 8))


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by their hashes and place: all but the first of each are repeats."""
    last: tuple[int, int] | None = None
    for batch in batches:
        entry = batch.column(0).to_numpy() == _ENTRY
        yield batch.filter(pa.array(~entry))
        if entry.any():
            one, doc, start, two = _columns(batch.filter(pa.array(entry)))
            one = np.ascontiguousarray(one).view(np.uint64).ravel()
            first = _first_of(one, two)
            first[0] = (one[0], two[0]) != last
            last = (one[-1], two[-1])
            yield _repeats(doc[~first], start[~first], start[~first] + grams.WINDOW)


def _without(texts: bool):
    """(doc_id, data, ranges, row) to (doc_id, n_bytes, removed, kept, text, row); ``removed`` are maximal."""
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lot in in_small_lots([x.as_buffer().size for x in whole.column(1)], sizes=True):
                batch = whole.slice(lot.start, lot.stop - lot.start)
                removed, kept, text, sizes = [], [], [], []
                for data, ranges in zip(batch.column(1), batch.column(2), strict=True):
                    data = data.as_buffer().to_pybytes()
                    stays, gone = [data], []
                    if ranges.is_valid:
                        lo, hi = (ranges.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                        _, lo, hi = _stretches(np.zeros(len(lo), np.int64), lo, hi)
                        gone = [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                        stays = [data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True)]
                    sizes.append(len(data))
                    removed.append(gone)
                    kept.append(b"".join(stays))
                    # stretch by stretch, so that what is left of two cut characters never makes up a third
                    text.append("".join(x.decode("utf-8", "ignore") for x in stays) if texts else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()), pa.array(text, pa.string()), batch.column(3)],
                    names=["doc_id", "n_bytes", "removed", "kept", "text", "row"],
                )

    return run


_JUDGED = "doc_id long, n_bytes long, removed array<struct<lo:bigint,hi:bigint>>, kept binary, text string"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2, carry: Sequence[str] = (), crowd: int = CROWD, texts: bool = False) -> DataFrame:
    """One row (doc_id, n_bytes, removed, kept, text, row) per input row; ``row`` holds the ``carry`` columns.

    A byte goes if a 100-byte string covers it that also starts earlier: in a document of smaller id, or
    further left in the same one. Strings never cross documents, overlaps count, and everything is judged
    on the input. ``removed`` lists the maximal removed stretches [lo, hi), ``kept`` the other bytes.
    With ``texts``, ``text`` is the kept part as text, without what is left of characters that were cut;
    else it is null.

    Null texts are empty; texts under 100 bytes stay whole; long texts are sampled segment by segment. If
    ids repeat or are null, each row is a document of its own, in the order of id (null first), then text.
    Other columns are ignored. An empty table gives no rows. The table is added in ``batches`` of about
    equally many documents. Equal blocks are told by 64-bit fingerprints, and windows of crowded grams by
    128 bits of hash; all other matches are measured on the bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    row = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(None).cast("string").alias("none"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"), row.alias("row"))
    size = F.sum(F.octet_length("data")).alias("size")
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), size).first()
    if seen.n != seen.ids:
        rows = scratch.keep(rows.orderBy(F.col("doc_id").asc_nulls_first(), "data").withColumn("doc", F.monotonically_increasing_id()), "numbered")
    else:
        rows = rows.withColumn("doc", F.col("doc_id"))
    schema = T.StructType.fromDDL(_JUDGED).add(rows.schema["row"])
    if not seen.n:
        return rows.select("doc_id", "data", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("ranges"), "row").mapInArrow(_without(texts), schema)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["size"] // PART))
    family = SuffixFamily(spark, scratch, parts, crowd)
    cuts = rows.select(F.percentile_approx("doc", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    every = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        batch = rows if lo is None else rows.where(F.col("doc") > lo)
        found = family.add(batch if hi is None else batch.where(F.col("doc") <= hi), last=hi is None)
        every = found if every is None else every.unionByName(found)

    def of(kind: int) -> DataFrame:
        blocks = every.where(F.col("kind") == kind).select("doc", F.col("what").alias("key"), F.col("at").bitwiseAND(F.lit(-4)).alias("at")).distinct()
        return rows.select("doc", "data").join(blocks.groupBy("doc").agg(F.collect_list(F.struct("key", "at")).alias("blocks")), "doc").select("doc", "data", "blocks")

    def stretches(found: DataFrame) -> DataFrame:
        return found.where(F.col("kind") == _REPEAT).select("doc", F.col("at").alias("lo"), F.col("what").alias("hi"))

    blocks = of(_OPEN).mapInArrow(_block_rows, _BLOCK).repartition(parts, "key").sortWithinPartitions("key", "ahead")
    repeats = stretches(every).unionByName(stretches(blocks.mapInArrow(_compared_blocks, _ROW)))
    if not every.where(F.col("kind") == _CROWDED).isEmpty():
        windows = _dealt(of(_CROWDED).mapInArrow(_window_rows, _ROW), parts)
        repeats = repeats.unionByName(stretches(windows.mapInArrow(_equal_windows, _ROW)))
    # no document has more stretches than its own length allows
    ranges = scratch.keep(repeats.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    del repeats, blocks, every
    scratch.sweep()
    return rows.join(ranges, "doc", "left").select("doc_id", "data", "ranges", "row").mapInArrow(_without(texts), schema)
