"""Packing by power-of-two decomposition: no sequence holds more than one document.

Each document's ids (its tokens and one end mark) are cut into pieces whose lengths are the binary
digits of its length: as many whole sequences as fit, then one piece for every set bit of the rest,
longest first. Every piece is a sequence by itself, of power-of-two length, so nothing is padded; a
trainer draws batches from one length bucket at a time.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pieces import in_small_lots

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def decompose(n: int, longest: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids, longest first; ``longest`` is a power of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """Encodes with the vocabulary, merge order and pre-token pattern of a byte-level tokenizer file.

    tiktoken merges several times faster than the library the file is written for, with equal ids: in
    such a file an entry's id is its merge rank. Added tokens are matched first, as that library does:
    leftmost, longest, each its own id; only the text between them is split and merged.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {bytes(byte[x] for x in entry): rank for entry, rank in vocabulary.items() if all(x in byte for x in entry)}
    if any(x.get(flag) for x in _added(path) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours are not supported")
    added = {x["content"]: x["id"] for x in _added(path) if x["content"]}
    ranks = {entry: rank for entry, rank in ranks.items() if entry.decode("utf-8", "replace") not in added}
    plain = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added:
        return plain
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        for part in cut(text):
            if part in added:
                ids.append(added[part])
            elif part:
                ids += plain(part)
        return ids

    return encode


def _added(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as file:
        return json.load(file).get("added_tokens") or []


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian 32-bit), sequence_id, offset.

    A null or empty text is a document of the end mark alone. A null ``doc_id`` is kept as null and
    repeated rows are packed as often as they stand. ``sequence_id`` is unique, not dense. Columns other
    than the two named are ignored, whatever their names. One pass over the rows, without a shuffle.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for lot in in_small_lots(texts):
                rows: list[tuple] = []
                for key, content in zip(keys[lot], texts[lot], strict=True):
                    ids = array("I", [*encode(content), end_id]).tobytes()
                    total, start = len(ids) // 4, 0
                    for n in decompose(total, longest):
                        rows.append((key, start, n, total, ids[4 * start : 4 * (start + n)]))
                        start += n
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:4]] + [pa.array(columns[4], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    pieces = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut_up, SCHEMA)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder per length, ready for equal-length batches."""
    packed.write.partitionBy("length").parquet(path)
