"""Byte-level BPE by a sentencepiece model that is written straight from the vocabulary.

Every byte is mapped to one letter, every vocabulary entry becomes a piece scored by its negative rank,
and normalisation is the identity, so sentencepiece's highest-score-first merges are the rank-order
merges of the vocabulary. Pre-tokens are encoded one by one; decoding looks ids up in the inverse map.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pieces import PieceCoder, in_small_lots

#: Byte b stands as the letter with code point 256 + b, so no byte is white space or a control sign.
_LETTER = 256


def load_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (base64 and rank on each line), by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, lines)}
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


_TO_LETTER = {b: _LETTER + b for b in range(256)}


def letters(data: bytes) -> str:
    """``data`` with each byte as its letter."""
    return data.decode("latin-1").translate(_TO_LETTER)


def sentencepiece_model(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, letters(x).encode()) + _field(2, float(-rank)) + _field(3, normal)) for rank, x in enumerate(entries)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(entries) + 1) + _field(40, len(entries)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> PieceCoder:
    import public_tokenizers
    import regex
    import sentencepiece

    entries = load_ranks(path)
    model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(entries))
    # an entry that its own merges do not reach is still one id when it is a whole pre-token
    whole = {letters(x): [k] for (k, x), ids in zip(enumerate(entries), model.encode([letters(x) for x in entries]), strict=True) if ids != [k]}
    find = regex.compile(pattern).findall

    def encode_many(texts: list[str]) -> list[bytes]:
        found = [[letters(t.encode()) for t in find(x)] for x in texts]
        ids = iter(model.encode([t for tokens in found for t in tokens]))
        out = []
        for tokens in found:
            own: list[int] = []
            for t, merged in zip(tokens, ids):  # noqa: B905  tokens ends first
                own += whole.get(t, merged)
            out.append(array("I", own).tobytes())
        return out

    return PieceCoder(encode_many, cutting=pattern == public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def _entries(path: str) -> list[bytes]:
    return load_ranks(path)


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, ids) per input row; ids are little-endian 32-bit integers in one binary.

    A null text counts as empty and has no ids; a null ``doc_id`` stays null; repeated rows stay
    repeated; other columns are ignored. Texts are whole, one pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lot in in_small_lots([x.as_buffer().size if x.is_valid else 0 for x in texts], sizes=True):
                own = [x or "" for x in texts[lot.start : lot.stop].to_pylist()]
                yield pa.RecordBatch.from_arrays([keys[lot.start : lot.stop], pa.array(coder.encode(own), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded) for the rows of ``encode``; ``decoded`` holds the bytes of the text.

    Null ids decode to no bytes. An id outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = _entries(ranks_path).__getitem__
        for batch in batches:
            ids = batch.column(1)
            for lot in in_small_lots([x.as_buffer().size if x.is_valid else 0 for x in ids], sizes=True):
                own = ids[lot.start : lot.stop]
                decoded = [b"".join(map(entry, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else b"" for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lot.start : lot.stop], own, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
