"""Byte-level BPE under another pre-token pattern, and sequences written by their length."""

import numpy as np
import public_tokenizers
import pytest

from casewright.llm import bytebpe, packing

RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("pattern", [r"\w+|\W+", r"[^\n]+\n?|\n", r"\s?\S+|\s+"])
def test_other_patterns(pattern):
    import tiktoken

    encoding = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks={x: k for k, x in enumerate(bytebpe.load_ranks(RANKS))}, special_tokens={})
    coder = bytebpe._coder(RANKS, pattern)
    for text in ("the cat sat\non  the mat", "a b\nc d", "", " é\n\n😀 x"):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)


def test_buckets_hold_equal_lengths(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words " * 900), (2, None), (3, "few")], "doc_id long, text string")
    packed = packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    packing.write_buckets(packed, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == packed.count() and all(len(r.ids) == 4 * r.length and r.length.bit_count() == 1 for r in rows)
    assert {p.name for p in (tmp_path / "out").glob("length=*")} == {f"length={r.length}" for r in rows}
