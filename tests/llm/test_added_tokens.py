"""Packing of texts that hold an added token, against the library the tokenizer file is written for."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from casewright.llm import packing, queries

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a<|endoftext|>\n\n b  ", "  <|endoftext|>  ", "<|endoftext", "<<|endoftext|>>", "<|ENDOFTEXT|>", "don't é😀<|endoftext|>日本 " * 300, "none here"]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_encoder(text):
    assert packing._encoder(PATH)(text) == library_ids(text)


@pytest.mark.parametrize("stage", [False, True])
def test_query_and_stage(spark, tmp_path, stage):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'x' AS lang", "'y' AS source", "1L AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(corpus_pipeline.STAGES)["pack_sequences"](spark, docs, "") if stage else queries.QUERIES["op6_packing"](spark, str(tmp_path))
    rows = sorted(got.collect(), key=lambda r: (r.doc_id, r.start))
    for k, text in enumerate(TEXTS):
        ids = np.array([*library_ids(text), 1], "<u4")
        own = [r for r in rows if r.doc_id == k]
        assert {r.doc_tokens for r in own} == {len(ids)} and sum(r.length for r in own) == len(ids)
        if "ids_crc32" in got.columns:
            assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
