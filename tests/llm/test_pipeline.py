"""The pipeline's stages against plain implementations, and on odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from test_brute_force import components, reference_fingerprint, reference_repeats, reference_secrets
from casewright.llm import quality, secret_scan
from casewright.sources.tables import table


def stage(name, spark, docs, sf_dir=""):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def fails(line):
    """The line rules, written out in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    separators, symbols, shouts = sum(w in "|»›·•>" for w in words), len(re.findall(r"[#*$%&|<>]+", line)), len(re.findall(r"[!?]{2,}", line))
    stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (
        (separators >= 4 and separators * 3 >= len(words)) or (symbols >= 3 and symbols * 2 > len(words)) or (shouts >= 3 and shouts * 4 > len(words)) or (stutters >= 3 and stutters * 4 > len(words))
        or (re.search(quality._BOILERPLATE, line) and len(words) <= 40) or (len(words) >= 30 and not re.search(r"[.!?;:,…。！？।؟۔]", line))
    )


def cleaned(text):
    """The text without failing lines, or None if the document goes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = Counter(windows)
    repeated = {k + o for k, w in enumerate(windows) if seen[w] > 1 for o in range(8)}
    lines = [x for x in text.split("\n") if not re.search(r"[^\x20\x09-\x0D]", x) or not fails(x)]
    stays = sum(len(w) for x in lines for w in re.findall(r"[^\x20\x09-\x0D]+", x))
    bad = len(words) < 20 or 100 * len(repeated) > 30 * len(words) or 1 - stays / sum(map(len, words)) > 0.5
    return None if bad else "\n".join(lines)


def test_run_equals_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer
    import public_tokenizers

    raw = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    docs = {k: x for k, t in raw.items() if (x := cleaned(t)) is not None}
    assert any(x != raw[k] for k, x in docs.items()) and any(x == raw[k] for k, x in docs.items())
    prints = {k: reference_fingerprint(t) for k, t in docs.items()}
    lowest = components(list(prints), {a: [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3] for a in prints})
    docs = {k: t for k, t in docs.items() if lowest[k] == k}
    kept = {k: x[3] for k, x in reference_repeats([(k, t.encode()) for k, t in docs.items()]).items()}
    docs = {k: x.decode("utf-8", "ignore") for k, x in kept.items() if x}
    docs = {k: secret_scan.masked(t, secret_scan.find_spans(t)) for k, t in docs.items()}
    assert not any(reference_secrets(t) for t in docs.values())
    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode
    ids = {k: np.array([*encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in docs.items()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == ids.keys() and sum(r.length for r in got) == sum(map(len, ids.values()))
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32, r.length) == (len(ids[r.doc_id]), zlib.crc32(piece.tobytes()), len(piece))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_tables(spark, odd_docs, no_docs, name):
    for docs in (odd_docs, no_docs):
        docs = docs.selectExpr("doc_id", "text", "extra0 AS lang" if "extra0" in docs.columns else "kind AS lang", "row AS source", "cast(length(text) AS bigint) AS n_chars", "fp", "key")
        out = stage(name, spark, docs)
        if name != "pack_sequences":
            assert out.columns == docs.columns
        assert out.count() <= docs.count() or name == "pack_sequences"


def test_near_duplicates_keep_one_of_each_group(spark):
    text = "a text of more than three words that stands twice"
    rows = [(2, text), (1, text), (3, "another one with quite different words in it"), (1, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang", "'y' AS source", "1L AS n_chars")
    assert sorted((r.doc_id or 0) for r in stage("simhash_near_dedup", spark, docs).collect()) == [0, 1, 3]


def test_cut_characters_go(spark):
    passage = "é" * 60
    docs = spark.createDataFrame([(1, passage), (2, "x" + passage + "y"), (3, passage)], "doc_id long, text string").selectExpr("*", "'x' AS lang", "'y' AS source", "1L AS n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in stage("suffix_array_dedup", spark, docs).collect()}
    assert got[2] == ("xy", 2) and 3 not in got


def test_different_texts_under_one_id_all_stay(spark):
    rows = [(3, "the first of two texts that have nothing in common at all", "b"), (3, "and here another one stands with quite other words in it", "a"), (3, "the first of two texts that have nothing in common at all", "a"), (1, "the first of two texts that have nothing in common at all", "z"), (7, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string")
    got = stage("simhash_near_dedup", spark, docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.number) for r in got.collect()) == [(1, rows[0][1], "z"), (3, rows[1][1], "a"), (7, "", "n")]


def test_lines_that_fail_go_and_the_rest_stays(spark):
    one, two = "A line of prose, with commas and words enough to stay where it is.", "Under it stands another; nothing in it should ever be taken away."
    menu = "Home | News | Sport | Travel | About\n"
    rows = [(1, f"{one}\n\n{menu}{two}\n", "s"), (2, f"{one}\n  \n{two}\n", "t"), (3, menu * 9, "u")]
    got = {r.doc_id: (r.text, r.source) for r in stage("quality_rules", spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: (f"{one}\n\n{two}\n", "s"), 2: (f"{one}\n  \n{two}\n", "t")}


def test_replacement_characters_of_a_cut_text_stay(spark):
    passage = "é" * 60
    docs = spark.createDataFrame([(1, passage), (2, "\ufffd" + passage + "y\ufffd")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in stage("suffix_array_dedup", spark, docs).collect()}[2] == "\ufffdy\ufffd"
