"""Repeats in texts with very many shared grams, with the sorted scans cut into tiny batches."""

import numpy as np
import pytest

from casewright.llm import suffixes
from test_brute_force import reference_repeats


def dense(seed, n):
    """Texts put together from few phrases, so that most grams have several blocks."""
    rng = np.random.default_rng(seed)
    phrases = ["".join(rng.choice(list("abcdefg é"), rng.integers(20, 90))) for _ in range(12)]
    return ["".join(phrases[k] for k in rng.integers(0, len(phrases), rng.integers(0, 14))) for _ in range(n)]


@pytest.fixture
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("batches", "crowd"), [(1, 1 << 15), (2, 3), (4, 1 << 15), (5, 5)])
def test_dense_repeats(spark, tiny_batches, batches, crowd):
    docs = list(enumerate(dense(batches, 60)))
    want = reference_repeats([(k, t.encode()) for k, t in docs])
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches, crowd=crowd).collect()
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in got} == want


def test_an_id_far_from_the_others_does_not_unbalance_the_batches(spark, monkeypatch):
    sizes = []
    add = suffixes.SuffixFamily.add
    monkeypatch.setattr(suffixes.SuffixFamily, "add", lambda self, batch, **more: sizes.append(batch.count()) or add(self, batch, **more))
    docs = [(k, "x" * k) for k in range(40)] + [(10**15, "far")]
    suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), batches=2).collect()
    assert sum(sizes) == 41 and max(sizes) <= 25


def test_kept_text_has_no_halves_of_characters(spark):
    passage = "é" + "p" * 100 + "ö"
    docs = spark.createDataFrame([(1, passage[1:-1]), (2, "a\ufffdb" + passage + "\ufffd"), (3, "Ã" + "p" * 100 + "©")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(docs, texts=True).collect()}
    assert got == {1: "p" * 100, 2: "a\ufffdbéö\ufffd", 3: "Ã©"}
    shifted = spark.createDataFrame([(1, "é" * 60), (2, "x" + "é" * 60 + "y"), (3, "é" * 59 + "ö\ufffd")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(shifted, texts=True).collect()}
    assert got[2] == "xy" and got[3] == "\ufffd"  # the first byte of the last letter is that of the letter before
