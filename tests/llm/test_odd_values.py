"""What the text operators give for odd texts, value by value."""

import public_tokenizers

from casewright.llm import bytebpe, licenses, pii, secret_scan, suffixes, url_filter
from conftest import ODD_TEXTS

RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def by_id(rows):
    return {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id != 3}


def test_licenses(odd_docs):
    rows = licenses.scan(odd_docs).collect()
    assert {(r.license, r.score, r.origin) for r in rows} == {(None, None, "none")} and sum(r.file_id is None for r in rows) == 2


def test_personal_data_and_secrets(odd_docs):
    assert all(r.base == [] and r.spans == [] for r in pii.scan(odd_docs).collect())
    assert all(r.spans == [] for r in secret_scan.scan(odd_docs).collect())
    assert by_id(secret_scan.mask_column(odd_docs).collect())[9].text == ODD_TEXTS[9]


def test_bytes(odd_docs):
    got = by_id(bytebpe.decode(bytebpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS).collect())
    assert {k: bytes(r.decoded).decode() for k, r in got.items()} == {k: t or "" for k, t in enumerate(ODD_TEXTS) if k != 3}


def test_repeats(odd_docs):
    rows = suffixes.remove_repeats(odd_docs, texts=True).collect()
    got = by_id(rows)
    assert [got[k].n_bytes for k in (0, 1, 2, 4)] == [0, 0, 4, 9] and got[0].text == got[1].text == ""
    assert got[5].n_bytes - len(got[5].kept) > 0 and len(got[6].kept) == 0  # periodic in itself, and a copy
    assert len(got[8].kept) == 1 and all(len(got[k].kept) == got[k].n_bytes for k in (2, 4, 10, 11))


def test_rules_with_quotes_and_backslashes(spark):
    rules = [("it's.org", "/a'b\\c/", "block"), ("o.net", "/", "allow")]
    assert [tuple(r) for r in url_filter.rules_table(spark, rules).collect()] == rules
    pages = spark.createDataFrame([(1, "http://x.it's.org/a'b\\c/d")], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.rules_table(spark, rules)).first().verdict == "block"
    assert url_filter.rules_table(spark, []).collect() == []
