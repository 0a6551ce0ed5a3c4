"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest

from casewright.llm import bytebpe, embeddings, licenses, packing, pii, quality, secret_scan, simhash, suffixes, url_filter

JSON, RANKS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PER_ROW = {
    "licenses": lambda d: licenses.scan(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "quality": lambda d: quality.judge(d),
    "pii": lambda d: pii.scan(d),
    "bytebpe": lambda d: bytebpe.decode(bytebpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS),
    "secrets": lambda d: secret_scan.scan(d),
    "masked": lambda d: secret_scan.mask_column(d),
    "suffixes": lambda d: suffixes.remove_repeats(d, carry=["extra0"] if "extra0" in d.columns else ["row", "kind"]),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(name, odd_docs):
    assert len(PER_ROW[name](odd_docs).collect()) == odd_docs.count()


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(name, no_docs):
    assert PER_ROW[name](no_docs).collect() == []


def test_packing_cuts_every_document(odd_docs, no_docs):
    rows = packing.pack(odd_docs, JSON).collect()
    assert sum(r.start == 0 for r in rows) == odd_docs.count()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(no_docs, JSON).collect() == []
    with pytest.raises(ValueError):
        packing.pack(odd_docs, JSON, longest=1000)


def test_null_text_has_defined_results(odd_docs):
    first = {r.doc_id: r for r in simhash.near_duplicates(odd_docs.where("doc_id <= 2")).collect()}
    assert {r.fingerprint for r in first.values()} == {"0" * 16} and {r.component_id for r in first.values()} == {0}
    judged = quality.judge(odd_docs.where("doc_id <= 2")).collect()
    assert all(r.n_words == 0 and r.base_failed and not r.kept and r.clean_text == "" for r in judged)


def test_rows_without_id_share_components_only_by_fingerprint(odd_docs):
    rows = simhash.near_duplicates(odd_docs).where("doc_id is null").collect()
    assert len(rows) == 2 and all(r.component_id is None for r in rows)


def test_embeddings_edge_cases(spark):
    e = lambda *x: [float(v) for v in x]
    rows = [
        (1, e(1, 0), 0), (2, e(2, 0), 0), (3, e(1, 0), 0), (3, e(1, 0), 0), (4, None, 0), (5, e(0, 0), 0), (6, [1.0, None], 0), (7, e(1, "nan"), 0), (8, e(1, "inf"), 0),
        (9, e(1, 0), None), (10, e(1, 0), 1), (11, e(1, 0, 0), 0), (12, [], 0), (None, e(1, 0), 0), (13, e(0.93, 0.3676), 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS times", "3 AS size", "4 AS vector")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table).collect()}
    linked = {r for r in got if r[0] in (1, 2, 3)}
    assert {r[2] for r in linked} == {1} and {r[1] for r in linked} <= {3, 4}
    assert {(4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True), (None, 0, None, False)} <= got
    assert embeddings.near_duplicates(table.where("false")).collect() == []


def test_url_filter_edge_cases(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://Www.Example.ORG/es/1?q#f"), (4, "HTTP://Www.Example.ORG/es/1?q#f"), (None, "x://com/de/"), (5, "x://" + "a." * 5000 + "com/fr/")], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS verdict", "4 AS times")
    rules = url_filter.rules_table(spark, url_filter.QUERY_RULES)
    got = sorted(((r.page_id, r.host[:15], r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()), key=str)
    assert got == sorted(
        [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.org", "/es/1", "example.org/es/", "block"), (4, "www.example.org", "/es/1", "example.org/es/", "block"), (None, "com", "/de/", "com/de/", "block"), (5, ("a." * 10)[:15], "/fr/", "com/fr/", "allow")], key=str
    )
    assert url_filter.judge(pages.where("false"), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, rules.where("false")).collect()} == {"allow"}
