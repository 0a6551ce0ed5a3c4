"""The operators that SQL cannot express, against plain implementations on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

import oracle
from casewright.llm import bytebpe, packing, pii, queries, secret_scan, simhash, suffixes
from casewright.sources.tables import table


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def rows(spark, sf_dir, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def components(ids, linked):
    lowest = dict(zip(ids, ids, strict=True))
    while True:
        new = {a: min([lowest[a], *(lowest[b] for b in linked[a])]) for a in ids}
        if new == lowest:
            return lowest
        lowest = new


def test_op3(spark, sf_dir, docs):
    prints = {k: reference_fingerprint(t) for k, t in docs.items()}
    linked = {a: [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3] for a in prints}
    want = components(list(prints), linked)
    got = rows(spark, sf_dir, "op3_simhash")
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


@pytest.mark.parametrize("r", [1, 2, 3, 4, 5])
def test_block_masks_cover_every_near_pair(r):
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(r)]
    rng = np.random.default_rng(r)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("crowd", [1, 50, 10**6])
def test_crowded_keys_are_exact(spark, crowd, monkeypatch):
    """A dense ball of fingerprints, by tasks and by common neighbours."""
    rng = np.random.default_rng(1)
    prints = {k: int(0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for k in range(120)}
    frame = spark.createDataFrame([(k, simhash._signed(v)) for k, v in prints.items()], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: frame)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, crowd=crowd).collect()}
    linked = {a: [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3] for a in prints}
    assert got == components(list(prints), linked)


def test_op6(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = queries.QUERIES["op6_packing"](spark, sf_dir).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert by_doc.keys() == docs.keys() and len({p.sequence_id for p in pieces}) == len(pieces)
    for k, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.offset) == (at, len(ids), 0) and p.length.bit_count() == 1 and p.length <= 2048
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (2047, [1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1]), (2048, [2048]), (5000, [2048, 2048, 512, 256, 128, 8])])
def test_decompose(n, want):
    assert packing.decompose(n, 2048) == want


def tiktoken_encoding():
    import tiktoken

    entries = bytebpe.load_ranks(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: k for k, x in enumerate(entries)}, special_tokens={})


def test_op8(spark, sf_dir, docs):
    encoding = tiktoken_encoding()
    got = rows(spark, sf_dir, "op8_byte_bpe")
    for k, text in docs.items():
        ids = np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", " ", "  a  b\n\nc ", "x\n y", "a b  c", "tab\there", "don't we'll  I'M", "<|endoftext|> hi", "日本語 テキスト 😀😀", "\r\n", "a \nb", "\x1c a\x1fb", "a" * 300, "word.\nWord 123 45", " lead", "trail ", "\n", "\x85x \u2003y z ²½ ９"])
def test_pieces_encode_like_the_whole_text(text):
    coder = bytebpe._coder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == tiktoken_encoding().encode_ordinary(text)


def test_every_entry_is_one_id():
    coder = bytebpe._coder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    encoding = tiktoken_encoding()
    words = [" " + x.decode() for x in bytebpe.load_ranks(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))[300:40000:97] if x.isalpha()]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(words)] == [encoding.encode_ordinary(x) for x in words]


def luhn(digits):
    odd = [int(c) for c in digits[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def reference_pii(text):
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_op7(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op7_pii")
    for k, text in docs.items():
        want = reference_pii(text)
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.BASE] == [sum(w.startswith(x + ":") for w in want) for x in pii.BASE]
        assert set(want) <= set(got[k].spans.split(","))or not want


PII_TEXTS = {
    1: "x@y.com_foo@z.org a@b@c.d a@b.c..d@e.f 😀 q@w.e", 2: "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1..2.3.4", 3: "4111 1111 1111 1111 4111-1111-1111-1112 +1 (017) 555-7713. +12",
    4: "a@" + "b." * 20000 + "c", 5: "a" * 20000, 6: "9" * 20000, 7: "+1" * 3000 + "(" * 3000, 8: "call me at (017) 555-7713, my SSN 123-45-6789, Dr. Jane Doe; version 555 123 4567",
}


def test_pii_shapes(spark):
    found = pii.scan(spark.createDataFrame(list(PII_TEXTS.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in found.select("doc_id", pii.shown(found["base"]).alias("base"), pii.shown(found["spans"]).alias("spans")).collect()}
    assert {k: r.base for k, r in got.items()} == {k: ",".join(reference_pii(t)) for k, t in PII_TEXTS.items()}
    assert {"loose_phone:11:25", "national_id:34:45"} <= set(got[8].spans.split(","))


def test_estimation_ranks_patterns():
    patterns = [((1, 1, 1, 1, 0), 50), ((1, 0, 0, 1, 0), 50), ((-1, 0, 0, -1, -1), 100)]
    posterior = pii.estimate(patterns)
    bias, weights = pii.fit(patterns, posterior)
    score = lambda p: bias + sum(w * v for w, v in zip(weights, p, strict=True))
    assert posterior[0] > posterior[1] > 0.5 > posterior[2] and score(patterns[0][0]) > 0 > score(patterns[2][0])


def reference_secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_op9(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op9_secrets")
    for k, text in docs.items():
        want = reference_secrets(text)
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in secret_scan.BASE_KINDS] == [sum(w.startswith(x + ":") for w in want) for x in secret_scan.BASE_KINDS]


@pytest.mark.parametrize(
    ("text", "literals"),
    [
        ('k = "s3cr3tValue9"\nclient_secret = k', ["s3cr3tValue9"]), ('"db_pwd": "p4ssw0rd99"', ["p4ssw0rd99"]), ('config["auth_token"] = `zz99yy88xx`', ["zz99yy88xx"]), ("PGPASS_PWD=Zx81kqq0", ["Zx81kqq0"]),
        ('private_key: str = "abcdefGHI123456"', ["abcdefGHI123456"]), ('a = b\nb = c\nc = "q1w2e3r4t5"\ndb_passphrase = a', ["q1w2e3r4t5"]), ('token_count = "123456789"', []), ('my_pwd = "changeme"', []), ("the pass: we went over it in May", []),
        ('title = "s3cr3tValue9"', []), ("loop = loop\nmy_credential = loop", []),
    ],
)
def test_literals(text, literals):
    assert [text[x.start : x.end] for x in secret_scan.find_spans(text) if x.kind == "literal"] == literals


def test_failing_assignments_are_not_retried():
    assert [x.kind for x in secret_scan.find_spans("secret=token = abcdefgh")] == []
    assert secret_scan.masked("a token = abcdefgh b", secret_scan.find_spans("a token = abcdefgh b")) == "a [SECRET] b"


def reference_repeats(docs):
    first = {}
    for k, data in sorted(docs):
        for i in range(len(data) - 99):
            first.setdefault(data[i : i + 100], (k, i))
    out = {}
    for k, data in docs:
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if first[data[i : i + 100]] < (k, i):
                gone[i : i + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def test_op10(spark, sf_dir, docs):
    want = reference_repeats([(k, t.encode()) for k, t in docs.items()])
    got = rows(spark, sf_dir, "op10_suffix_dedup")
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == {k: (n, g, s, hashlib.sha256(x).hexdigest()) for k, (n, g, s, x) in want.items()}


@pytest.mark.parametrize(("batches", "crowd"), [(1, 1 << 15), (3, 2), (7, 1 << 15)])
def test_repeats_inside_across_and_periodic(spark, batches, crowd):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    noise = lambda n: "".join(rng.choice(list("ijklmnop é"), n))
    line = noise(60)
    texts = [passage, noise(50) + passage[100:300] + noise(50), "z" * 500, "ab" * 200, passage[:99], passage[:100], noise(200), line + noise(30) + line, noise(80) + line + noise(80), passage + passage, ""] + [noise(40) + passage[k : k + 130] + noise(40) for k in range(0, 250, 25)]
    docs = [(k, t) for k, t in enumerate(texts)]
    want = reference_repeats([(k, t.encode()) for k, t in docs])
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches, crowd=crowd).collect()
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in got} == want


def test_rows_under_one_id_are_documents_of_their_own(spark):
    text = "".join(np.random.default_rng(3).choice(list("abcdefg "), 300))
    got = suffixes.remove_repeats(spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, "short", "z")], "doc_id long, text string, tag string"), carry=["tag"]).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in got) == [(0, 5), (1, 0), (1, 300)] and {r.row.tag for r in got} == {"x", "y", "z"}


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    from casewright.llm import grams

    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefgh"), 900))
    data = [(text[:700] + text[200:600]).encode(), text.encode()]
    whole = [g for g in grams.segments(data)]
    monkeypatch.setattr(grams, "SEGMENT", 256)
    cut = [g for g in grams.segments(data)]
    assert len(cut) > len(whole) and sum(int(g.windows.sum()) for g in cut) == sum(int(g.windows.sum()) for g in whole)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], oracle.connect(sf_dir)) == ""
