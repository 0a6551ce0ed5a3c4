"""Redaction, custody and address rules against the same rules in plain Python."""

import hashlib
import ipaddress
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from casewright.functions.text import json_text
from casewright.operators import addresses, custody, redaction, timeline

# The masks as plain patterns, without the bounds that spare retries.
MASKS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "ipv4": r"(?<!\d)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d)",
    "ipv6": r"(?<![0-9A-Fa-f:])((?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]*[A-Fa-f][0-9A-Fa-f]*:){2,}[0-9A-Fa-f]+)(?![0-9A-Fa-f:])",
    "phone": r"(?<!\d)(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)\d{3}[\s.\-]?\d{4}(?!\d)",
}


def by_rule(text):
    counts = []
    for kind, pattern in MASKS.items():
        text, n = re.subn(pattern, redaction.KINDS[kind][1], text)
        counts.append(n)
    return text, counts


def masked(spark, texts):
    rows = redaction.mask_patterns(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "t").orderBy("k").collect()
    return [(r.t, [r[f"n_{k}"] for k in redaction.KINDS]) for r in rows]


def test_masks_equal_the_plain_patterns(spark, sf_dir):
    rng = random.Random(6)
    parts = ["a.b@c.org", "x@y", "@", "a@b.co.uk_x@z.org", "1.2.3.4", "256.1.1.1", "::1", "fe80::1", "a:b:c", "ab:cd:ef", "12:30:59", "1:2:3:4:5:6:7:8", "beef:cafe:1", "555-123-4567", "+1 (555) 123-4567", "123-45-6789", "5551234567",
             " ", "\n", ".", "-", ":", "x", "9", "é", " ", "١٢٣-45-6789", "555 123 4567", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert masked(spark, texts) == [by_rule(t) for t in texts]


def test_masks_take_long_texts(spark):
    texts = ["ab:" * 350_000, "a" * 1_000_000, "7" * 1_000_000, "a@" + "1." * 400_000, "1:" * 400_000, "a.b@c.org " * 50_000, "." * 1_000_000]
    start = time.time()
    got = masked(spark, texts)
    assert got[5][1][0] == 50_000 and got[1] == (texts[1], [0] * 5) and time.time() - start < 60


ENTRY = {"timestamp": "2024-01-01", "action": "add", "case_id": "7", "artifact_id": 3, "target_id": None, "analyst": "Zoë \U0001f600", "sha256": "ab", "notes": 'a "b" \\ \n\t\x01\x7f/é'}
LOG = "log_id long, timestamp string, action string, case_id string, artifact_id long, target_id long, analyst string, sha256 string, notes string"


def hashed(entry, previous):
    return hashlib.sha256(json.dumps({**entry, "previous_hash": previous}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def chain_of(spark, n=5, case="7", start=1):
    return spark.createDataFrame([(k, *({**ENTRY, "case_id": case, "notes": None if k == 2 else ENTRY["notes"] + str(k)}.values())) for k in range(start, start + n)], LOG)


def test_hash_covers_the_whole_entry(spark):
    previous = custody.GENESIS
    for r in custody.build_chain(chain_of(spark)).orderBy("log_id").collect():
        assert (r.previous_hash, r.entry_hash) == (previous, hashed({k: r[k] for k in ENTRY}, previous))
        previous = r.entry_hash


@pytest.mark.parametrize("name", [*custody.CONTENT])
def test_every_edit_is_found(spark, name):
    edit = F.lit(99) if name in custody.NUMBERS else F.lit("edited")
    rows = custody.build_chain(chain_of(spark).withColumn("chain", F.lit(1)), "chain").withColumn(name, F.when(F.col("log_id") == 3, edit).otherwise(F.col(name)))
    found = custody.verify_chain(rows, "chain").first()
    assert (found.intact, found.broken_log_id, found.entries_checked, found.reason) == (False, 3, 2, "content does not match its hash")


def test_chains_go_on_from_the_known_log(spark):
    first = custody.build_chain(chain_of(spark))
    more = custody.build_chain(chain_of(spark, 3, start=6).unionByName(chain_of(spark, 2, "8", 9)), known=first)
    verdicts = {r.case_id: (r.intact, r.entries_checked) for r in custody.verify_chain(first.unionByName(more)).collect()}
    assert verdicts == {"7": (True, 8), "8": (True, 2)}


@pytest.mark.parametrize("text", ["", "plain", 'q"\\/', "\b\f\n\r\t\x00\x1f\x7f\x80", "é ퟿￿", "\U0001f600\U0010ffff"])
def test_json_text(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(json_text(F.col("t"))).first()[0] == json.dumps(text)


def test_global_addresses(spark):
    rng = random.Random(2)
    nets = [ipaddress.ip_network(n) for n in (*addresses.RESERVED_V4, *addresses.ASSIGNED_V4, "224.0.0.0/4", "192.88.99.0/24", "100.128.0.0/10", "8.0.0.0/8")]
    ips = {str(a) for n in nets for a in (n[0], n[-1], n[rng.randrange(n.num_addresses)])} | {str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(300)}
    ips |= {str(ipaddress.ip_address(int(n[0]) - 1)) for n in nets if int(n[0])} | {str(ipaddress.ip_address(int(n[-1]) + 1)) for n in nets if int(n[-1]) < 2**32 - 1}
    rows = spark.createDataFrame([(x,) for x in sorted(ips)], "ip string").select("ip", addresses.is_global(addresses.address_key(F.col("ip"))).alias("g")).collect()
    assert {r.ip: r.g for r in rows} == {x: ipaddress.ip_address(x).is_global for x in ips}


def test_timeline_as_json(spark):
    cases = spark.createDataFrame([(1, "2024-01-02 00:00:00", "n", "Ana")], "case_id long, created_at string, case_name string, analyst_name string")
    targets = spark.createDataFrame([(10, 1, "p", "u", "2024-01-01 00:00:00")], "target_id long, case_id long, platform string, username string, added_at string")
    notes = spark.createDataFrame([(5, 1, 10, "f1", "Bo", "seen", "2024-01-03 00:00:00")], "note_id long, case_id long, target_id long, finding_ref string, analyst string, note string, created_at string")
    row = timeline.serialised(timeline.build(cases, targets, notes=notes)).first()
    events = json.loads(row.events)
    assert [e["kind"] for e in events] == ["target_added", "case_opened", "analyst_note"] and (events[2]["target_id"], events[2]["detail"], events[0]["analyst"]) == (10, "finding_ref=f1", "")


def test_redaction_queries_by_rule(spark, sf_dir):
    from casewright.plans.catalogue import QUERIES

    docs = {r.doc_id: by_rule(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.text_sha256, [r[f"n_{k}"] for k in redaction.KINDS]) for r in QUERIES["redact_documents"](spark, sf_dir).collect()}
    assert got == {k: (hashlib.sha256(t.encode()).hexdigest(), n) for k, (t, n) in docs.items()}
    tally = {r.kind: r.n for r in QUERIES["redaction_tally"](spark, sf_dir).collect()}
    assert tally == dict(zip(MASKS, map(sum, zip(*(n for _, n in docs.values()), strict=True)), strict=True)) and sum(tally.values()) > 0


def test_style_by_rule(spark, sf_dir):
    from casewright.functions.text import FUNCTION_WORDS, STYLE
    from casewright.plans.catalogue import QUERIES

    said = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: r.turn):
        said.setdefault(r.conv_id, []).append(r.text or "")
    for r in QUERIES["style_vector"](spark, sf_dir).collect():
        texts = said[r.profile_id]
        raw, n = " ".join(texts), len(texts)
        tokens = re.findall(r"\b\w+\b", raw.lower())
        want = [
            sum(t in FUNCTION_WORDS for t in tokens) / max(len(tokens), 1), sum(c in ".,!?;:'\"-" for c in raw) / max(len(raw), 1), raw.count("!") / max(len(raw), 1), raw.count("?") / max(len(raw), 1), min(1, raw.count("...") / n),
            sum(c.isupper() for c in raw) / max(sum(c.isalpha() for c in raw), 1), 0.0, min(1, sum(map(len, texts)) / n / 120),
        ]
        assert [r[k] for k in STYLE] == pytest.approx(want, abs=2e-3), r.profile_id
