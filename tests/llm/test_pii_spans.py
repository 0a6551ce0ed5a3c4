"""Added spans of personal data: gazetteers, checksums, the classifier on held-out rows, and large texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from casewright.llm import pii


def spans(spark, texts):
    found = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r.doc_id: r.spans.split(",") if r.spans else [] for r in found.select("doc_id", pii.shown(F.col("spans")).alias("spans")).collect()}


def corpus(seed, n):
    """(text, kind or None): candidates that are personal data by construction, and look-alikes that are not."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        phone = f"{rng.randint(200, 999)}-{digits(3)}-{digits(4)}"
        out += [
            (f"Please {rng.choice(['call', 'phone'])} me at {phone}.", "loose_phone"), (f"My social security number is {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}.", "national_id"),
            (f"Regards, {rng.choice(['Mr', 'Dr'])} {rng.choice(['Adams', 'Brown', 'Clark'])}", "name"), (f"contact {rng.choice(pii.GIVEN)} {rng.choice(['Adams', 'Brown', 'Clark'])} today", "name"),
            (f"version {phone}", None), (f"part no: {rng.choice(['000', '666'])}-{digits(2)}-{digits(4)}", None), (f"weight {phone} kg", None), (f"page {phone}", None),
        ]
    return out


def test_held_out_accuracy(spark):
    rows = corpus(5, 60)
    got = spans(spark, [t for t, _ in rows])
    right = sum((any(s.startswith(kind + ":") for s in got[k]) if kind else not got[k]) for k, (_, kind) in enumerate(rows))
    assert right / len(rows) >= 0.95


@pytest.mark.parametrize(("value", "ok"), [("GB82 WEST 1234 5698 7654 32", True), ("DE89370400440532013000", True), ("GB82 WEST 1234 5698 7654 33", False), ("DE8937040044053201300", False), ("XX82 WEST 1234 5698 7654 32", False)])
def test_account_numbers(spark, value, ok):
    assert spark.range(1).select(pii._iban(F.lit(value))).first()[0] is ok


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 100])
def test_running_sums_and_best(spark, n):
    rng = random.Random(n)
    xs = [rng.randint(0, 9) for _ in range(n)]
    maybe = [x if x % 3 else None for x in xs]
    row = spark.createDataFrame([(xs, maybe)], "a array<long>, b array<long>").select(pii.running_sums(F.col("a")).alias("a"), pii.running_best(F.col("b")).alias("b")).first()
    assert row.a == [sum(xs[: k + 1]) for k in range(n)]
    assert row.b == [max((x for x in maybe[: k + 1] if x is not None), default=None) for k in range(n)]


def test_loose_spans_that_a_strict_one_touches_go(spark):
    rng = random.Random(1)
    span = lambda a, b: (a, b, "k", "v")
    for _ in range(15):
        base, found = ([span(a, a + rng.randint(1, 9)) for a in sorted(rng.sample(range(60), rng.randint(0, 6)))] for _ in range(2))
        kind = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"
        got = spark.createDataFrame([(found, base)], f"f {kind}, b {kind}").select(pii._untouched(F.col("f"), F.col("b"))).first()[0]
        assert [(x.start, x.end) for x in got] == [x[:2] for x in found if not any(b[0] < x[1] and x[0] < b[1] for b in base)]


def test_a_long_text_full_of_addresses(spark):
    text = " ".join(f"u{k}@example.org 555-123-{k % 9000 + 1000} John Adams" for k in range(30_000))
    start = time.time()
    assert len(spans(spark, [text, "short a@b.org"])[0]) >= 30_000
    assert time.time() - start < 90
