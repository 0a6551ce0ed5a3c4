"""Protected values in order, by rule: what was masked before is text for the values behind it."""

import re
from itertools import product

from casewright.operators import redaction
from pyspark.sql import functions as F

TEXTS = ["1996-09-13 00:00:00", "A", "", None, "user12 [REDACTED]", "a\x01b 0", "Straße ſtop Kelvin", "k\\E.* K", "[0] - 0]", "Protected 9 p", "12012", "\x01", "µ5 Μ"]
VALUES = [["0", "1", "2"], ["12", "1", "redacted"], ["user12", "-", " "], ["ſTOP", "k", "Ω"], ["\\E.*"], ["\x01", "0"], ["0", "] ", "[", "0"], ["", None, "P", "9"], ["μ", "5\x85"], []]


def folded(c):
    return c.upper().lower() if len(c.upper()) == 1 else c.lower()


def by_rule(text, values):
    mark = redaction.placeholder("standard")
    for v in values:
        if text is None or not v:
            continue
        low, out, at = [folded(c) for c in v], [], 0
        while at < len(text):
            if [folded(c) for c in text[at : at + len(v)]] == low:
                out.append(mark)
                at += len(v)
            else:
                out.append(text[at])
                at += 1
        text = "".join(out)
    return text


def test_values_in_order_by_rule(spark):
    rows = list(product(TEXTS, VALUES))
    df = spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(rows)], "k int, t string, v array<string>")
    got = {r.k: r.x for r in df.select("k", redaction.mask_protected(F.col("t"), F.col("v")).alias("x")).collect()}
    for k, (text, values) in enumerate(rows):
        assert got[k] == by_rule(text, values), (text, values)


def test_guards_lose_no_match(spark):
    texts = ["a@b.cc", "000-00-0000", "1.2.3.4", "a::", "1:2:3:4:5:6:7:8", "aa:1b:2", "5551234567", "(555)123-4567", "+1 555.123.4567", "x 555 1234567 y", "1996-09-13 00:00:00", "٥٥٥-٥٥-٥٥٥٥"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redaction.masked(F.col("t")).alias("x")).collect()]
    plain = [t for t in texts]
    for kind, (pattern, mark) in redaction.KINDS.items():
        plain = [r.x for r in spark.createDataFrame([(t,) for t in plain], "t string").select(F.regexp_replace("t", pattern, mark).alias("x")).collect()]
    assert got == plain
    assert sum(a != b for a, b in zip(texts, got, strict=True)) >= 10


def test_times_are_not_searched_for_each_kind():
    assert re.search(redaction._ANY.replace(r"\p{Nd}", "[0-9]").replace(r"\P{Nd}", "[^0-9]").replace("*+", "*"), "1996-09-13 00:00:00") is None
