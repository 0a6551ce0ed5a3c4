"""Text measures as column expressions: entropy, rarity, similarity, style."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType

# Name parts that many accounts share, and words whose use tells writers apart.
COMMON_PARTS = "gamer player pro noob official real the xx yt ttv king queen boss god lord cool epic super mega ultra best top".split()
FUNCTION_WORDS = "the a an and or but if of to in for on with as at by from is are was be this that it you i me my we they".split()
STYLE = ("function_words", "punctuation", "exclamations", "questions", "ellipses", "capitals", "emoji", "length")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""

    def of(cs: Column) -> Column:
        n = F.size(cs)
        share = F.transform(F.array_sort(F.array_distinct(cs)), lambda c: F.size(F.filter(cs, lambda x: x == c)) / n)
        return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.coalesce(let(chars(text), of), F.lit(0.0))


def handle_rarity(handle: Column) -> Column:
    """How distinctive a handle is, 0 to 1: entropy and length, less for common parts and digit runs."""
    name = F.lower(F.coalesce(handle, F.lit("")))
    parts = sum((F.when(name.contains(p), 1).otherwise(0) for p in COMMON_PARTS), F.lit(0))
    base = 0.6 * F.least(F.lit(1.0), entropy(name) / 4) + 0.4 * F.least(F.lit(1.0), F.length(name) / 12)
    rarity = base * (1 - F.least(F.lit(0.85), parts * 0.4)) * F.when(name.rlike(r"\d{3,}"), 0.75).otherwise(1.0)
    return F.when(name == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rarity)))


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hits = row & places.get(c, 0)
        row = (row + hits | row - hits) & full
    return len(a) - row.bit_count()


@F.arrow_udf(IntegerType())
def common_subsequence(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two texts; null if either is."""
    return pa.array([None if x is None or y is None else _common_length(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalised insertion-deletion similarity, 2 * LCS / (both lengths)."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * common_subsequence(a, b) / total)


def length_bound(a: Column, b: Column) -> Column:
    """The highest ``indel_ratio`` that the lengths allow."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.least(F.length(a), F.length(b)) / total)


def style_vector(messages: Column) -> Column:
    """Eight topic-independent style features of an array of messages; null for an empty array."""
    raw = F.array_join(messages, " ")
    n = F.size(messages)
    letters = F.greatest(F.length(raw), F.lit(1))
    tokens = F.greatest(F.regexp_count(F.lower(raw), F.lit(r"(?U)\b\w+\b")), F.lit(1))
    words = F.regexp_count(F.lower(raw), F.lit(r"(?U)\b(?:" + "|".join(FUNCTION_WORDS) + r")\b"))
    alpha = F.greatest(F.regexp_count(raw, F.lit(r"\p{L}")), F.lit(1))
    total = F.aggregate(messages, F.lit(0), lambda a, m: a + F.length(m))
    vector = F.array(
        words / tokens,
        F.regexp_count(raw, F.lit(r"""[.,!?;:'"-]""")) / letters,
        F.regexp_count(raw, F.lit("!")) / letters,
        F.regexp_count(raw, F.lit(r"\?")) / letters,
        F.least(F.lit(1.0), F.regexp_count(raw, F.lit(r"\.\.\.")) / n),
        F.regexp_count(raw, F.lit(r"\p{Lu}")) / alpha,
        F.least(F.lit(1.0), F.regexp_count(raw, F.lit("[\U0001F300-\U0001FAFF\U00002600-\U000027BF]")) / n),
        F.least(F.lit(1.0), total / n / 120),
    )
    return F.when(n > 0, vector)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if either is null or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (both == 0), 0.0).otherwise(dot / both)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two equally long hex texts of up to 16 digits; null for anything else."""
    ok = (F.length(a) == F.length(b)) & a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    number = lambda h: F.conv(h, 16, -10).cast("long")
    return F.when(ok, F.bit_count(number(F.when(ok, a)).bitwiseXOR(number(F.when(ok, b)))))


def hour_weight(hour: Column) -> Column:
    """How unusual activity in an hour is: nights count most, evenings least."""
    return F.when(hour.between(18, 22), 0.2).when(hour.between(9, 17), 0.4).when(hour.between(0, 5), 1.0).otherwise(0.6)


def degree_weight(degree: Column) -> Column:
    """Evidence of a shared node by its degree: 1 for a private one, little for a public one."""
    return F.when(degree <= 1, 1.0).otherwise(1 / F.log2(degree + 1))


def confidence_interval(point: Column, n: Column) -> Column:
    """Struct (low, high) around a similarity, narrower with more messages."""
    half = F.least(F.lit(0.4), 1 / F.sqrt(n))
    low, high = F.greatest(F.lit(0.0), point - half), F.least(F.lit(1.0), point + half)
    return F.when(n <= 0, F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))).otherwise(F.struct(low.alias("low"), high.alias("high")))


def json_text(text: Column) -> Column:
    """A text as a JSON string in ASCII: quotes, backslashes, controls and all beyond the tilde escaped,
    characters beyond the basic plane as two surrogates; null stays null."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        beyond = code - 0x10000
        pair = F.concat(unit(F.shiftright(beyond, 10) + 0xD800), unit(beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        out = F.when(c.rlike(r"^[\x20-\x7E]$"), c).when(code > 0xFFFF, pair).otherwise(unit(code))
        for raw, shown in short.items():
            out = F.when(c == raw, shown).otherwise(out)
        return out

    def of(t: Column) -> Column:
        letter_by_letter = F.array_join(F.transform(F.split(t, ""), escaped), "")
        return F.when(t.rlike(r"[^\x20-\x7E]"), letter_by_letter).when(t.rlike(r'["\\]'), F.regexp_replace(t, r'(["\\])', r"\\$1")).otherwise(t)

    return F.concat(F.lit('"'), let(text, of), F.lit('"'))
