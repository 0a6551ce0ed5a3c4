"""Addresses of both families as sortable keys, and the most specific range that holds each.

A key is the family and the address in hexadecimal digits, ``4:08080808`` or ``6:`` and 32 digits, so all
spellings of an address have one key, and the order of keys is the order of addresses within a family.
Everything here is built-in expressions but the sweep of ``most_specific``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from .scratch import Scratch

# Ranges that are not globally reachable, and the parts of them that are.
RESERVED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
ASSIGNED_V4 = ("192.0.0.9/32", "192.0.0.10/32")
SHARED_V4 = "100.64.0.0/10"
RESERVED_V6 = ("::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
ASSIGNED_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

_PART = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_PART}(?:\.{_PART}){{3}}"
_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null for anything but four decimal parts up to 255."""
    parts = F.split(F.when(ip.rlike(rf"^{_V4}$"), ip), r"\.")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))


def ipv4_key(number: Column) -> Column:
    """The key of an IPv4 address given as a number; null beyond 32 bits."""
    return F.when(number.between(0, (1 << 32) - 1), F.concat(F.lit("4:"), F.lower(F.lpad(F.hex(number), 8, "0"))))


def _ipv6_digits(ip: Column) -> Column:
    """The 32 digits of an IPv6 address: groups around at most one ``::``, perhaps an IPv4 tail and a zone."""
    bare = F.regexp_replace(F.when(ip.contains(":"), ip), r"%[^%]+$", "")
    tail = F.regexp_extract(bare, rf":({_V4})$", 1)
    number = ipv4_number(tail)
    half = lambda shift: F.hex(F.shiftright(number, shift).bitwiseAND(F.lit(0xFFFF)))
    spelt = F.when(tail == "", bare).otherwise(F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), half(16), F.lit(":"), half(0)))

    def of(text: Column) -> Column:
        list_of = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
        head, rest = list_of(F.substring_index(text, "::", 1)), list_of(F.when(text.contains("::"), F.regexp_replace(text, "^.*?::", "")).otherwise(F.lit("")))
        n = F.size(head) + F.size(rest)
        fits = text.rlike(f"^(?:{_GROUPS})?::(?:{_GROUPS})?$") & (n <= 7) | text.rlike(f"^{_GROUPS}$") & (n == 8)
        groups = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), rest)
        return F.when(fits, F.lower(F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")))

    return let(spelt, of)


def address_key(ip: Column) -> Column:
    """The key of an address of either family; null for anything else."""
    return F.coalesce(ipv4_key(ipv4_number(ip)), F.concat(F.lit("6:"), _ipv6_digits(ip)))


def network_bounds(network: Column) -> Column:
    """Struct (low, high) of the keys that a network ``address/bits`` holds; host bits are ignored, a bare
    address is a network of its own. Null if either part is not valid."""
    key = address_key(F.substring_index(network, "/", 1))
    bits = F.when(network.contains("/"), F.regexp_extract(network, r"/(\d{1,3})$", 1)).otherwise(F.when(key.startswith("4"), "32").otherwise("128"))

    def of(pair: Column) -> Column:
        digits, n = F.substring(pair["key"], 3, 32), pair["bits"].try_cast("int")
        whole, left = F.floor(n / 4).cast("int"), n % 4
        cut = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
        size = F.element_at(F.array(*map(F.lit, (16, 8, 4, 2))), left + 1)
        low_digit, length = F.floor(cut / size) * size, F.length(digits)
        kept = F.substring(digits, F.lit(1), whole)
        ends = lambda digit, fill: F.concat(F.substring(pair["key"], 1, 2), F.rpad(F.concat(kept, F.when(whole < length, F.lower(F.hex(digit.cast("long")))).otherwise("")), length, fill))
        return F.when(n.between(0, length * 4), F.struct(ends(low_digit, "0").alias("low"), ends(low_digit + size - 1, "f").alias("high")))

    return let(F.struct(key.alias("key"), bits.alias("bits")), of)


def _literal_key(network: str) -> tuple[str, str]:
    """(low, high) of a network of the fixed lists above."""
    base, bits = network.split("/")
    if ":" not in base:
        digits = "".join(f"{int(x):02x}" for x in base.split("."))
        family = "4:"
    else:
        head, _, rest = base.partition("::")
        front, back = ([x for x in part.split(":") if x] for part in (head, rest))
        digits = "".join(x.zfill(4) for x in (*front, *["0"] * (8 - len(front) - len(back)), *back))
        family = "6:"
    span = (1 << len(digits) * 4 - int(bits)) - 1
    low = int(digits, 16) & ~span
    return tuple(f"{family}{x:0{len(digits)}x}" for x in (low, low | span))


def _within(key: Column, networks: tuple[str, ...]) -> Column:
    inside = F.lit(False)
    for network in networks:
        inside = inside | key.between(*_literal_key(network))
    return inside


def is_global(key: Column) -> Column:
    """Whether the address of a key is globally reachable; null without a key.

    An address that maps an IPv4 one is judged by that one, shared addresses counting as reachable there.
    """
    four = lambda k: ~_within(k, RESERVED_V4) | _within(k, ASSIGNED_V4)
    mapped = F.when(key.startswith("6:" + "0" * 20 + "ffff"), F.concat(F.lit("4:"), F.substring(key, 27, 8)))
    six = ~_within(key, RESERVED_V6) | _within(key, ASSIGNED_V6)
    return F.when(key.startswith("4"), four(key)).when(mapped.isNotNull(), four(mapped) | _within(mapped, (SHARED_V4,))).otherwise(six)


_HELD = pa.schema([("key", pa.string()), ("low", pa.string()), ("high", pa.string())])
_OPEN, _ASKED, _END = 0, 1, 2


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points in order, part by part: openings go onto a stack by size, asked keys get the smallest open range.

    Ranges that ended leave the stack when they come to its top."""
    part, stack = None, []
    for batch in batches:
        found = []
        for at, key, kind, high in zip(*(batch.column(k).to_pylist() for k in ("part", "key", "kind", "high")), strict=True):
            if at != part:
                part, stack = at, []
            if kind == _OPEN:
                low_number, high_number = int(key[2:], 16), int(high[2:], 16)
                heapq.heappush(stack, (high_number - low_number, -low_number, key, high))
            else:
                # keys of one family end before those of the next begin, so the order of texts is enough
                while stack and stack[0][3] < key:
                    heapq.heappop(stack)
                if stack:
                    found.append({"key": key, "low": stack[0][2], "high": stack[0][3]})
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_HELD)


def most_specific(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(key, low, high): for each key of ``keys`` the smallest of ``ranges`` (low, high) that holds it, if any;
    of equally small ones that which begins last.

    Openings, ends and keys are sorted together by ranges of keys. Each part of that order is swept by itself,
    once it knows which ranges are open at its border: those that end within it, and of those that cover it
    whole the smallest, since no other can win there. So a range goes to two parts and a wide one adds a row to
    the parts it covers only until they choose one.
    """
    scratch = Scratch(keys.sparkSession, "stab")
    given = ranges.where("low <= high AND left(low, 1) = left(high, 1)").select("low", "high").distinct()
    opening = given.select(F.col("low").alias("key"), F.lit(_OPEN).alias("kind"), "low", "high")
    end = given.select(F.col("high").alias("key"), F.lit(_END).alias("kind"), "low", "high")
    none = F.lit(None).cast("string")
    asked = keys.where("key IS NOT NULL").select("key").distinct().select("key", F.lit(_ASKED).alias("kind"), none.alias("low"), none.alias("high"))
    points = opening.unionByName(end).unionByName(asked).repartitionByRange("key", "kind", "low", "high").withColumn("part", F.spark_partition_id())
    points = scratch.keep(points, "points")

    spans = points.where("low IS NOT NULL").groupBy("low", "high").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last")
    carried = spans.select("low", "high", "last", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("part"))
    ending = carried.where("part = last").select("part", "low", "high")
    # of equally long digits the smaller difference is the smaller text
    covering = carried.where("part < last").groupBy("part").agg(F.min(F.struct(_size(F.col("low"), F.col("high")).alias("size"), _negated(F.col("low")).alias("late"), "low", "high")).alias("m")).select("part", "m.low", "m.high")
    border = ending.unionByName(covering).select("part", F.lit(0).alias("place"), F.col("low").alias("key"), F.lit(_OPEN).alias("kind"), "high")
    swept = border.unionByName(points.where(F.col("kind") != _END).select("part", F.lit(1).alias("place"), "key", "kind", "high"))
    return swept.repartition("part").sortWithinPartitions("part", "place", "key", "kind").select("part", "key", "kind", "high").mapInArrow(_sweep, "key string, low string, high string")


def _halves(key: Column) -> list[Column]:
    """The digits of a key in pieces of 28 bits, the highest first; an IPv4 one has leading zeros."""
    digits = F.lpad(F.substring(key, 3, 32), 35, "0")
    return [F.conv(F.substring(digits, 7 * k + 1, 7), 16, 10).cast("long") for k in range(5)]


def _size(low: Column, high: Column) -> Column:
    """high - low as a text of equal length for all keys, which sorts as the number does."""
    borrow, out = F.lit(0).cast("long"), []
    for a, b in reversed(list(zip(_halves(high), _halves(low), strict=True))):
        left = a - b - borrow
        borrow = F.when(left < 0, 1).otherwise(0).cast("long")
        out.append(F.lpad(F.hex(left + borrow * (1 << 28)), 7, "0"))
    return F.concat(*reversed(out))


def _negated(key: Column) -> Column:
    """A text that sorts against the order of keys."""
    return F.translate(key, "0123456789abcdef", "fedcba9876543210")


def with_ranges(addresses: DataFrame, ranges: DataFrame, *columns: str) -> DataFrame:
    """``addresses`` with ``columns`` of the most specific range that holds each; one row out for each row in.

    Addresses are texts of either family in ``ip``, or IPv4 numbers in ``ip_number``; ranges are networks in
    ``network`` (``2606:4700::/32``) or IPv4 numbers ``ip_start`` to ``ip_end``, both included. An address that
    is not valid or in no range has nulls; of equal ranges the one with the greatest values is taken.
    """
    address = address_key(F.col("ip")) if "ip" in addresses.columns else ipv4_key(F.col("ip_number"))
    bounds = network_bounds(F.col("network")) if "network" in ranges.columns else F.struct(ipv4_key(F.col("ip_start")).alias("low"), ipv4_key(F.col("ip_end")).alias("high"))
    held = ranges.select(bounds.alias("__b"), F.struct(*columns).alias("__v")).where("__b.low IS NOT NULL AND __b.high IS NOT NULL").groupBy("__b.low", "__b.high").agg(F.max("__v").alias("__v"))
    keyed = addresses.withColumn("__key", address)
    found = most_specific(keyed.select(F.col("__key").alias("key")), held).join(held, ["low", "high"]).select(F.col("key").alias("__key"), "__v")
    rows = keyed.drop(*columns).join(found, "__key", "left")
    return rows.select(*(c for c in addresses.columns if c not in columns), *(F.col(f"__v.{c}").alias(c) for c in columns))
