"""Keys of addresses and the most specific range, against the ipaddress module and a search over all ranges."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import addresses, enrichment
from casewright.sources import readers

SPELT = [
    "8.8.8.8", "08.8.8.8", "8.8.8", "256.1.1.1", "1.2.3.4 ", "0.0.0.0", "255.255.255.255", "::", "::1", "1::", "2001:DB8:0:0::1", "2001:db8::1", "2001:0db8:0000:0000:0000:0000:0000:0001", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", ":::", ":", "g::", "12345::", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:100.64.0.1", "64:ff9b::1.2.3.4", "::1.2.3.256", "::01.2.3.4", "1.2.3.4::", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "", None, "x",
]


def parsed(ip):
    try:
        return ipaddress.ip_address(ip) if ip else None
    except ValueError:
        return None


def key_of(a):
    return None if a is None else f"{a.version}:{int(a):0{8 if a.version == 4 else 32}x}"


def drawn(rng):
    if rng.random() < 0.5:
        return ipaddress.IPv4Address(rng.getrandbits(32))
    a = ipaddress.IPv6Address(rng.getrandbits(128) & ~(((1 << rng.randrange(1, 100)) - 1) << rng.randrange(0, 28)))
    return a


def test_keys(spark):
    rng = random.Random(3)
    ips = [*SPELT, *(rng.choice([str, lambda a: a.exploded, lambda a: str(a).upper()])(drawn(rng)) for _ in range(400))]
    got = {r.ip: r.k for r in spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", addresses.address_key(F.col("ip")).alias("k")).collect()}
    assert got == {x: key_of(parsed(x)) for x in ips}


def test_global_addresses(spark):
    rng = random.Random(4)
    nets = [ipaddress.ip_network(n) for n in (*addresses.RESERVED_V4, *addresses.ASSIGNED_V4, *addresses.RESERVED_V6, *addresses.ASSIGNED_V6)]
    ips = {str(type(n[0])((int(a) + k) % (1 << n.max_prefixlen))) for n in nets for a in (n[0], n[-1], n[rng.randrange(n.num_addresses)]) for k in (-1, 0, 1)} | {f"::ffff:{x}" for x in ("8.8.8.8", "10.0.0.1", "192.0.0.9", "100.64.0.1")} | {str(drawn(rng)) for _ in range(200)}
    got = {r.ip: r.g for r in spark.createDataFrame([(x,) for x in sorted(ips)], "ip string").select("ip", addresses.is_global(addresses.address_key(F.col("ip"))).alias("g")).collect()}
    assert got == {x: ipaddress.ip_address(x).is_global for x in ips}


def test_networks(spark):
    rng = random.Random(5)
    nets = [f"{a}/{rng.randrange(a.max_prefixlen + 1)}" for a in (drawn(rng) for _ in range(300))] + ["0.0.0.0/0", "::/0", "1.2.3.4", "::1"]
    got = {r.n: r.b for r in spark.createDataFrame([(x,) for x in [*nets, "1.2.3.4/33", "::/129", "x/8", "1.2.3.4/", None]], "n string").select("n", addresses.network_bounds(F.col("n")).alias("b")).collect()}
    assert {n: tuple(got[n]) for n in nets} == {n: (key_of(p[0]), key_of(p[-1])) for n in nets for p in [ipaddress.ip_network(n, strict=False)]}
    assert [got[x] for x in ("1.2.3.4/33", "::/129", "x/8", "1.2.3.4/", None)] == [None] * 5


@pytest.mark.parametrize(("seed", "parts"), [(1, 3), (2, 29)])
def test_most_specific_range(spark, seed, parts):
    """Nested, touching and crossing ranges of both families, wide ones too, over few and many parts."""
    rng = random.Random(seed)
    ranges = set()
    for version, bits in ((4, 32), (6, 128)):
        for _ in range(150):
            start = (rng.randrange(16) << bits - 4) | rng.getrandbits(12)
            length = rng.choice([0, 1, rng.randrange(2000), rng.randrange(1 << bits // 2), rng.randrange(1 << bits - 3)])
            ranges.add((version, start, min(start + length, (1 << bits) - 1)))
        for k in range(20):  # touching
            ranges.add((version, 500 + 10 * k, 509 + 10 * k))
    ranges |= {(4, 0, (1 << 32) - 1)}
    ordered = sorted(ranges)
    text = lambda v, x: f"{v}:{x:0{8 if v == 4 else 32}x}"
    asked = {(v, min(max(x + d, 0), (1 << (32 if v == 4 else 128)) - 1)) for v, lo, hi in ordered for x in (lo, hi) for d in (-1, 0, 1)} | {(6, rng.getrandbits(128)) for _ in range(100)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        held = spark.createDataFrame([(text(v, a), text(v, b)) for v, a, b in ordered * 2], "low string, high string")
        keys = spark.createDataFrame([(text(v, x),) for v, x in asked] * 2 + [(None,)], "key string")
        got = [tuple(r) for r in addresses.most_specific(keys, held).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = set()
    for v, x in asked:
        holding = [(b - a, -a, a, b) for w, a, b in ordered if w == v and a <= x <= b]
        if holding:
            _, _, a, b = min(holding)
            want.add((text(v, x), text(v, a), text(v, b)))
    assert len(got) == len(set(got)) and set(got) == want


def test_one_row_out_for_each_row(spark):
    rows = spark.createDataFrame([(1, "8.8.8.8", 7), (1, "8.8.8.8", 7), (2, "2001:DB8:0:0::1", 8), (3, None, 9), (4, "bad", 1), (5, "9.9.9.9", 2)], "id int, ip string, asn int")
    networks = spark.createDataFrame([("8.8.8.0/22", 1), ("8.8.8.0/24", 2), ("8.8.8.0/24", 3), ("2001:db8::/32", 4), ("broken", 5), (None, 6)], "network string, asn int")
    got = sorted(((r.id, r.ip, r.asn) for r in addresses.with_ranges(rows, networks, "asn").collect()), key=str)
    assert got == sorted([(1, "8.8.8.8", 3), (1, "8.8.8.8", 3), (2, "2001:DB8:0:0::1", 4), (3, None, None), (4, "bad", None), (5, "9.9.9.9", None)], key=str)
    numbers = spark.createDataFrame([(134744072,), (None,), (-1,)], "ip_number long")
    spans = spark.createDataFrame([(134744072, 134744072, "a"), (134744073, 5, "b")], "ip_start long, ip_end long, name string")
    assert sorted((r.name for r in addresses.with_ranges(numbers, spans, "name").collect()), key=str) == sorted(["a", None, None], key=str)
    assert addresses.with_ranges(rows.where("false"), networks, "asn").collect() == [] and {r.asn for r in addresses.with_ranges(rows, networks.where("false"), "asn").collect()} == {None}


def test_authority_files_with_unknown_keys(spark, tmp_path):
    """A key that an entry should not have is seen in a file, and refuses it under strict."""
    (tmp_path / "a.json").write_text('{"asns": [{"asn": 5, "organization": "o", "category": "known-vpn", "source": "s"}, {"asn": "6", "organization": "o", "category": "known-vpn", "source": "s", "note": {"x": 1}}, 7]}')
    entries = readers.authority(spark, str(tmp_path / "a.json"))
    assert [(r.position, r.asn, r.extra_keys) for r in entries.orderBy("position").collect()] == [(0, "5", []), (1, "6", ["note"]), (2, None, [])]
    assert [(r.asn, r.problem) for r in enrichment.validate_authority(entries).orderBy("position").collect()] == [("5", None), ("6", "unexpected field"), (None, "missing field")]
    assert [r.asn for r in enrichment.accepted_authority(entries).collect()] == ["5"]
    with pytest.raises(ValueError):
        enrichment.accepted_authority(entries, strict=True)
