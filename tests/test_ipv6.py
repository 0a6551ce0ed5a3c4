"""IPv6 addresses are assessed like IPv4 ones."""

import ipaddress

from casewright.operators import enrichment

ADDRESSES = ["2606:4700::1", "2001:4860:4860::8888", "::1", "::", "fe80::1%eth0", "fd00::1", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2606:4700::G", "1:2:3", ":", "2606:4700::1 ", "FF02::1"]


def reference_status(ip):
    try:
        return "assessed" if ipaddress.ip_address(ip).is_global else "non-global-address"
    except ValueError:
        return "invalid-address"


def test_status_and_signals(spark):
    rows = [(ip, True, "VPN", None, None, None) for ip in ADDRESSES]
    got = enrichment.assess(spark.createDataFrame(rows, "ip string, on_tor_list boolean, proxy_type string, usage_type string, asn long, asn_category string")).collect()
    assert {r.ip: r.status for r in got} == {ip: reference_status(ip) for ip in ADDRESSES}
    public = {r.ip: (r.confidence, r.network_type, r.is_anonymized) for r in got if r.status == "assessed"}
    assert set(public.values()) == {(100, "tor-exit", True)} and "2606:4700::1" in public
    assert {(r.confidence, r.is_anonymized) for r in got if r.status != "assessed"} == {(0, False)}
