"""Offline address enrichment: lookups by key and by range, additive signals, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .addresses import address_key, is_global, with_ranges

# Signal weights, recognised categories and proxy types, thresholds, reserved ranges.
WEIGHTS = {
    "tor_exit_list": 60, "ip2proxy_tor": 55, "ip2proxy_vpn": 40, "asn_set_known_vpn": 40, "ip2proxy_public_proxy": 35, "ip2proxy_residential_proxy": 35, "ip2proxy_datacenter": 35,
    "asn_set_hosting_datacenter": 30, "ip2proxy_web_proxy": 30, "anomaly_trigger": 15,
}
CATEGORIES = ("known-vpn", "hosting-datacenter")
PROXY_SIGNALS = {"TOR": "ip2proxy_tor", "VPN": "ip2proxy_vpn", "PUB": "ip2proxy_public_proxy", "RES": "ip2proxy_residential_proxy", "WEB": "ip2proxy_web_proxy", "DCH": "ip2proxy_datacenter"}
PROXY_TYPES = (*PROXY_SIGNALS, "SES", "CDN", "-")
FLAG_AT, MIN_EXIT_LIST, STALE_HOURS = 50, 100, 48


def parse_exit_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct entries of a text list without blanks and comments, as (ip, position) as first seen."""
    rows = lines.select(F.regexp_replace(F.col(column), r"^\s+|\s+$", "").alias("ip"), "position") if "position" in lines.columns else lines.select(F.regexp_replace(F.col(column), r"^\s+|\s+$", "").alias("ip"), F.monotonically_increasing_id().alias("position"))
    rows = rows.where((F.col("ip") != "") & ~F.col("ip").startswith("#"))
    return rows.groupBy("ip").agg(F.min("position").alias("position"), F.count("*").alias("times"))


def validate_authority(entries: DataFrame) -> DataFrame:
    """Entries of the network authority with the first rule that each breaks, null if none.

    Needs asn, organization, category and source, may have a confidence and nothing else (a column
    ``extra_keys`` lists other keys); asn must be a number and unique; two categories exist.
    """
    blank = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", ""), F.lit("")) == ""
    missing = blank("asn") | blank("organization") | blank("category") | blank("source")
    numeric = F.col("asn").cast("string").rlike(r"^\d+$")
    earlier = F.row_number().over(Window.partitionBy(F.col("asn").cast("string")).orderBy("position")) > 1
    extra = F.coalesce(F.size("extra_keys") > 0, F.lit(False)) if "extra_keys" in entries.columns else F.lit(False)
    problem = F.when(missing, "missing field").when(extra, "unexpected field").when(~numeric, "asn is not a number").when(~F.col("category").isin(*CATEGORIES), "unrecognised category").when(earlier, "duplicate asn")
    return entries.withColumn("problem", problem)


def accepted_authority(entries: DataFrame, strict: bool = False) -> DataFrame:
    """The valid entries; with ``strict``, an invalid one refuses the whole file."""
    judged = validate_authority(entries)
    if strict and not judged.where("problem is not null").isEmpty():
        raise ValueError("the network authority holds invalid entries")
    return judged.where("problem is null").drop("problem")


def accepted_exit_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct addresses of an exit list; a list of fewer than ``MIN_EXIT_LIST`` addresses is refused."""
    entries = parse_exit_list(lines, column).where(address_key(F.col("ip")).isNotNull())
    if entries.limit(MIN_EXIT_LIST).count() < MIN_EXIT_LIST:
        raise ValueError("the exit list is too short to be whole")
    return entries


def with_lookups(addresses: DataFrame, exits: DataFrame, networks: DataFrame, authority: DataFrame, proxies: DataFrame) -> DataFrame:
    """``addresses`` (ip) with what the lists say of them, as ``assess`` takes it: exits (ip), networks
    (network, or ip_start and ip_end; asn), authority (asn, category, organization) and proxies (ip,
    proxy_type, usage_type). One row out for each row in. Lists are joined by the key of the address, so its
    spelling does not matter, networks by the most specific range; lists of a size worth it are broadcast by
    the planner's own measure."""
    rows = with_ranges(addresses, networks, "asn").withColumn("__ip", address_key(F.col("ip")))
    listed = exits.select(address_key(F.col("ip")).alias("__ip")).where("__ip IS NOT NULL").distinct().withColumn("on_tor_list", F.lit(True))
    known = authority.groupBy(F.col("asn").cast("long").alias("asn")).agg(F.max(F.struct(F.col("category").alias("asn_category"), F.col("organization").alias("asn_organization"))).alias("n")).select("asn", "n.*")
    one = proxies.groupBy(address_key(F.col("ip")).alias("__ip")).agg(F.max(F.struct(F.upper("proxy_type").alias("proxy_type"), F.upper("usage_type").alias("usage_type"))).alias("p")).where("__ip IS NOT NULL").select("__ip", "p.*")
    rows = rows.join(listed, "__ip", "left").join(known, "asn", "left").join(one, "__ip", "left")
    return rows.withColumn("on_tor_list", F.coalesce("on_tor_list", F.lit(False))).drop("__ip")


def lookup_custody(assessed: DataFrame, sources: DataFrame, at: str) -> DataFrame:
    """One custody record per lookup: time, address, all that was found, the sources and those absent."""
    held = sources.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "loaded_at", "available")))).alias("databases"), F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("name")))).alias("absent_sources"))
    found = F.to_json(F.struct(*(F.col(c) for c in ("status", "confidence", "network_type", "is_anonymized", "signals", "rationale"))))
    # one row: the state of the sources
    return assessed.select(F.lit("ip_enrichment").alias("event"), F.lit(at).alias("timestamp"), F.col("ip").alias("input_ip"), found.alias("output")).join(F.broadcast(held))


def assess(rows: DataFrame) -> DataFrame:
    """Rows (ip, on_tor_list, proxy_type, usage_type, asn, asn_category, asn_organization) with signals,
    confidence, network type, flag and rationale. Texts that are no IPv4 or IPv6 address
    and addresses that are not global get a status and no signals."""
    # a column of its own, so that the parsing is not repeated in each of its uses
    rows = rows.withColumn("__key", address_key(F.col("ip")))
    public = F.when(F.col("__key").isNotNull(), is_global(F.col("__key")))
    rows = rows.withColumn("status", F.when(public.isNull(), "invalid-address").when(~public, "non-global-address").otherwise("assessed"))
    proxy, usage, category = (F.coalesce(F.col(c), F.lit("")) for c in ("proxy_type", "usage_type", "asn_category"))
    tor = F.coalesce("on_tor_list", F.lit(False))
    listed = F.col("asn").isNotNull() & (category != "")
    recognised = category.isin(*CATEGORIES)
    odd_usage = usage.isin("ISP", "COM") & (recognised | proxy.isin("DCH", "RES", "PUB", "WEB")) & ~tor & ~proxy.isin("VPN", "TOR")
    odd_category = listed & ~recognised
    odd_proxy = (proxy != "") & ~proxy.isin(*PROXY_TYPES)
    fired = [(tor, "tor_exit_list")] + [(proxy == k, v) for k, v in PROXY_SIGNALS.items()] + [(category == "known-vpn", "asn_set_known_vpn"), (category == "hosting-datacenter", "asn_set_hosting_datacenter")]
    fired += [(odd_usage, "anomaly_trigger"), (odd_category, "anomaly_trigger"), (odd_proxy, "anomaly_trigger")]
    signals = F.array_compact(F.array(*(F.when((F.col("status") == "assessed") & on, F.struct(F.lit(name).alias("signal"), F.lit(WEIGHTS[name]).alias("weight"))) for on, name in fired)))
    rows = rows.drop("__key").withColumn("signals", signals)
    confidence = F.least(F.lit(100), F.aggregate("signals", F.lit(0), lambda a, s: a + s["weight"]))
    anomalous = F.exists("signals", lambda s: s["signal"] == "anomaly_trigger")
    network = (
        F.when(F.col("status") != "assessed", "unknown").when(tor | (proxy == "TOR"), "tor-exit").when((proxy == "VPN") | (category == "known-vpn"), "known-vpn")
        .when((proxy == "DCH") | (category == "hosting-datacenter"), "hosting-datacenter").when(usage == "MOB", "mobile").when(anomalous, "suspicious")
        .when(F.col("asn").isNotNull() | usage.isin("ISP", "COM"), "residential").otherwise("unknown")
    )
    rows = rows.withColumn("confidence", confidence).withColumn("network_type", network).withColumn("is_anonymized", F.col("confidence") >= FLAG_AT)
    named = F.array_join(F.transform("signals", lambda s: s["signal"]), ", ")
    none = F.concat(F.lit("no indicator fired; classified as "), F.col("network_type"))
    some = F.concat(named, F.lit(" classify the address as "), F.col("network_type"), F.lit(" with confidence "), F.col("confidence").cast("string"), F.lit(" of 100"))
    return rows.withColumn("rationale", F.when(F.size("signals") == 0, none).otherwise(some))


def source_status(sources: DataFrame, as_of: str) -> DataFrame:
    """Sources (name, loaded_at, available) with their age in hours and whether they are stale or missing."""
    age = (F.to_timestamp(F.lit(as_of)).cast("long") - F.try_to_timestamp(F.col("loaded_at")).cast("long")) / 3600
    return sources.select("name", age.alias("age_hours"), F.coalesce(F.col("available") & (F.col("name") == "tor_exit_list") & (age > STALE_HOURS), F.lit(False)).alias("stale"), (~F.col("available")).alias("degraded"))


def database_status(files: DataFrame, as_of: str, stale_days: int = 7) -> DataFrame:
    """Databases (name, modified_at) that cannot be fetched: present, age in whole days, stale, and whether
    somebody has to act."""
    present = F.col("modified_at").isNotNull()
    age = F.floor((F.to_timestamp(F.lit(as_of)).cast("long") - F.try_to_timestamp(F.col("modified_at")).cast("long")) / 86400)
    stale = F.coalesce(age > stale_days, F.lit(False))
    return files.select("name", present.alias("present"), age.cast("long").alias("age_days"), stale.alias("stale"), (~present | stale).alias("manual_action_required"))
