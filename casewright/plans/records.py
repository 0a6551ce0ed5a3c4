"""Timeline, custody, redaction, retention, enrichment and profile queries, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import custody as V, enrichment as N, profiles as P, redaction as R, retention as X, timeline as T
from ..sources import domain as D
from ..sources.domain import with_views
from ..sources.tables import table

_AS_OF, _DAYS = "1999-01-01 00:00:00", 365
_ISO = "replace({0}, ' ', 'T') || '+00:00'"


def _dated_cases(s, d):
    """Cases as old as their first target; open ones count as unreadable dates in every seventh case."""
    first = D.targets(s, d).groupBy("case_id").agg(F.min("added_at").alias("first"))
    return D.cases(s, d).join(first, "case_id").select("case_id", "status", F.when(F.col("case_id") % 7 == 0, "unknown").otherwise(F.col("first")).alias("created_at"))


_DATED = with_views("cases", "targets", "artifacts", "analyses") + f", dated AS (SELECT case_id, status, CASE WHEN case_id % 7 = 0 THEN NULL ELSE min(added_at) END AS created_at FROM cases JOIN targets USING (case_id) GROUP BY 1, 2), due AS (SELECT case_id, (epoch(TIMESTAMP '{_AS_OF}' - created_at::TIMESTAMP) / 86400)::DOUBLE AS age FROM dated WHERE created_at::TIMESTAMP < TIMESTAMP '{_AS_OF}' - INTERVAL {_DAYS} DAY)"


def _opened(s, d):
    """Cases with a time of opening."""
    return D.cases(s, d).withColumn("created_at", F.date_format(F.date_add(F.lit("1992-01-01").cast("date"), (F.col("case_id") % 1000).cast("int")), "yyyy-MM-dd HH:mm:ss"))


def _events(s, d):
    return T.build(_opened(s, d), D.targets(s, d), D.artifacts(s, d), D.analyses(s, d), D.custody(s, d), D.notes(s, d), D.entities(s, d))


def _timeline(s, d):
    return T.ordered(_events(s, d)).select("case_id", "timestamp", "kind", "description", "source_table", "source_ref", "analyst", "target_id", "detail")


_EVENTS = with_views("cases", "targets", "artifacts", "analyses", "custody", "notes", "entities") + f""", ev AS (
 SELECT case_id, {_ISO.format("strftime(DATE '1992-01-01' + (case_id % 1000)::INT, '%Y-%m-%d %H:%M:%S')")} AS timestamp, 'case_opened' AS kind, 'Case ''' || case_name || ''' opened' AS description, 'cases' AS source_table, case_id::VARCHAR AS source_ref, analyst_name AS analyst, NULL::BIGINT AS target_id, '' AS detail FROM cases
 UNION ALL SELECT case_id, {_ISO.format('added_at')}, 'target_added', 'Target ' || platform || ':' || username || ' added to case', 'targets', target_id::VARCHAR, '', target_id, '' FROM targets
 UNION ALL SELECT case_id, {_ISO.format('collected_at')}, 'artifact_collected', module_name || ' collected ' || artifact_type || ' artifact', 'artifacts', artifact_id::VARCHAR, '', target_id, '' FROM artifacts JOIN targets USING (target_id)
 UNION ALL SELECT case_id, {_ISO.format('analyzed_at')}, 'analysis_recorded', 'analysis recorded', 'analysis_results', result_id::VARCHAR, '', target_id, CASE WHEN risk_score IS NULL THEN '' ELSE printf('risk_score=%.2f', risk_score) END FROM analyses JOIN targets USING (target_id)
 UNION ALL SELECT case_id, {_ISO.format('timestamp')}, 'custody_' || action, notes, 'evidence_log', log_id::VARCHAR, analyst, target_id, '' FROM custody
 UNION ALL SELECT case_id, {_ISO.format('created_at')}, 'analyst_note', note, 'analyst_notes', note_id::VARCHAR, analyst, target_id, coalesce('finding_ref=' || finding_ref, '') FROM notes
 UNION ALL SELECT case_id, {_ISO.format('promoted_at')}, 'entity_promoted', 'Entity ' || entity_id || ' (''' || canonical_handle || ''') resolved by analyst decision', 'entities', entity_id, promoted_by, NULL, '' FROM entities)
"""


def _chained(s, d):
    return V.build_chain(D.custody(s, d))


#: Fields that are edited after the chain was built, each in the entries of one remainder by 97.
_EDITED = {"notes": 0, "analyst": 1, "sha256": 2, "timestamp": 3, "action": 4}
_RENUMBERED = {"artifact_id": 5, "target_id": 6}


def _tampered(s, d):
    """The chain with every field edited in some entries, and some entries deleted."""
    rows = _chained(s, d)
    for name, k in _EDITED.items():
        rows = rows.withColumn(name, F.when(F.col("log_id") % 97 == k, "edited").otherwise(F.col(name)))
    for name, k in _RENUMBERED.items():
        rows = rows.withColumn(name, F.when(F.col("log_id") % 97 == k, -1).otherwise(F.col(name)))
    return V.verify_chain(rows.where("log_id % 89 <> 5"))


_FIELD = {
    **{n: f"coalesce(to_json({{0}}.{n})::VARCHAR, 'null')" for n in ("action", "analyst", "notes", "sha256", "timestamp")},
    **{n: f"coalesce({{0}}.{n}::VARCHAR, 'null')" for n in ("artifact_id", "target_id")},
    "case_id": "'\"' || {0}.case_id || '\"'", "previous_hash": "'\"' || {1} || '\"'",
}
_JSON = "'{{' || " + " || ',' || ".join(f"'\"{n}\":' || {x}" for n, x in sorted(_FIELD.items())) + " || '}}'"
_CHAIN = with_views("custody").replace("WITH ", "WITH RECURSIVE ", 1) + f""", num AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY log_id) AS n FROM custody),
 chain AS (SELECT num.*, repeat('0', 64) AS previous_hash, sha256({_JSON.format('num', "repeat('0', 64)")}) AS entry_hash FROM num WHERE n = 1
 UNION ALL SELECT num.*, c.entry_hash, sha256({_JSON.format('num', 'c.entry_hash')}) FROM chain c JOIN num ON num.case_id = c.case_id AND num.n = c.n + 1)
"""
_VERIFY = """, edited AS (SELECT * REPLACE ({0}) FROM chain WHERE {1}),
 checked AS (SELECT *, lag(entry_hash, 1, repeat('0', 64)) OVER w AS expected, row_number() OVER w AS position FROM edited WINDOW w AS (PARTITION BY case_id ORDER BY log_id)),
 judged AS (SELECT *, CASE WHEN previous_hash <> expected THEN 'broken link' WHEN sha256({2}) <> entry_hash THEN 'content does not match its hash' END AS broken FROM checked)
 SELECT case_id, count(broken) = 0 AS intact, coalesce(min(position) FILTER (WHERE broken IS NOT NULL) - 1, count(*)) AS entries_checked, arg_min(log_id, position) FILTER (WHERE broken IS NOT NULL) AS broken_log_id, arg_min(broken, position) FILTER (WHERE broken IS NOT NULL) AS reason FROM judged GROUP BY 1
"""
_STORED = _JSON.format("checked", "checked.previous_hash")
_EDITS = ", ".join([f"CASE WHEN log_id % 97 = {k} THEN 'edited' ELSE {n} END AS {n}" for n, k in _EDITED.items()] + [f"CASE WHEN log_id % 97 = {k} THEN -1 ELSE {n} END AS {n}" for n, k in _RENUMBERED.items()])


def _redacted(s, d):
    rows = R.mask_patterns(table(s, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), *(f"n_{k}" for k in R.KINDS))


def _email_redacted(s, d):
    pattern, mark = R.KINDS["email"]
    return table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("n_email"), F.sha2(F.regexp_replace("text", pattern, mark), 256).alias("text_sha256"))


def _tags(s, d):
    """Case notes with tagged values, made from customers."""
    text = F.concat(F.lit("note\nprotected: "), F.col("c_name"), F.lit("\r\nProtected:  "), F.lower("c_mktsegment"), F.lit(" \nprotected: "), F.col("c_name"))
    return R.protected_tags(table(s, d, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("position"), text.alias("text"))).select("case_id", F.array_join("values", "|").alias("tagged"))


def _addresses(s, d):
    """Addresses with lookups already joined, spread over all branches by event number."""
    k = F.col("event_id")
    proxies = F.array(*map(F.lit, ("", "TOR", "VPN", "PUB", "RES", "WEB", "DCH", "SES", "XYZ")))
    usages = F.array(*map(F.lit, ("", "ISP", "COM", "MOB", "DCH")))
    kinds = F.array(F.lit(None).cast("string"), F.lit("known-vpn"), F.lit("hosting-datacenter"), F.lit("other"))
    ip = F.when(k % 50 == 0, "not an address").when(k % 100 == 51, "fd00::1").when(k % 50 == 1, "10.1.2.3").when(k % 6 == 5, F.concat(F.lit("2606:4700::"), F.lower(F.hex(k % 65536)))).otherwise(F.concat_ws(".", (k % 80 + 20).cast("string"), (k % 250).cast("string"), (k % 200).cast("string"), (k % 100).cast("string")))
    category = F.get(kinds, (k % 4).cast("int"))
    return table(s, d, "events").select(k.alias("event_id"), ip.alias("ip"), (k % 17 == 0).alias("on_tor_list"), F.get(proxies, (k % 9).cast("int")).alias("proxy_type"), F.get(usages, (k % 5).cast("int")).alias("usage_type"), F.when(category.isNotNull() | (k % 3 == 0), k % 1000 + 64512).alias("asn"), category.alias("asn_category"))


_ADDRESSES = """WITH a AS (SELECT event_id, CASE event_id % 50 WHEN 0 THEN 'invalid-address' WHEN 1 THEN 'non-global-address' ELSE 'assessed' END AS status, event_id % 17 = 0 AS tor,
 ['', 'TOR', 'VPN', 'PUB', 'RES', 'WEB', 'DCH', 'SES', 'XYZ'][event_id % 9 + 1] AS proxy, ['', 'ISP', 'COM', 'MOB', 'DCH'][event_id % 5 + 1] AS usage, ['', 'known-vpn', 'hosting-datacenter', 'other'][event_id % 4 + 1] AS cat FROM events),
 b AS (SELECT *, cat <> '' OR event_id % 3 = 0 AS has_asn, cat IN ('known-vpn', 'hosting-datacenter') AS rec FROM a),
 c AS (SELECT *, (usage IN ('ISP', 'COM') AND (rec OR proxy IN ('DCH', 'RES', 'PUB', 'WEB')) AND NOT tor AND proxy NOT IN ('VPN', 'TOR'))::INT + (cat = 'other')::INT + (proxy = 'XYZ')::INT AS odd FROM b),
 e AS (SELECT *, CASE WHEN status <> 'assessed' THEN 0 ELSE least(100, 60 * tor::INT + CASE proxy WHEN 'TOR' THEN 55 WHEN 'VPN' THEN 40 WHEN 'PUB' THEN 35 WHEN 'RES' THEN 35 WHEN 'WEB' THEN 30 WHEN 'DCH' THEN 35 ELSE 0 END + CASE cat WHEN 'known-vpn' THEN 40 WHEN 'hosting-datacenter' THEN 30 ELSE 0 END + 15 * odd) END AS confidence FROM c)
 SELECT event_id, status, confidence, CASE WHEN status <> 'assessed' THEN 'unknown' WHEN tor OR proxy = 'TOR' THEN 'tor-exit' WHEN proxy = 'VPN' OR cat = 'known-vpn' THEN 'known-vpn' WHEN proxy = 'DCH' OR cat = 'hosting-datacenter' THEN 'hosting-datacenter' WHEN usage = 'MOB' THEN 'mobile' WHEN odd > 0 THEN 'suspicious' WHEN has_asn OR usage IN ('ISP', 'COM') THEN 'residential' ELSE 'unknown' END AS network_type, confidence >= 50 AS is_anonymized FROM e"""


def _ranges(s, d):
    """Suppliers as owners of address ranges; events look their address up."""
    ranges = table(s, d, "supplier").select((F.col("s_suppkey") * 100_000 + 335_544_320).alias("ip_start"), (F.col("s_suppkey") * 100_000 + 335_544_320 + 90_000).alias("ip_end"), F.col("s_name").alias("organization"))
    asked = table(s, d, "events").select("event_id", (F.col("event_id") * 997 % 20_000_000 + 335_544_320).alias("ip_number"))
    return N.with_ranges(asked, ranges, "organization").select("event_id", "organization")


def _authority(s, d):
    k = F.col("p_partkey")
    asn = F.when(k % 11 == 0, "AS12").when(k % 13 == 0, None).otherwise((k % 900).cast("string"))
    rows = table(s, d, "part").select(k.alias("position"), asn.alias("asn"), F.col("p_brand").alias("organization"), F.when(k % 5 == 0, "other").when(k % 2 == 0, "known-vpn").otherwise("hosting-datacenter").alias("category"), F.when(k % 17 != 0, "registry").otherwise(" ").alias("source"))
    return N.validate_authority(rows).groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


def _exit_list(s, d):
    k = F.col("event_id")
    line = F.when(k % 10 == 0, "# comment").when(k % 10 == 1, "   ").otherwise(F.concat(F.lit(" 20.0."), (k % 40).cast("string"), F.lit("."), (k % 25).cast("string"), F.lit("\t")))
    return N.parse_exit_list(table(s, d, "events").select(line.alias("value"), k.alias("position")))


def _accounts(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.alias("profile_id"), F.when(k % 9 != 0, F.col("c_name")).otherwise("").alias("display_name"), F.when(k % 4 == 0, "find me on Discord").when(k % 9 == 0, "").otherwise("hello").alias("description"), (k % 12 == 0).alias("is_banned"),
        (k % 300).cast("int").alias("friend_count"), F.array(F.when(k % 8 == 0, "Good Vibes Club").otherwise("Builders")).alias("groups"), F.when(k % 10 == 0, F.array(F.lit("Scented Con"))).alias("games"),
    )


def _servers(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(
        k.alias("profile_id"), F.col("s_name").alias("display_name"), F.when(k % 5 == 0, "Teen Dating").otherwise("games").alias("description"), F.array(F.when(k % 2 == 0, "INVITE_SPLASH").otherwise("NEWS")).alias("features"),
        (k % 3).cast("int").alias("verification_level"), (k % 90).cast("int").alias("members"), (k % 40).cast("int").alias("presence"),
    )


QUERIES = {
    "investigation_timeline": lambda s, d: _timeline(s, d),
    "timeline_custody_only": lambda s, d: T.chosen(_events(s, d), "custody_").groupBy("kind").agg(F.count("*").alias("n")),
    "custody_fold": lambda s, d: _chained(s, d).select("case_id", "log_id", "previous_hash", "entry_hash"),
    "custody_verify": lambda s, d: V.verify_chain(_chained(s, d)),
    "custody_tamper": _tampered,
    "evidence_manifest": lambda s, d: V.manifest(D.targets(s, d), D.artifacts(s, d), D.custody(s, d)).drop("evidence_id"),
    "evidence_ids": lambda s, d: D.artifacts(s, d).select("artifact_id", V.evidence_id(F.col("artifact_id"), F.col("sha256")).alias("evidence_id")),
    "package_verify": lambda s, d: V.verify_package(D.artifacts(s, d).dropDuplicates(["artifact_id"]).where("artifact_id % 10 <> 3"), D.artifacts(s, d).dropDuplicates(["artifact_id"]).where("artifact_id % 10 <> 4").withColumn("sha256", F.when(F.col("artifact_id") % 10 == 5, "x").otherwise(F.col("sha256")))).groupBy("status").agg(F.count("*").alias("n")),
    "redact_documents": _redacted,
    "redact_email": _email_redacted,
    "redaction_tally": lambda s, d: R.tally(table(s, d, "documents"), "text"),
    "protected_tags": _tags,
    "retention_due": lambda s, d: X.due(_dated_cases(s, d), _AS_OF, _DAYS).select("case_id", "age_days"),
    "retention_dry_run": lambda s, d: X.dry_run(X.due(_dated_cases(s, d), _AS_OF, _DAYS), D.targets(s, d), D.artifacts(s, d), D.analyses(s, d)).drop("age_days"),
    "retention_purge": lambda s, d: X.purged(X.due(_dated_cases(s, d), _AS_OF, _DAYS), D.cases(s, d), D.targets(s, d), D.artifacts(s, d), D.analyses(s, d))["targets"].groupBy("platform").agg(F.count("*").alias("n")),
    "ip_assess": lambda s, d: N.assess(_addresses(s, d)).select("event_id", "status", "confidence", "network_type", "is_anonymized"),
    "ip_range_lookup": _ranges,
    "asn_authority_validate": _authority,
    "tor_list_parse": _exit_list,
    "html_sniff": lambda s, d: table(s, d, "pages").select("page_id", P.looks_like_html(F.col("html")).alias("is_html")),
    "account_review_leads": lambda s, d: P.lead_rows(P.account_leads(_accounts(s, d))),
    "server_review_leads": lambda s, d: P.lead_rows(P.server_leads(_servers(s, d))),
    "exchange_accounts": lambda s, d: P.account_objects(D.targets(s, d)).select("account_type", "account_login", "case_id"),
}

ORACLE_SQL = {
    "investigation_timeline": _EVENTS + "SELECT * FROM ev",
    "timeline_custody_only": with_views("custody") + "SELECT 'custody_' || action AS kind, count(*) AS n FROM custody GROUP BY 1",
    "custody_fold": _CHAIN + "SELECT case_id, log_id, previous_hash, entry_hash FROM chain",
    "custody_verify": _CHAIN + _VERIFY.format("notes AS notes", "true", _STORED),
    "custody_tamper": _CHAIN + _VERIFY.format(_EDITS, "log_id % 89 <> 5", _STORED),
    "evidence_manifest": with_views("targets", "artifacts", "custody") + "SELECT case_id, artifact_id, platform, sha256, coalesce(n, 0) AS custody_events, last_event FROM artifacts JOIN targets USING (target_id) LEFT JOIN (SELECT case_id, count(*) AS n, max(timestamp) AS last_event FROM custody GROUP BY 1) USING (case_id)",
    "package_verify": with_views("artifacts") + "SELECT CASE artifact_id % 10 WHEN 3 THEN 'unlisted' WHEN 4 THEN 'missing' WHEN 5 THEN 'altered' ELSE 'ok' END AS status, count(DISTINCT artifact_id) AS n FROM artifacts GROUP BY 1",
    "redact_email": "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS n_email, sha256(regexp_replace(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}', '[REDACTED - EMAIL]', 'g')) AS text_sha256 FROM documents",
    "protected_tags": "WITH v AS (SELECT c_nationkey AS case_id, c_custkey * 10 + 1 AS pos, c_name AS value FROM customer UNION ALL SELECT c_nationkey, c_custkey * 10 + 2, lower(c_mktsegment) FROM customer), f AS (SELECT case_id, value, min(pos) AS pos FROM v GROUP BY 1, 2) SELECT case_id, string_agg(value, '|' ORDER BY pos) AS tagged FROM f GROUP BY 1",
    "retention_due": _DATED + "SELECT case_id, floor(age)::BIGINT AS age_days FROM due",
    "retention_dry_run": _DATED + "SELECT d.case_id, (SELECT count(*) FROM targets t WHERE t.case_id = d.case_id) AS targets, coalesce(a, 0) AS artifacts, coalesce(a, 0) AS analyses FROM due d LEFT JOIN (SELECT case_id, count(*) AS a FROM targets JOIN artifacts USING (target_id) GROUP BY 1) USING (case_id)",
    "retention_purge": _DATED + "SELECT platform, count(*) AS n FROM targets ANTI JOIN due USING (case_id) GROUP BY 1",
    "ip_assess": _ADDRESSES,
    "ip_range_lookup": "SELECT event_id, s_name AS organization FROM events LEFT JOIN supplier ON event_id * 997 % 20000000 BETWEEN s_suppkey * 100000 AND s_suppkey * 100000 + 90000",
    "asn_authority_validate": "WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'AS12' WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey % 900)::VARCHAR END AS asn FROM part), q AS (SELECT *, row_number() OVER (PARTITION BY asn ORDER BY k) AS n FROM r) SELECT CASE WHEN asn IS NULL OR k % 17 = 0 THEN 'missing field' WHEN asn = 'AS12' THEN 'asn is not a number' WHEN k % 5 = 0 THEN 'unrecognised category' WHEN n > 1 THEN 'duplicate asn' ELSE 'valid' END AS problem, count(*) AS n FROM q GROUP BY 1",
    "tor_list_parse": "SELECT '20.0.' || event_id % 40 || '.' || event_id % 25 AS ip, min(event_id) AS position, count(*) AS times FROM events WHERE event_id % 10 > 1 GROUP BY 1",
    "html_sniff": "SELECT page_id, regexp_matches(lower(substr(regexp_replace(html, '^\\s+', ''), 1, 512)), '<!doctype html|<html|<head|<body') AS is_html FROM pages",
    "account_review_leads": "SELECT c_custkey AS profile_id, 'account_banned' AS name, 0.3::DOUBLE AS weight FROM customer WHERE c_custkey % 12 = 0 UNION ALL SELECT c_custkey, 'sparse_profile', 0.2 FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'offsite_contact_solicitation', 0.5 FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'large_friend_network', 0.2 FROM customer WHERE c_custkey % 300 >= 200 UNION ALL SELECT c_custkey, 'group_name_review_lead', 0.4 FROM customer WHERE c_custkey % 8 = 0 UNION ALL SELECT c_custkey, 'game_name_review_lead', 0.4 FROM customer WHERE c_custkey % 10 = 0",
    "server_review_leads": "SELECT s_suppkey AS profile_id, 'server_name_or_bio_review_lead' AS name, 0.4::DOUBLE AS weight FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'low_verification_public_server', 0.2 FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'small_high_activity_server', 0.2 FROM supplier WHERE s_suppkey % 90 BETWEEN 1 AND 50 AND s_suppkey % 40 >= greatest(10, floor(s_suppkey % 90 * 0.6))",
    "exchange_accounts": with_views("targets") + "SELECT DISTINCT platform AS account_type, username AS account_login, case_id FROM targets",
}
