"""Queries that assemble inputs and stored shapes: signals and profiles from artifacts, lookups, manifests,
exports, paths with evidence and exchange objects; with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A, classifier as C, correlation as R, custody as V, enrichment as N, graph as G, matching as M, notes as O, profiles as P, redaction as D, referral as X, risk as K
from ..operators.scratch import Scratch
from ..sources import domain as S
from ..sources.domain import with_views
from ..sources.tables import table
from .linkage import _CANDIDATES, _GRAPH, _LINKED_GRAPH, _REACH, _edges, _linked_edges, _paths, _start
from .scoring import _RISK, _TIER

_AS_OF = "2001-01-01 00:00:00"


def _signals(s, d):
    return A.risk_signals(S.targets(s, d), S.collected(s, d), _AS_OF)


def _signal_rows(s, d):
    return _signals(s, d).select("target_id", "case_id", F.size("messages").cast("long").alias("messages"), "platform_count", "account_age_days", "friend_count", "game_history_flags", F.array_join("review_leads", "|").alias("review_leads"))


def _scored_targets(s, d):
    """Targets scored from what was collected of them; descriptions go through the classifier."""
    rows = _signals(s, d)
    said = rows.select(F.col("target_id").alias("profile_id"), F.posexplode("messages").alias("message_index", "text"))
    accounts = rows.select(F.col("target_id").alias("profile_id"), "account_age_days", "friend_count")
    verdict = C.classify(said, accounts).select(F.col("profile_id").alias("target_id"), F.col("score").alias("classifier_score"), "decision", "message_count", "flagged_count")
    return K.score(rows.join(verdict, "target_id", "left"))


def _explained(s, d):
    """Explanation objects of targets, with the evidence ids of their artifacts."""
    artifacts = S.artifacts(s, d).where("module_name = 'A'").select("target_id", V.evidence_id(F.col("artifact_id"), F.col("sha256")).alias("evidence_id"))
    found = K.explanation_objects(_scored_targets(s, d), artifacts, "target_id")
    last = F.element_at("reasoning", -1)
    return found.select("target_id", "source_component", "confidence", F.array_join("evidence_refs", ",").alias("evidence_refs"), last.startswith(K.NO_STORE).alias("without_store"), (F.length("finding") > 0).alias("found"))


def _findings(s, d):
    found = A.findings(_scored_targets(s, d))
    return found.select("target_id", "analysis_type", "risk_score", "tier", F.get_json_object("findings", "$.engine").alias("engine"), (F.instr("analyst_notes", "For review by a person") > 0).alias("names_leads"))


def _profiles(s, d):
    rows = A.correlation_profiles(S.targets(s, d), S.collected(s, d))
    return rows.select("target_id", "profile_key", F.size("messages").cast("long").alias("messages"), F.coalesce(F.get("messages", F.lit(0)), F.lit("")).alias("first_message"), "avatar_phash", "avatar_dhash")


def _avatar_scored(s, d):
    p = Scratch(s, "profiles").keep(R.profiles(S.profiles(s, d)), "profiles")
    return p, R.score_pairs(p, R.avatar_candidates(p), A.DEFAULT_AVATARS)


def _sealed(s, d):
    """Pairs of profiles with near avatars, sealed by the nation of their customers."""
    p, scored = _avatar_scored(s, d)
    kept = Scratch(s, "sealed").keep(scored.select("a", "b", "strength", "is_lead", "contradiction_note", "rationale"), "scored")
    keys = table(s, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("case_id"))
    return A.correlation_seals(kept, R.clusters(p, kept), keys)


def _ip(number):
    return F.concat_ws(".", *(F.shiftright(number, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)))


def _hex(number):
    return F.lower(F.hex(number))


def _looked_up(s, d):
    """Addresses of events, looked up in lists made of events and suppliers.

    Every sixth address is an IPv6 one, spelt in two ways; each supplier has nested networks of both families.
    """
    k = F.col("event_id")
    groups = [k % 200, k * 37 % 65536, F.floor(k / 65536)]
    short = F.concat(F.lit("2606:4700:"), F.concat_ws(":", *map(_hex, groups)), F.lit("::"), _hex(k % 65536))
    full = F.upper(F.concat(F.lit("2606:4700:"), F.concat_ws(":", *(F.lpad(F.hex(g), 4, "0") for g in groups)), F.lit(":0:0:"), F.hex(k % 65536)))
    four = _ip(k * 997 % 20_000_000 + 335_544_320)
    events = table(s, d, "events").select("event_id", F.when(k % 6 != 5, four).when(k % 2 == 0, short).otherwise(full).alias("ip"))
    listed = table(s, d, "events").select("event_id", F.when(k % 6 != 5, four).otherwise(short).alias("ip"))
    proxy = F.get(F.array(*map(F.lit, ("tor", "VPN", "PUB", "RES", "WEB", "DCH", "SES", "XYZ"))), (k % 8).cast("int"))
    proxies = listed.where(k % 9 == 1).select("ip", proxy.alias("proxy_type"), F.get(F.array(*map(F.lit, ("ISP", "COM", "MOB", "DCH"))), (k % 4).cast("int")).alias("usage_type"))
    n = F.col("s_suppkey")
    base, own = n * 65536 + 335_544_320, n % 16
    six = F.concat(F.lit("2606:4700:"), _hex(n))
    nested = [
        (F.concat(_ip(base), F.lit("/16")), 0), (F.concat(_ip(base + own * 4096), F.lit("/20")), 1), (F.concat(_ip(base + own * 4096 + own * 256), F.lit("/24")), 2),
        (F.concat(six, F.lit("::/48")), 0), (F.concat(six, F.lit(":"), _hex(own * 4096), F.lit("::/52")), 1),
    ]
    sup = table(s, d, "supplier")
    networks = sup.select(F.explode(F.array(*(F.struct(network.alias("network"), (n + 64512 + level * 100_000).alias("asn")) for network, level in nested))).alias("x")).select("x.*")
    authority = sup.where(n % 4 != 3).select((n + 64512).alias("asn"), F.when(n % 4 == 0, "known-vpn").when(n % 4 == 1, "hosting-datacenter").otherwise("other").alias("category"), F.col("s_name").alias("organization"))
    authority = authority.unionByName(sup.where(n % 3 == 0).select((n + 164512).alias("asn"), F.lit("hosting-datacenter").alias("category"), F.col("s_name").alias("organization")))
    return N.assess(N.with_lookups(events, listed.where(k % 17 == 0), networks, authority, proxies))


def _nodes(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("platform"))


def _members(s, d):
    """Members of resolved entities: customers under the entity of their nation's number."""
    c = table(s, d, "customer")
    platform = F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string"))
    return c.select(F.col("c_custkey").alias("member_id"), F.concat(F.lit("entity-"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.concat_ws(":", platform, "c_name").alias("profile_id"), platform.alias("platform"), F.col("c_name").alias("username"), F.lit('{"supporting_edges": [{"a": "x", "b": "y", "strength": 0.5}]}').alias("justification"))


def _far_path(s, d):
    """The path from the node with the most edges to the one farthest from it."""
    edges, seen = _paths(s, d)
    far = seen.orderBy(F.desc("hops"), "node").first()
    return G.path_with_evidence(edges, _start(edges), far.node if far else -1)


def _justified(s, d):
    """The edges between customers of neighbouring numbers, and every edge asked for from its other end."""
    edges = _edges(s, d)
    return G.edge_justification(edges, _nodes(s, d).select((F.col("node") + 1).alias("a"), F.col("node").alias("b")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def _graphs(s, d):
    """The graph of each nation's customers: edges with both ends in it."""
    nodes = _nodes(s, d)
    inside = _linked_edges(s, d, nodes.select(F.col("node").alias("profile_id"), F.col("entity").alias("group"))).withColumnRenamed("group", "case_id")
    named = nodes.select("node", F.col("entity").alias("case_id"), "platform", F.col("node").cast("string").alias("username"), F.lit(None).cast("string").alias("entity_id"), F.lit("").alias("canonical_handle"))
    return named, inside


def _texts(s, d):
    """Cases, targets and analyses with notes in which values are tagged."""
    k = F.col("case_id")
    cases = S.cases(s, d).withColumn("description", F.concat(F.lit("protected: "), "case_name", F.lit("\nmail a"), k.cast("string"), F.lit("@example.org")))
    targets = S.targets(s, d).withColumn("notes", F.when(F.col("target_id") % 3 == 0, F.concat(F.lit("seen\nPROTECTED:  "), "username", F.lit(" "))))
    analyses = S.analyses(s, d).withColumn("analyst_notes", F.when(F.col("result_id") % 5 == 0, F.concat(F.lit("protected: "), (F.col("result_id") % 7).cast("string"))))
    return cases, targets, analyses


def _export(s, d):
    cases, targets, analyses = _texts(s, d)
    values = D.tagged_values(cases, targets, analyses)
    out = D.case_export(cases, targets, analyses, S.artifacts(s, d), values)
    return out.select("case_id", "description", F.coalesce(F.size("targets"), F.lit(0)).cast("long").alias("targets"), F.expr("coalesce(aggregate(targets, 0L, (a, t) -> a + coalesce(size(t.analyses), 0)), 0L)").alias("analyses"), F.expr("coalesce(aggregate(targets, 0L, (a, t) -> a + coalesce(size(t.artifacts), 0)), 0L)").alias("artifacts"))


def _referrals(s, d):
    """Referrals in digest: handles, scores and numbers of their sections."""
    out = X.document(S.cases(s, d), S.targets(s, d), S.analyses(s, d), S.artifacts(s, d))
    return out.select("case_id", F.col("reporting.analyst").alias("analyst"), F.col("incident.status").alias("status"), F.col("incident.highest_risk_score").alias("highest_risk_score"), F.size("subjects").cast("long").alias("subjects"), F.col("supporting_evidence.artifact_count").cast("long").alias("artifacts"), F.col("provenance.sealed_package").alias("sealed_package"))


QUERIES = {
    "case_referral": _referrals,
    "target_signals": _signal_rows,
    "target_scores": lambda s, d: _scored_targets(s, d).select("target_id", F.round("synergy", 9).alias("synergy"), "risk_score", "tier", "confidence"),
    "target_findings": _findings,
    "explanation_objects": _explained,
    "artifact_profiles": _profiles,
    "sealed_correlation": lambda s, d: _sealed(s, d).select("case_id", "artifact_type", "groups", "sha256"),
    "pair_evidence": lambda s, d: A.normalised_pairs(_avatar_scored(s, d)[1]).select("a", "b", F.round("strength", 9).alias("strength"), "is_lead", "contradiction_note", F.size("top_signals").cast("long").alias("top_signals")),
    "address_lookups": lambda s, d: _looked_up(s, d).select("event_id", "status", "on_tor_list", "asn", "proxy_type", "confidence", "network_type", "is_anonymized"),
    "custody_manifest": lambda s, d: V.manifest_header(V.custody_manifest(S.targets(s, d), S.artifacts(s, d), S.custody(s, d)), O.valid(S.notes(s, d)), V.verify_chain(V.build_chain(S.custody(s, d)))),
    "package_seal": lambda s, d: V.sealed_package(S.targets(s, d).select("case_id", F.concat(F.col("target_id").cast("string"), F.lit(".json")).alias("file_name"), F.sha2(F.col("target_id").cast("string"), 256).alias("sha256"))).drop("manifest"),
    "notes_custody": lambda s, d: V.build_chain(O.custody_rows(S.notes(s, d))).select("case_id", "log_id", "notes", "entry_hash"),
    "audit_events": lambda s, d: O.audit_events(S.custody(s, d).where("artifact_id is not null"), "artifact_collected", "artifact_id", "sha256").groupBy("event", "level", "analyst").agg(F.count("*").alias("n"), F.min("details").alias("first_details")),
    "protected_values": lambda s, d: D.tagged_values(*_texts(s, d)).select("case_id", F.array_join("values", "|").alias("tagged")),
    "case_export": _export,
    "path_with_evidence": lambda s, d: _far_path(s, d).select(F.col("position").cast("long").alias("position"), "node_from", "node_to", "strength", "is_lead", "has_contradiction"),
    "edge_justification": _justified,
    "canonical_graph": lambda s, d: G.canonical_graph(*_graphs(s, d)).select("case_id", F.get_json_object("graph", "$.node_count").cast("long").alias("nodes"), F.get_json_object("graph", "$.edge_count").cast("long").alias("edges")),
    "graph_links": lambda s, d: G.force_layout(_nodes(s, d).withColumns({"username": F.lit(""), "entity_id": F.lit("")}), _graphs(s, d)[1])[1],
    "resolved_entities": lambda s, d: A.stored_entities(S.entities(s, d), _members(s, d)).select("entity_id", "canonical_handle", F.size("members").cast("long").alias("members"), F.get(F.col("members"), F.lit(0))["member_id"].alias("first_member")),
    "exchange_identities": lambda s, d: P.identity_objects(S.entities(s, d), _AS_OF).select("case_id", "id", "name", "identity_class"),
    "exchange_groupings": lambda s, d: P.grouping_objects(P.identity_objects(S.entities(s, d), _AS_OF).unionByName(P.identity_objects(S.entities(s, d).withColumn("entity_id", F.concat("entity_id", F.lit("-b"))), _AS_OF)), _AS_OF).select("case_id", "id", F.size("object_refs").cast("long").alias("objects")),
    "adapter_status": lambda s, d: M.adapter_status(s),
    "database_status": lambda s, d: N.database_status(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("2000-12-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"), F.lit(" 12:00:00"))).alias("modified_at")), _AS_OF),
}

_COLLECTED = with_views("targets", "collected").replace("AS raw_data FROM lineitem", "AS raw FROM lineitem").replace("collected AS (", "collected AS (SELECT * EXCLUDE (raw), CASE WHEN json_valid(raw) THEN raw END AS raw_data FROM (").replace(" AS raw FROM lineitem)", " AS raw FROM lineitem))") + f""",
 prof AS (SELECT target_id, arg_max(raw_data, (artifact_id, raw_data)) AS p FROM collected WHERE module_name = 'RobloxOSINT' AND raw_data IS NOT NULL GROUP BY 1),
 scan AS (SELECT target_id, max((raw_data->>'$.platforms_found')::INT) AS found FROM collected WHERE module_name = 'SherlockIntegration' AND json_type(raw_data, '$.platforms_found') IN ('UBIGINT', 'BIGINT') GROUP BY 1),
 sig AS (SELECT target_id, case_id, (coalesce(trim(p->>'$.description'), '') <> '')::INT::BIGINT AS messages, greatest(1, coalesce(found, 1)) AS platform_count, greatest(0, floor((epoch(TIMESTAMP '{_AS_OF}') - epoch(replace(replace(p->>'$.created', 'T', ' '), 'Z', '')::TIMESTAMP)) / 86400))::INT AS account_age_days,
  (p->>'$.friend_count')::INT AS friend_count, list_filter([p->>'$.groups[0].name', p->>'$.games[0].name'], lambda n: n IS NOT NULL AND regexp_matches(lower(n), 'condo|scented con|vibe|18\\+|nsfw')) AS leads FROM targets LEFT JOIN prof USING (target_id) LEFT JOIN scan USING (target_id))
"""
_SIGNALS = _COLLECTED + """, signals AS (SELECT target_id AS case_id, CASE WHEN messages > 0 THEN (CASE WHEN p_known AND account_age_days < 30 AND friend_count > 200 THEN 0.12 + 0.08 WHEN p_known AND account_age_days < 30 AND friend_count > 100 THEN 0.12 ELSE 0 END)::DOUBLE END AS classifier_score, 'allow' AS decision, CASE WHEN messages > 0 THEN 1 END AS message_count, 0 AS flagged_count, platform_count, false AS is_tor, false AS is_vpn, CASE WHEN p_known THEN account_age_days END AS account_age_days, friend_count,
  false AS late_night_activity, len(leads) AS game_history_flags, 0 AS prior_case_flags, NULL::INT AS graph_lead_platforms, false AS graph_has_contradictions, leads FROM (SELECT sig.*, target_id IN (SELECT target_id FROM prof) AS p_known FROM sig))
""" + _RISK[_RISK.index(",\n raw AS"):]  # fmt: skip
_LOOKUPS = """WITH ev AS (SELECT event_id, event_id % 6 = 5 AS six, event_id * 997 % 20000000 AS n FROM events),
 o AS (SELECT event_id, CASE WHEN six THEN event_id % 200 ELSE n // 65536 END AS owner, CASE WHEN six THEN event_id * 37 % 65536 // 4096 ELSE n % 65536 // 4096 END AS part, CASE WHEN NOT six THEN n % 4096 // 256 END AS deep FROM ev),
 w AS (SELECT event_id, s_suppkey, CASE WHEN part <> s_suppkey % 16 THEN 0 WHEN deep = s_suppkey % 16 THEN 2 ELSE 1 END AS level FROM o LEFT JOIN supplier ON s_suppkey = owner),
 a AS (SELECT event_id, event_id % 17 = 0 AS tor, s_suppkey + 64512 + level * 100000 AS asn, CASE WHEN event_id % 9 = 1 THEN ['TOR', 'VPN', 'PUB', 'RES', 'WEB', 'DCH', 'SES', 'XYZ'][event_id % 8 + 1] END AS pt, CASE WHEN event_id % 9 = 1 THEN ['ISP', 'COM', 'MOB', 'DCH'][event_id % 4 + 1] ELSE '' END AS usage,
  CASE WHEN level = 0 THEN CASE s_suppkey % 4 WHEN 0 THEN 'known-vpn' WHEN 1 THEN 'hosting-datacenter' WHEN 2 THEN 'other' ELSE '' END WHEN level = 1 AND s_suppkey % 3 = 0 THEN 'hosting-datacenter' ELSE '' END AS cat FROM w),
 b AS (SELECT *, coalesce(pt, '') AS proxy, cat IN ('known-vpn', 'hosting-datacenter') AS rec FROM a),
 c AS (SELECT *, (usage IN ('ISP', 'COM') AND (rec OR proxy IN ('DCH', 'RES', 'PUB', 'WEB')) AND NOT tor AND proxy NOT IN ('VPN', 'TOR'))::INT + (cat = 'other')::INT + (proxy = 'XYZ')::INT AS odd FROM b),
 e AS (SELECT *, least(100, 60 * tor::INT + CASE proxy WHEN 'TOR' THEN 55 WHEN 'VPN' THEN 40 WHEN 'PUB' THEN 35 WHEN 'RES' THEN 35 WHEN 'WEB' THEN 30 WHEN 'DCH' THEN 35 ELSE 0 END + CASE cat WHEN 'known-vpn' THEN 40 WHEN 'hosting-datacenter' THEN 30 ELSE 0 END + 15 * odd) AS confidence FROM c)
 SELECT event_id, 'assessed' AS status, tor AS on_tor_list, asn, pt AS proxy_type, confidence, CASE WHEN tor OR proxy = 'TOR' THEN 'tor-exit' WHEN proxy = 'VPN' OR cat = 'known-vpn' THEN 'known-vpn' WHEN proxy = 'DCH' OR cat = 'hosting-datacenter' THEN 'hosting-datacenter' WHEN usage = 'MOB' THEN 'mobile' WHEN odd > 0 THEN 'suspicious' WHEN asn IS NOT NULL OR usage IN ('ISP', 'COM') THEN 'residential' ELSE 'unknown' END AS network_type, confidence >= 50 AS is_anonymized FROM e"""
_TAGGED = with_views("cases", "targets", "analyses") + """, v AS (SELECT case_id, 0 AS surface, target_id AS r, username AS value FROM targets WHERE target_id % 3 = 0 UNION ALL SELECT case_id, 1, 0, case_name FROM cases UNION ALL SELECT case_id, 2, result_id, (result_id % 7)::VARCHAR FROM analyses JOIN targets USING (target_id) WHERE result_id % 5 = 0),
 f AS (SELECT case_id, value, min((surface, r)) AS spot FROM v GROUP BY 1, 2)
"""
_INSIDE = _LINKED_GRAPH + ", inside AS (SELECT x.entity AS case_id, e.* FROM edges e JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b WHERE x.entity = y.entity)"
_UUID5 = "(WITH u AS (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || {0}::BLOB) AS h) SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM u)"
_REACHED = _GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", bfs(node, hops) AS (SELECT node, 0::BIGINT FROM begin_at UNION SELECT e.other, hops + 1 FROM bfs JOIN ends e ON e.node = bfs.node WHERE hops < 40), d AS (SELECT node, min(hops) AS hops FROM bfs GROUP BY 1), v AS (SELECT d.node, d.hops, min(q.node) AS via FROM d LEFT JOIN ends e ON e.other = d.node LEFT JOIN d q ON q.node = e.node AND q.hops = d.hops - 1 GROUP BY 1, 2)"
_NOTES = with_views("notes") + ", ok AS (SELECT note_id AS log_id, created_at AS timestamp, 'analyst_note_added' AS action, case_id, analyst, 'note ' || note_id || coalesce(' on finding ' || finding_ref, '') || coalesce(' (target ' || target_id || ')', '') AS notes FROM notes WHERE trim(note) <> '')"
_NOTE_JSON = """'{{"action":"' || num.action || '","analyst":"' || num.analyst || '","artifact_id":null,"case_id":"' || num.case_id || '","notes":"' || num.notes || '","previous_hash":"' || {0} || '","sha256":null,"target_id":null,"timestamp":"' || num.timestamp || '"}}'"""

ORACLE_SQL = {
    "case_referral": with_views("cases", "targets", "analyses", "artifacts") + ", l AS (SELECT target_id, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY analyzed_at DESC, result_id DESC, risk_score DESC NULLS LAST) AS n FROM analyses) WHERE n = 1), h AS (SELECT case_id, count(*) AS subjects, max(risk_score) AS highest FROM targets LEFT JOIN l USING (target_id) GROUP BY 1), e AS (SELECT case_id, count(*) AS n FROM artifacts JOIN targets USING (target_id) GROUP BY 1) SELECT case_id, analyst_name AS analyst, status, highest AS highest_risk_score, coalesce(subjects, 0) AS subjects, coalesce(n, 0) AS artifacts, 'no sealed package' AS sealed_package FROM cases LEFT JOIN h USING (case_id) LEFT JOIN e USING (case_id)",
    "target_signals": _COLLECTED + "SELECT target_id, case_id, messages, platform_count, account_age_days, friend_count, len(leads)::INT AS game_history_flags, array_to_string(leads, '|') AS review_leads FROM (SELECT sig.* REPLACE (CASE WHEN target_id IN (SELECT target_id FROM prof) THEN account_age_days END AS account_age_days) FROM sig)",
    "target_scores": _SIGNALS + f"SELECT case_id AS target_id, round(synergy, 9) AS synergy, risk_score, {_TIER} AS tier, CASE WHEN cg = 'high' AND low = 0 THEN 'high' WHEN cg = 'low' OR low >= 2 THEN 'low' ELSE 'medium' END AS confidence FROM (SELECT *, round(s, 2) AS risk_score FROM scored)",
    "explanation_objects": _SIGNALS.replace("WITH ", f"WITH artifacts AS ({S.SQL['artifacts']}), ", 1) + f""", ev AS (SELECT target_id, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS refs FROM (SELECT target_id, {_UUID5.format(chr(40) + 'artifact_id || ' + chr(39) + ':' + chr(39) + ' || sha256)')} AS evidence_id FROM artifacts WHERE module_name = 'A') GROUP BY 1),
 x AS (SELECT case_id AS target_id, unnest([{{'c': 'grooming_classifier', 's': cg}}, {{'c': 'cross_platform_correlation', 's': cx}}, {{'c': 'anonymization_ip', 's': ca}}, {{'c': 'behavioral_velocity', 's': cv}}, {{'c': 'historical_signals', 's': 'high'}}, {{'c': 'overall_assessment', 's': CASE WHEN cg = 'high' AND low = 0 THEN 'high' WHEN cg = 'low' OR low >= 2 THEN 'low' ELSE 'medium' END}}]) AS u FROM scored)
 SELECT target_id, u.c AS source_component, u.s AS confidence, coalesce(refs, '') AS evidence_refs, refs IS NULL AS without_store, true AS found FROM x LEFT JOIN ev USING (target_id)""",
    "target_findings": _SIGNALS + f"SELECT case_id AS target_id, 'risk_engine_v1' AS analysis_type, risk_score, {_TIER} AS tier, 'RiskEngine' AS engine, len(leads) > 0 AS names_leads FROM (SELECT *, round(s, 2) AS risk_score FROM scored)",
    "artifact_profiles": _COLLECTED + ", ok AS (SELECT target_id, artifact_id, trim(raw_data->>'$.description') AS text, raw_data->>'$.avatar_phash' AS ph FROM collected WHERE module_name = 'RobloxOSINT' AND raw_data IS NOT NULL), g AS (SELECT target_id, count(*) FILTER (WHERE text <> '') AS messages, arg_min(text, (artifact_id, text)) FILTER (WHERE text <> '') AS first_message, arg_max(ph, (artifact_id, ph)) AS avatar_phash FROM ok GROUP BY 1) SELECT target_id, platform || ':' || username AS profile_key, coalesce(messages, 0) AS messages, coalesce(first_message, '') AS first_message, avatar_phash, NULL::VARCHAR AS avatar_dhash FROM targets LEFT JOIN g USING (target_id)",
    "address_lookups": _LOOKUPS,
    "custody_manifest": with_views("targets", "artifacts", "custody", "notes") + ", e AS (SELECT artifact_id, count(*) AS n FROM custody WHERE artifact_id IS NOT NULL GROUP BY 1), h AS (SELECT case_id, count(*) AS artifact_count, coalesce(sum(n), 0)::BIGINT AS event_count FROM artifacts JOIN targets USING (target_id) LEFT JOIN e USING (artifact_id) GROUP BY 1), w AS (SELECT case_id, count(*) AS note_count FROM notes WHERE trim(note) <> '' GROUP BY 1), ch AS (SELECT case_id, count(*) AS entries FROM custody GROUP BY 1) SELECT case_id, artifact_count, event_count, coalesce(note_count, 0) AS note_count, entries IS NOT NULL AS chain_available, CASE WHEN entries IS NOT NULL THEN true END AS chain_intact, entries AS chain_entries FROM h LEFT JOIN w USING (case_id) LEFT JOIN ch USING (case_id)",
    "package_seal": with_views("targets") + """SELECT case_id, sha256('{"case_id":' || case_id || ',"files":[' || string_agg('{"file_name":"' || target_id || '.json","sha256":"' || sha256(target_id::VARCHAR) || '"}', ',' ORDER BY target_id || '.json') || '],"package_version":"1.0"}') AS manifest_sha256 FROM targets GROUP BY 1""",
    "notes_custody": _NOTES.replace("WITH ", "WITH RECURSIVE ", 1) + f", num AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY log_id) AS n FROM ok), chain AS (SELECT case_id, log_id, notes, n, sha256({_NOTE_JSON.format(chr(39) + '0' * 64 + chr(39))}) AS entry_hash FROM num WHERE n = 1 UNION ALL SELECT num.case_id, num.log_id, num.notes, num.n, sha256({_NOTE_JSON.format('c.entry_hash')}) FROM chain c JOIN num ON num.case_id = c.case_id AND num.n = c.n + 1) SELECT case_id, log_id, notes, entry_hash FROM chain",
    "audit_events": with_views("custody") + """SELECT 'artifact_collected' AS event, 'info' AS level, analyst, count(*) AS n, min('{"artifact_id":' || artifact_id || ',"sha256":"' || substr(sha256, 1, 16) || '..."}') AS first_details FROM custody WHERE artifact_id IS NOT NULL GROUP BY 3""",
    "protected_values": _TAGGED + "SELECT case_id, string_agg(value, '|' ORDER BY spot) AS tagged FROM f GROUP BY 1",
    "path_with_evidence": _REACHED + ", way AS (SELECT * FROM (SELECT * FROM v ORDER BY hops DESC, node LIMIT 1) UNION ALL SELECT v.* FROM way JOIN v ON v.node = way.via) SELECT hops - 1 AS position, via AS node_from, node AS node_to, strength, is_lead, has_contradiction FROM way JOIN edges ON a = least(node, via) AND b = greatest(node, via)",
    "shortest_path": _REACHED + " SELECT node, hops, via FROM v",
    "evidence_ids": with_views("artifacts") + f"SELECT artifact_id, {_UUID5.format(chr(40) + 'artifact_id || ' + chr(39) + ':' + chr(39) + ' || sha256)')} AS evidence_id FROM artifacts",
    "entity_promotion": "SELECT 'entity-' || component_id AS entity_id, first_member::VARCHAR AS canonical_handle, 'A. Analyst' AS promoted_by, members, mean_strength FROM (" + _REACH + _CANDIDATES + ")",
    "edge_justification": _GRAPH + "SELECT n.node + 1 AS a, n.node AS b, strength, is_lead, has_contradiction FROM nodes n LEFT JOIN edges e ON e.a = n.node AND e.b = n.node + 1 UNION ALL SELECT b, a, strength, is_lead, has_contradiction FROM edges",
    "canonical_graph": _INSIDE + "SELECT n.case_id, n.nodes, coalesce(m.edges, 0) AS edges FROM (SELECT entity AS case_id, count(*) AS nodes FROM nodes GROUP BY 1) n LEFT JOIN (SELECT case_id, count(*) AS edges FROM inside GROUP BY 1) m USING (case_id)",
    "graph_links": _INSIDE + "SELECT a AS source, b AS target, strength, is_lead AS lead, has_contradiction AS contradicted FROM inside",
    "resolved_entities": with_views("entities") + "SELECT entity_id, canonical_handle, count(c_custkey) AS members, min(c_custkey) AS first_member FROM entities LEFT JOIN customer ON entity_id = 'entity-' || c_nationkey GROUP BY 1, 2",
    "exchange_identities": with_views("entities") + f"SELECT case_id, 'identity--' || {_UUID5.format(chr(40) + chr(39) + 'identity|entity|' + chr(39) + ' || entity_id)')} AS id, canonical_handle AS name, 'unknown' AS identity_class FROM entities",
    "exchange_groupings": with_views("entities") + f"SELECT case_id, 'grouping--' || {_UUID5.format(chr(40) + chr(39) + 'grouping|' + chr(39) + ' || case_id)')} AS id, 2::BIGINT AS objects FROM entities",
    "adapter_status": "SELECT * FROM (VALUES ('local_database', 'active'), ('photodna', 'disabled (approval pending)'), ('ncmec', 'disabled (approval pending)')) t(adapter, status)",
    "database_status": f"WITH f AS (SELECT s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN ('2000-12-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') || ' 12:00:00')::TIMESTAMP END AS made FROM supplier), g AS (SELECT *, floor((epoch(TIMESTAMP '{_AS_OF}') - epoch(made)) / 86400)::BIGINT AS age_days FROM f) SELECT name, made IS NOT NULL AS present, age_days, coalesce(age_days > 7, false) AS stale, made IS NULL OR age_days > 7 AS manual_action_required FROM g",
}
