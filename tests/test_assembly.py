"""Literal cases for assembled inputs, stored shapes, manifests, exports and registries."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from casewright.operators import assembly, custody, enrichment, evaluation, graph, matching, notes, profiles, redaction, referral, risk
from casewright.sources import schemas

TARGETS = "target_id long, case_id long, platform string, username string"
ARTIFACTS = "artifact_id long, target_id long, module_name string, raw_data string"


def collected(spark):
    targets = spark.createDataFrame([(1, 7, "Roblox", "ann"), (2, 7, None, "bob"), (3, 8, "", "eve")], TARGETS)
    rows = [
        (10, 1, "RobloxOSINT", '{"created": "2020-01-01T00:00:00Z", "friend_count": 5, "description": " hi ", "groups": [{"name": "VIBE club"}, {"name": null}, {}], "games": [{"name": "18+ x"}], "avatar_phash": "aa"}'),
        (11, 1, "RobloxOSINT", '{"created": "2020-12-31", "friend_count": "6", "description": "new", "avatar_phash": ""}'),
        (12, 1, "RobloxOSINT", '{"created": '), (13, 1, "RobloxOSINT", "[1]"), (14, 1, "SherlockIntegration", '{"platforms_found": 4}'), (15, 1, "SherlockIntegration", '{"platforms_found": 2.5}'),
        (16, 2, "SherlockIntegration", '{"platforms_found": 0}'), (17, 2, "RobloxOSINT", '{"created": "soon", "friend_count": 1.5, "description": "  "}'), (18, 3, "Other", '{"description": "no"}'), (19, 3, "RobloxOSINT", None),
    ]
    return targets, spark.createDataFrame(rows, ARTIFACTS)


def test_signals_from_artifacts(spark):
    targets, artifacts = collected(spark)
    got = {r.target_id: r for r in assembly.risk_signals(targets, artifacts, "2021-01-01 00:00:00").collect()}
    assert (got[1].messages, got[1].platform_count, got[1].account_age_days, got[1].friend_count, got[1].game_history_flags) == (["new"], 4, 1, None, 0)
    assert (got[2].messages, got[2].platform_count, got[2].account_age_days, got[2].friend_count) == ([], 1, None, None)
    assert (got[3].messages, got[3].platform_count, got[3].account_age_days) == ([], 1, None)
    first = assembly.risk_signals(targets, artifacts.where("artifact_id = 10"), "2021-01-01 00:00:00").where("target_id = 1").first()
    assert first.review_leads == ["VIBE club", "18+ x"] and first.friend_count == 5 and first.account_age_days == 366
    row = assembly.findings(risk.score(assembly.risk_signals(targets, artifacts.where("artifact_id = 10"), "2021-01-01 00:00:00").withColumn("ai_context", F.lit("a remark")))).where("target_id = 1").first()
    body = json.loads(row.findings)
    assert body["review_leads"] == ["VIBE club", "18+ x"] and body["ai_context"] == "a remark" and "VIBE club, 18+ x." in row.analyst_notes and len(body["components"]) == 5
    plain = risk.score(assembly.risk_signals(targets, artifacts.where("artifact_id = 10"), "2021-01-01 00:00:00")).where("target_id = 1").first()
    assert plain.risk_score == row.risk_score


def test_profiles_from_artifacts(spark):
    got = {r.target_id: r for r in assembly.correlation_profiles(*collected(spark)).collect()}
    assert (got[1].profile_key, got[1].messages, got[1].avatar_phash) == ("roblox:ann", ["hi", "new"], "aa")
    assert (got[2].profile_key, got[2].messages, got[3].profile_key) == ("unknown:bob", [], "unknown:eve")


def test_stored_entities_and_candidates(spark):
    entities = spark.createDataFrame([("e1", "c", "h", "Ana", "2024"), ("e2", "c", "g", "Bo", "2023")], "entity_id string, case_id string, canonical_handle string, promoted_by string, promoted_at string")
    members = spark.createDataFrame([(2, "e1", "p:y", "p", "y", "broken"), (1, "e1", "p:x", "p", "x", '{"supporting_edges": [{"a": "1", "b": "2", "strength": 0.5}]}')], "member_id long, entity_id string, profile_id string, platform string, username string, justification string")
    rows = assembly.stored_entities(entities, members).collect()
    assert [r.entity_id for r in rows] == ["e2", "e1"] and rows[0].members == []
    assert [(m.member_id, len(m.supporting_edges)) for m in rows[1].members] == [(1, 1), (2, 0)]
    sealed = json.dumps({"candidate_id": "k", "case_id": "c", "members": [{"profile_id": "p:x"}, {"profile_id": "q:y", "platform": "q", "username": "y", "justification": {"supporting_edges": [{"a": "1", "b": "2", "strength": 1}]}}]})
    got = {r.profile_id: r for r in assembly.stored_candidates(spark.createDataFrame([(sealed,), ("{}",)], "raw_data string")).collect()}
    assert (got["p:x"].platform, got["p:x"].username, got["p:x"].supporting_edges, got["p:x"].mean_strength) == ("unknown", "p:x", [], 0.0) and len(got["q:y"].supporting_edges) == 1


def test_paths_and_labels(spark):
    edges = spark.createDataFrame([("a:1", "b:2", 0.5, True, False), ("b:2", "c:3", 0.6, False, True), ("x:8", "y:9", 0.1, True, False)], "a string, b string, strength double, is_lead boolean, has_contradiction boolean")
    hops = graph.path_with_evidence(edges, "a:1", "c:3").orderBy("position").collect()
    assert [(r.node_from, r.node_to, r.strength, r.has_contradiction) for r in hops] == [("a:1", "b:2", 0.5, False), ("b:2", "c:3", 0.6, True)]
    for start, end, leads in (("a:1", "x:8", False), ("a:1", "nobody", False), ("nobody", "a:1", False), ("a:1", "c:3", True)):
        assert graph.path_with_evidence(edges, start, end, leads).collect() == []
    members = spark.createDataFrame([("a:1", "e1", "h1", 1), ("a:1", "e2", "h2", 2), ("z:0", "e1", "h1", 1)], "profile_id string, entity_id string, canonical_handle string, seq long")
    got = {r.node: (r.platform, r.username, r.entity_id, r.canonical_handle) for r in graph.labelled_nodes(edges, members).collect()}
    assert got["a:1"] == ("a", "1", "e2", "h2") and got["z:0"] == ("z", "0", "e1", "h1") and got["y:9"] == ("y", "9", None, "") and len(got) == 6
    one = graph.labelled_nodes(edges, members).withColumn("case_id", F.lit("k"))
    texts = {graph.canonical_graph(x, edges.withColumn("case_id", F.lit("k"))).first().sha256 for x in (one, one.orderBy(F.desc("node")))}
    assert len(texts) == 1


def test_manifest_and_seal(spark):
    targets = spark.createDataFrame([(1, 7, "p", "u")], TARGETS)
    artifacts = spark.createDataFrame([(10, 1, "m", "t", "ab", "2024"), (11, 1, "m", "t", "cd", "2024")], "artifact_id long, target_id long, module_name string, artifact_type string, sha256 string, collected_at string")
    log = spark.createDataFrame([(2, "t2", "seen", 10, "Bo", None), (1, "t1", "add", 10, "Ana", "n"), (3, "t3", "case", None, "Ana", None)], "log_id long, timestamp string, action string, artifact_id long, analyst string, notes string")
    rows = custody.custody_manifest(targets, artifacts, log)
    got = {r.artifact_id: [e.action for e in r.custody_events] for r in rows.collect()}
    assert got == {10: ["add", "seen"], 11: []}
    verdicts = spark.createDataFrame([], "case_id long, intact boolean, entries_checked long")
    head = custody.manifest_header(rows, spark.createDataFrame([(7,)], "case_id long"), verdicts).first()
    assert (head.artifact_count, head.event_count, head.note_count, head.chain_available, head.chain_intact) == (2, 2, 1, False, None)
    package = custody.sealed_package(spark.createDataFrame([(7, "b", "2"), (7, "a", "1")], "case_id long, file_name string, sha256 string"))
    assert [f["file_name"] for f in json.loads(package.first().manifest)["files"]] == ["a", "b"] and custody.seal_holds(package).first().intact
    assert not custody.seal_holds(package.withColumn("manifest", F.concat("manifest", F.lit(" ")))).first().intact
    assert hashlib.sha256(package.first().manifest.encode()).hexdigest() == package.first().manifest_sha256


def test_notes_and_audit(spark):
    rows = spark.createDataFrame([(1, 7, 3, "f", "Ana", " x "), (2, 7, None, None, "Ana", "\n"), (3, 7, None, "", "", "y"), (4, None, None, None, "Bo", "z"), (5, 7, None, "", "Bo", "w")], "note_id long, case_id long, target_id long, finding_ref string, analyst string, note string").withColumn("created_at", F.lit("t"))
    assert [r.note for r in notes.valid(rows).orderBy("note_id").collect()] == ["x", "w"]
    assert [r.notes for r in notes.custody_rows(rows).orderBy("log_id").collect()] == ["note 1 on finding f (target 3)", "note 5"]
    assert [r.note_id for r in notes.of_finding(rows, 7, "f").collect()] == [1]
    event = notes.audit_events(spark.createDataFrame([("7", "0" * 64)], "case_id string, sha256 string"), "tier3_escalation", "sha256").first()
    assert (event.level, event.analyst, json.loads(event.details)["sha256"]) == ("warning", "system", "0" * 16 + "...")


def test_case_export_is_masked(spark):
    cases = spark.createDataFrame([(7, "n", "protected: Zed\nmail a@b.org")], "case_id long, case_name string, description string")
    targets = spark.createDataFrame([(1, 7, "p", "zed99", "PROTECTED: Kim Lee")], TARGETS + ", notes string")
    analyses = spark.createDataFrame([(1, 1, 2.0, "protected: Zed", "2024-01-01"), (2, 1, 3.0, "saw kim lee", "2024-02-01")], "result_id long, target_id long, risk_score double, analyst_notes string, analyzed_at string")
    artifacts = spark.createDataFrame([(1, 1, "m", "t", "2024")], "artifact_id long, target_id long, module_name string, artifact_type string, collected_at string")
    values = redaction.tagged_values(cases, targets, analyses, spark.createDataFrame([(7, "Max"), (7, "")], "case_id long, value string"))
    assert values.first()["values"] == ["Kim Lee", "Zed", "Max"]
    row = redaction.case_export(cases, targets, analyses, artifacts, values).first()
    mark = "[REDACTED - PROTECTED]"
    assert row.targets[0].username == f"{mark}99" and row.targets[0].analyses[0].analyst_notes == f"saw {mark}" and "[REDACTED - EMAIL]" in row.description and [a.risk_score for a in row.targets[0].analyses] == [3.0, 2.0]


def test_lists_and_sources(spark):
    entry = [("1", "o", "known-vpn", "s", 0, []), ("2", "o", "known-vpn", "s", 1, ["x"]), ("1", "o", "known-vpn", "s", 2, [])]
    frame = spark.createDataFrame(entry, "asn string, organization string, category string, source string, position long, extra_keys array<string>")
    assert [r.problem for r in enrichment.validate_authority(frame).orderBy("position").collect()] == [None, "unexpected field", "duplicate asn"]
    assert enrichment.accepted_authority(frame).count() == 1
    with pytest.raises(ValueError):
        enrichment.accepted_authority(frame, strict=True)
    lines = lambda n: spark.createDataFrame([(f"8.8.{k // 256}.{k % 256}",) for k in range(n)] + [("bad",)], "value string")
    assert enrichment.accepted_exit_list(lines(100)).count() == 100
    with pytest.raises(ValueError):
        enrichment.accepted_exit_list(lines(99))
    status = {r.name: r for r in enrichment.database_status(spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), ("c", None)], "name string, modified_at string"), "2024-01-09 00:00:00").collect()}
    assert [status[k].stale for k in "abc"] == [True, False, False] and status["c"].manual_action_required and status["b"].age_days == 7
    assessed = enrichment.assess(spark.createDataFrame([("8.8.8.8", True, None, None, None, None)], "ip string, on_tor_list boolean, proxy_type string, usage_type string, asn long, asn_category string"))
    record = enrichment.lookup_custody(assessed, spark.createDataFrame([("tor", "t", True), ("geo", None, False)], "name string, loaded_at string, available boolean"), "now").first()
    assert record.absent_sources == ["geo"] and json.loads(record.output)["confidence"] == 60
    assert {r.adapter: r.status for r in matching.adapter_status(spark).collect()}["ncmec"].startswith("disabled")


def test_registry_and_schemas(spark):
    registry = profiles.default_registry()
    assert registry.platforms() == ["discord", "roblox"] and registry.capabilities() == {"discord": True, "roblox": True}
    rows = spark.createDataFrame([(1, "", "dm me", False, 1, [], [])], "profile_id long, display_name string, description string, is_banned boolean, friend_count int, groups array<string>, games array<string>")
    assert registry.normalised("ROBLOX", rows).columns == list(profiles.KEYS) and registry.normalised(None, rows) is None
    assert [x.name for x in registry.leads("roblox", rows).first().leads] == ["offsite_contact_solicitation"]
    for name in schemas.DDL:
        assert schemas.empty(spark, name).count() == 0
    odd = schemas.conformed(spark.createDataFrame([("c", "n", "lost"), (None, "n", "open"), ("d", "n", "open")], "case_id string, case_name string, status string"), "cases")
    assert sorted(r.problem for r in schemas.problems(odd, "cases").collect()) == ["case_id is missing", "unknown status"]


def test_referral_document(spark):
    cases = spark.createDataFrame([(7, "n", "mail a@b.org", "open"), (8, "m", None, "closed")], "case_id long, case_name string, description string, status string")
    targets = spark.createDataFrame([(1, 7, "p", "zed")], TARGETS)
    analyses = spark.createDataFrame([(1, 1, 2.0, "2024-01-01"), (2, 1, 3.5, "2024-02-01")], "result_id long, target_id long, risk_score double, analyzed_at string")
    artifacts = spark.createDataFrame([(5, 1, "1234567890abcdef")], "artifact_id long, target_id long, sha256 string")
    packages = spark.createDataFrame([(7, "ff")], "case_id long, manifest_sha256 string")
    got = {r.case_id: r for r in referral.document(cases, targets, analyses, artifacts, packages).collect()}
    assert (got[7].incident.concern, got[7].incident.highest_risk_score, got[7].subjects[0].reported_username) == ("mail [REDACTED - EMAIL]", 3.5, "zed")
    assert got[7].supporting_evidence.artifacts[0].sha256 == "1234567890abcdef" and got[7].provenance.sealed_package == "ff"
    assert (got[8].subjects, got[8].supporting_evidence.artifact_count, got[8].provenance.sealed_package) == ([], 0, "no sealed package")
    assert referral.document(cases, targets, analyses, artifacts, redacted=False).where("case_id = 7").first().incident.concern == "mail a@b.org"


def test_flagged_games(spark):
    frame = spark.createDataFrame([(["Big CONDO", "Obby", "my18plus"],), (None,), ([],)], "g array<string>")
    assert [r[0] for r in frame.select(evaluation.flagged_games(F.col("g"))).collect()] == [2, 0, 0]
