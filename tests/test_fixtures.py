"""Small literal cases with results worked out by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import classifier, correlation, custody, enrichment, evaluation, graph, matching, profiles, redaction, referral, retention, risk, timeline
from casewright.operators.components import connected_components
from casewright.operators.scratch import Scratch
from casewright.sources import readers
from casewright.streaming import events as streaming

PACK = classifier.RulePack({f"c{k}": (w, f"c{k} seen", (rf"\b{word}\b",)) for k, (w, word) in enumerate(((0.5, "alpha"), (0.3, "beta"), (0.2, "gamma"), (0.0, "delta")))}, (r"\bquiet\b",), sequences=((frozenset({"c0", "c1"}), 0.15),))


def classified(spark, *texts, **extra):
    messages = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "profile_id long, message_index long, text string")
    people = spark.createDataFrame([(1, extra["age"], extra["friends"])], "profile_id long, account_age_days int, friend_count int") if extra else None
    return classifier.classify(messages, people, PACK).first()


def test_classifier(spark):
    assert (classified(spark, "nothing", None).score, classified(spark, "nothing", "x").decision) == (0.0, "allow")
    one = classified(spark, "alpha alpha", "alpha quiet", "none")
    assert one.score == pytest.approx(0.5 * 2 / 3) and one.flagged_count == 1 and one.message_count == 3 and one.top_signals == ["c0 seen (2 instances)"]
    assert classified(spark, "Alpha " * 3, "x").score == classified(spark, "alpha " * 30, "x").score == 0.5
    both = classified(spark, "alpha alpha alpha", "beta beta beta")
    assert both.score == pytest.approx(0.95) and both.decision == "escalate" and both.notes.startswith("multi-step")
    assert classified(spark, "alpha alpha alpha beta beta beta").decision == "review"
    assert classified(spark, "alpha", "x", age=10, friends=250).boost == pytest.approx(0.20)


def test_match_details(spark):
    messages = spark.createDataFrame([(1, 0, "an alpha and Alpha"), (1, 1, "alpha quiet")], "profile_id long, message_index long, text string")
    assert [(r.category, r.matched_text, r.position) for r in classifier.match_details(messages, PACK).collect()] == [("c0", "alpha", 3), ("c0", "Alpha", 13)]


def scored(spark, **signals):
    kinds = ", ".join(f"{k} {risk.INPUTS[k]}" for k in signals)
    return risk.score(spark.createDataFrame([tuple(signals.values())], kinds)).first()


def test_risk(spark):
    r = scored(spark, platform_count=2, is_vpn=True, account_age_days=20, friend_count=90)
    assert (r.risk_score, r.tier) == (2.4, 2)
    assert scored(spark, platform_count=1).risk_score == 0.0 and scored(spark, platform_count=1).confidence == "low"
    worst = scored(spark, classifier_score=1.0, decision="escalate", message_count=30, flagged_count=9, platform_count=4, is_tor=True, is_vpn=True, account_age_days=5, friend_count=300, late_night_activity=True, game_history_flags=3, prior_case_flags=3)
    assert (worst.risk_score, worst.tier, worst.confidence) == (10.0, 3, "high") and len(worst.signals) == 5
    assert scored(spark, platform_count=4, graph_lead_platforms=1).components[1].raw == 0.0


def test_contradictions_cap_confidence_only(spark):
    a, b = (scored(spark, platform_count=3, graph_lead_platforms=3, graph_has_contradictions=x) for x in (False, True))
    assert a.risk_score == b.risk_score and (a.components[1].confidence, b.components[1].confidence) == ("high", "medium")


def test_text_measures(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.entropy(F.lit("aabb"))) == 1.0 and one(X.entropy(F.lit(""))) == 0.0
    assert one(X.indel_ratio(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(2 * 4 / 13) and one(X.indel_ratio(F.lit(""), F.lit(""))) == 1.0
    assert one(X.hamming(F.lit("0" * 16), F.lit("0" * 14 + "ff"))) == 8 and one(X.hamming(F.lit("f" * 16), F.lit("0" * 16))) == 64 and one(X.hamming(F.lit("0" * 16), F.lit("zz"))) is None
    assert one(X.handle_rarity(F.lit("progamer"))) < one(X.handle_rarity(F.lit("zxqvwkjh"))) <= 1
    assert one(X.degree_weight(F.lit(1))) == 1.0 and one(X.degree_weight(F.lit(3))) == 0.5
    assert tuple(one(X.confidence_interval(F.lit(0.5), F.lit(0)))) == (0.0, 1.0) and tuple(one(X.confidence_interval(F.lit(0.5), F.lit(100)))) == (0.4, 0.6)


def people(spark):
    hi, lo = "00000000000000ff", "0000000000000000"
    texts = ["I was there, really!", "You and me... it is.", "So what? No.", "The end.", "Fine, the best!", "It is on."]
    rows = [
        (1, "a", "zxqvwkjh", texts, [0, 1, 2], ["n1", "n2"], {"n1": 12, "n2": 9}, lo, lo),
        (2, "b", "zxqvwkjh", texts, [0, 1, 2], ["n1", "n2"], {"n1": 12, "n2": 9}, hi, lo),
        (3, "a", "gamerpro", ["x"], [19], ["n3"], {"n3": 48000}, "ffffffffffffffff", None),
        (4, "b", None, [], [], [], {}, None, None),
        (5, "c", "theking", ["x"], list(range(24)), ["n3"], {"n3": 48000}, None, None),
        (6, "c", "bossking", ["y"], list(range(24)), ["n3"], {"n3": 48000}, None, None),
    ]
    return correlation.profiles(spark.createDataFrame(rows, "profile_id long, platform string, username string, messages array<string>, active_hours array<int>, connections array<string>, connection_degrees map<string,long>, avatar_phash string, avatar_dhash string"))


def test_correlation(spark):
    p = people(spark)
    every = p.alias("l").join(p.alias("r"), F.col("l.profile_id") < F.col("r.profile_id")).select(F.col("l.profile_id").alias("a"), F.col("r.profile_id").alias("b"))
    got = {(r.a, r.b): r for r in correlation.score_pairs(p, every).collect()}
    assert got[1, 2].is_lead and got[1, 2].contradiction_note is None and not got[1, 3].is_lead
    assert [(s.raw, s.confidence) for s in got[1, 4].signals] == [(0.0, 0.0)] * 5
    assert got[5, 6].has_contradiction and got[5, 6].strength < sum(s.raw * s.confidence * w for s, w in zip(got[5, 6].signals, correlation.WEIGHTS.values(), strict=True))
    timing = {s.name: s for s in got[1, 3].signals}["timing"]
    assert (timing.raw, timing.confidence) == (0.0, 1.0)
    few = {(r.a, r.b) for r in correlation.lead_candidates(p).collect()}
    assert {k for k, r in got.items() if r.is_lead} <= few and (1, 2) in few
    groups = {r.profile_id: r.component_id for r in correlation.clusters(p, correlation.score_pairs(p, correlation.lead_candidates(p))).collect()}
    assert groups[1] == groups[2] == 1 and groups[4] == 4 and len(groups) == 6


def test_blocking_finds_all_leads(spark):
    """Candidates against all pairs on random profiles."""
    import random

    rng = random.Random(4)
    rows = [(k, f"h{rng.choice('abc')}{rng.choice('xyz')}q{k % 9}", [rng.randint(0, 23) for _ in range(4)], [f"n{rng.randint(0, 12)}" for _ in range(3)], f"{rng.getrandbits(4):016x}", f"{rng.getrandbits(6):016x}") for k in range(60)]
    p = correlation.profiles(spark.createDataFrame(rows, "profile_id long, username string, active_hours array<int>, connections array<string>, avatar_phash string, avatar_dhash string"))
    every = p.alias("l").join(p.alias("r"), F.col("l.profile_id") < F.col("r.profile_id")).select(F.col("l.profile_id").alias("a"), F.col("r.profile_id").alias("b"))
    leads = lambda pairs: {(r.a, r.b) for r in correlation.score_pairs(p, pairs).where("is_lead").select("a", "b").collect()}
    assert leads(every) == leads(correlation.lead_candidates(p)) != set()


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (9, 9)], [(k, k + 1) for k in range(200)], [(1000, k) for k in range(50)], [(None, 1), (2, 1), (2, 1)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()}
    lowest = {x: x for e in edges for x in e if None not in e}
    for _ in lowest:
        for a, b in edges:
            if a is not None and b is not None:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    assert got == {k: v for k, v in lowest.items() if k != v}


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "a string, b string, strength double, is_lead boolean, has_contradiction boolean")


def test_entities_and_graph(spark):
    p = pairs(spark, ("a:x", "b:y", 0.82, True, False), ("b:y", "c:z", 0.9, True, True), ("d:w", "e:v", 0.7, True, True))
    groups = spark.createDataFrame([("a:x", 1), ("b:y", 1), ("c:z", 1), ("d:w", 2), ("e:v", 2), ("f:u", 3)], "profile_id string, component_id long")
    rows = {r.profile_id: r for r in graph.propose(groups, p).collect()}
    assert [rows[k].kept for k in ("a:x", "b:y", "c:z", "d:w")] == [True, True, False, False] and "contradicted" in rows["c:z"].reason and "f:u" not in rows
    found = graph.candidates(graph.propose(groups, p)).collect()
    assert [(r.component_id, r.members, r.excluded, r.mean_strength) for r in found] == [(1, 2, 1, 0.82)]
    with pytest.raises(ValueError):
        graph.promote(graph.candidates(graph.propose(groups, p)), "  ")
    assert graph.promote(graph.candidates(graph.propose(groups, p)), " Ana ").first().promoted_by == "Ana"
    edges = graph.build_edges(p)
    assert {(r.node, r.hops, r.via) for r in graph.shortest_paths(edges, "a:x").collect()} == {("a:x", 0, None), ("b:y", 1, "a:x"), ("c:z", 2, "b:y")}
    assert graph.shortest_paths(edges, "nobody").collect() == []
    part = spark.range(1).select(graph.profile_parts(F.lit("x:y:z")).alias("p"), graph.profile_parts(F.lit("solo")).alias("q"), graph.profile_parts(F.lit(":h")).alias("r")).first()
    assert (tuple(part.p), tuple(part.q), tuple(part.r)) == (("x", "y:z"), ("unknown", "solo"), ("unknown", "h"))


def test_engine_output_feeds_the_resolver(spark):
    p = people(spark)
    scored_pairs = correlation.score_pairs(p, correlation.lead_candidates(p))
    proposed = graph.propose(correlation.clusters(p, scored_pairs), scored_pairs)
    assert [(r.members, r.first_member) for r in graph.candidates(proposed).collect()] == [(2, 1)]


def log(spark):
    return custody.build_chain(spark.createDataFrame([(k, f"2024-01-0{k}", "add", 7, None if k == 2 else f"n{k}") for k in range(1, 6)], "log_id long, timestamp string, action string, case_id long, notes string"))


def test_custody(spark):
    chain = log(spark)
    assert chain.orderBy("log_id").first().previous_hash == custody.GENESIS
    verdict = lambda rows: custody.verify_chain(rows).first()
    assert verdict(chain).intact and verdict(chain).entries_checked == 5
    edited = verdict(chain.withColumn("notes", F.when(F.col("log_id") == 3, "other").otherwise(F.col("notes"))))
    assert (edited.broken_log_id, edited.entries_checked, edited.reason) == (3, 2, "content does not match its hash")
    deleted = verdict(chain.where("log_id <> 3"))
    assert (deleted.broken_log_id, deleted.reason) == (4, "broken link")
    assert verdict(chain.withColumn("notes", F.coalesce("notes", F.lit("filled")))).broken_log_id == 2
    older = spark.createDataFrame([(0, "2023", "x", 7, "y", None, None)], "log_id long, timestamp string, action string, case_id long, notes string, previous_hash string, entry_hash string")
    assert verdict(chain.unionByName(older)).intact


def test_uuid5(spark):
    assert spark.range(1).select(custody.uuid5(F.lit("https://x/ü"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://x/ü"))


def test_package(spark):
    rows = lambda *x: spark.createDataFrame(x, "artifact_id long, sha256 string")
    got = custody.verify_package(rows((1, "a"), (2, "b"), (3, "c")), rows((1, "a"), (2, "x"), (4, "d"))).collect()
    assert {r.artifact_id: r.status for r in got} == {1: "ok", 2: "altered", 3: "missing", 4: "unlisted"}


def test_redaction(spark):
    text = "mail a.b@c.org, id 123-45-6789, at 10.0.0.1 or 2001:db8::1, call +1 555-123-4567; 01:00:00 stays, so does Bob.E"
    out = redaction.mask_patterns(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert [out[f"n_{k}"] for k in redaction.KINDS] == [1, 1, 1, 1, 1] and "01:00:00" in out.t and "@" not in out.t
    nested = spark.createDataFrame([({"k": ["a@b.org", None]}, 5, ("BOB.e", None))], "m map<string,array<string>>, n int, s struct<x:string,y:string>")
    row = redaction.redact_frame(nested, ("bob.E",), "minor_involved").first()
    assert row.m == {"k": ["[REDACTED - EMAIL]", None]} and row.n == 5 and row.s.x == "[REDACTED - MINOR]" and row.s.y is None
    with pytest.raises(ValueError):
        redaction.masked(F.lit("x"), ("v",), "unknown")
    tags = spark.createDataFrame([(1, 1, "protected: A b \r\nx"), (1, 2, "Protected: c\nprotected: A b"), (2, 1, "none")], "case_id long, position long, text string")
    assert [(r.case_id, r["values"]) for r in redaction.protected_tags(tags).collect()] == [(1, ["A b", "c"])]
    hidden = spark.createDataFrame([("Say a+B twice: A+b", ["a+b", ""])], "t string, v array<string>").select(redaction.mask_protected(F.col("t"), F.col("v"))).first()[0]
    assert hidden == "Say [REDACTED - PROTECTED] twice: [REDACTED - PROTECTED]"


def test_redaction_is_idempotent(spark):
    once = spark.createDataFrame([("a@b.org 10.1.1.1 123-45-6789",)], "t string").select(redaction.masked(F.col("t")).alias("t"))
    assert once.select(redaction.masked(F.col("t")).alias("t")).collect() == once.collect()


def case_tables(spark):
    cases = spark.createDataFrame([(1, "2020-01-01T00:00:00+00:00", "a@b.org"), (2, "2024-01-01 00:00:00", "x"), (3, "soon", "y")], "case_id long, created_at string, case_name string")
    targets = spark.createDataFrame([(10, 1, "p", "u", "2020-01-02 00:00:00"), (20, 2, "p", "v", "bad date")], "target_id long, case_id long, platform string, username string, added_at string")
    artifacts = spark.createDataFrame([(100, 10, "h"), (200, 20, "h")], "artifact_id long, target_id long, sha256 string")
    analyses = spark.createDataFrame([(1, 10, 8.5, "2020-02-01"), (2, 10, None, "2020-03-01")], "result_id long, target_id long, risk_score double, analyzed_at string")
    return cases, targets, artifacts, analyses


def test_retention(spark):
    cases, targets, artifacts, analyses = case_tables(spark)
    due = retention.due(cases, "2024-01-02 00:00:00", 365)
    assert [(r.case_id, r.age_days) for r in due.collect()] == [(1, 1462)]
    plan = retention.dry_run(due, targets, artifacts, analyses).first()
    assert (plan.targets, plan.artifacts, plan.analyses) == (1, 1, 2)
    left = {k: v.count() for k, v in retention.purged(due, cases, targets, artifacts, analyses).items()}
    assert left == {"artifacts": 1, "analyses": 0, "targets": 1, "cases": 2}
    assert retention.due(cases, "2024-01-02 00:00:00", 365, exempt=F.col("case_id") == 1).count() == 0


def test_timeline(spark):
    cases, targets, _, _ = case_tables(spark)
    custody_rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", None, None, 20, "n"), (2, "x", "seen", 1, None, None)], "log_id long, timestamp string, action string, case_id long, target_id long, notes string")
    rows = timeline.ordered(timeline.build(cases.withColumn("analyst_name", F.lit("Ana")), targets, custody=custody_rows)).collect()
    assert [(r.case_id, r.kind) for r in rows] == [(1, "case_opened"), (1, "target_added"), (1, "custody_seen"), (2, "case_opened"), (2, "custody_entry"), (2, "target_added"), (3, "case_opened")]
    assert rows[5].timestamp == "bad date" and rows[0].timestamp == "2020-01-01T00:00:00+00:00"


def test_referral(spark):
    cases, targets, artifacts, analyses = case_tables(spark)
    row = referral.referral(cases, targets, analyses, artifacts).where("case_id = 1").first()
    assert row.case_name == "[REDACTED - EMAIL]" and row.max_score is None and row.subjects[0].username == "u"


def test_addresses(spark):
    rows = [("8.8.8.8", True, None, None, None, None), ("8.8.4.4", False, "VPN", None, 1, "known-vpn"), ("8.8.4.5", False, "DCH", None, None, None), ("8.8.4.6", False, None, "ISP", 2, "hosting-datacenter"), ("nope", True, None, None, None, None), ("192.168.1.1", True, None, None, None, None), ("1.1.1.1", False, None, None, None, None)]
    got = enrichment.assess(spark.createDataFrame(rows, "ip string, on_tor_list boolean, proxy_type string, usage_type string, asn long, asn_category string")).collect()
    assert [(r.confidence, r.network_type, r.is_anonymized) for r in got] == [(60, "tor-exit", True), (80, "known-vpn", True), (35, "hosting-datacenter", False), (45, "hosting-datacenter", False), (0, "unknown", False), (0, "unknown", False), (0, "unknown", False)]
    assert [r.status for r in got[4:6]] == ["invalid-address", "non-global-address"]


def test_hash_matching(spark):
    stored = spark.createDataFrame([("00000000000003ff", "far", 1), ("0000000000000001", "near", 2)], "hash string, label string, position long")
    got = {r.query_hash: r for r in matching.match_first(spark.createDataFrame([("0" * 16,), ("f" * 16,), ("bad",)], "query_hash string"), stored).collect()}
    assert (got["0" * 16].label, got["0" * 16].distance, got["0" * 16].requires_human_review) == ("far", 10, True)
    assert got["f" * 16].label is None and not got["bad"].requires_human_review


def test_profiles(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(profiles.looks_like_html(F.lit("  \n<!DOCTYPE html>"))) and not one(profiles.looks_like_html(F.lit("x" * 600 + "<html")))
    assert one(profiles.invite_codes(F.lit("see discord.gg/abC1 and https://discord.com/invite/xyz-9, discord.gg/abC1"))) == ["abC1", "xyz-9"]
    assert one(profiles.site_hits(F.lit("[*] x\n[+] GitHub: https://x\n[+] none\n[+] Reddit: http://y"))) == ["GitHub", "Reddit"]
    assert one(profiles.valid_keys(F.array(*map(F.lit, profiles.KEYS)))) and not one(profiles.valid_keys(F.array(F.lit("raw"))))


def test_evaluation(spark):
    rows = spark.createDataFrame([(s, t) for s, t in ((0.5, 0), (1.5, 0), (2.5, 1), (4.9, 1), (1.0, 1))], "score double, truth int")
    swept = {r.threshold: r for r in evaluation.sweep(rows, "score", F.col("truth") == 1).collect()}
    assert len(swept) == 35 and all(r.tp + r.fp + r.tn + r.fn == 5 for r in swept.values())
    assert (swept[1.0].tp, swept[1.0].fp) == (3, 1) and (swept[2.0].tp, swept[2.0].fp) == (2, 0)
    one = lambda n: [tuple(r) for r in evaluation.synthetic_profiles(spark, n, n, n).collect()]
    assert one(3) == one(3) and len(one(3)) == 9


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"asns": [{"asn": 5, "organization": "o", "category": "known-vpn", "source": "s"}]}')
    (tmp_path / "b.json").write_text('[{"asn": "x"}]')
    assert [r.asn for r in readers.authority(spark, str(tmp_path / "a.json")).collect()] == ["5"] and [r.asn for r in readers.authority(spark, str(tmp_path / "b.json")).collect()] == ["x"]
    assert [r.file_name for r in readers.file_records(spark, str(tmp_path), "a").collect()] == ["a.json"]
    raw = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("broken",), (None,)], "raw_data string")
    assert [r.payload.a for r in readers.payloads(raw, "a int").collect()] == [1]
    readers.export_json(raw, str(tmp_path / "out"))
    readers.append(raw, str(tmp_path / "table"))
    readers.append(raw, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 8


def test_streaming(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streaming.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    want = {(r.start, r.event_type): r.n for r in streaming.windowed_counts(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("counted").collect()} == want
