"""Reporting queries and their DuckDB statements."""

from __future__ import annotations

from ..operators import reporting as R
from ..sources import domain as D
from ..sources.domain import with_views

_TIER = "CASE WHEN {0} >= 7 THEN 'tier3' WHEN {0} >= 2 THEN 'tier2' WHEN {0} IS NOT NULL THEN 'tier1' ELSE 'unscored' END"
_BASE = with_views("cases", "targets", "analyses", "artifacts") + """,
 scored AS (SELECT t.case_id, t.platform, a.* FROM targets t JOIN analyses a USING (target_id)),
 latest AS (SELECT case_id, result_id, target_id, risk_score AS latest_risk, analyzed_at FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY analyzed_at DESC, result_id DESC, risk_score DESC NULLS LAST) rn FROM scored) WHERE rn = 1),
 peak AS (SELECT case_id, max(risk_score) AS peak_risk, count(risk_score) AS analysis_count, max(analyzed_at) AS last_analyzed FROM scored GROUP BY case_id),
 by_platform AS (SELECT case_id, platform, count(*) AS n FROM targets GROUP BY ALL),
 primary_p AS (SELECT case_id, platform AS primary_platform FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, platform) rn FROM by_platform) WHERE rn = 1)
"""

QUERIES = {
    "case_registry": lambda s, d: R.case_registry(D.cases(s, d), D.targets(s, d), D.analyses(s, d)),
    "case_summary": lambda s, d: R.case_summary(D.targets(s, d), D.artifacts(s, d), D.analyses(s, d)),
    "case_risk": lambda s, d: R.peak_risk(D.targets(s, d), D.analyses(s, d)),
    "latest_signal": lambda s, d: R.latest_signal(D.targets(s, d), D.analyses(s, d)),
    "tier_histogram": lambda s, d: R.tier_histogram(D.cases(s, d), D.targets(s, d), D.analyses(s, d)),
    "platform_histogram": lambda s, d: R.platform_histogram(D.cases(s, d), D.targets(s, d)),
    "module_counts": lambda s, d: R.module_counts(D.artifacts(s, d)),
    "risk_timeline": lambda s, d: R.risk_timeline(D.targets(s, d), D.analyses(s, d)),
    "case_text": lambda s, d: R.case_text(D.targets(s, d), D.artifacts(s, d)),
    "latest_payload": lambda s, d: R.latest_payload(D.targets(s, d), D.artifacts(s, d), "O"),
    "case_id_repair": lambda s, d: R.repaired_ids(D.cases(s, d)),
    "named_case_findings": lambda s, d: R.matching_cases(D.cases(s, d), D.targets(s, d), D.analyses(s, d), "%00000001%"),
}

ORACLE_SQL = {
    "case_registry": _BASE + "SELECT c.case_id, case_name, status, analyst_name, coalesce(target_count, 0) AS target_count, primary_platform, latest_risk, analyzed_at, peak_risk, coalesce(analysis_count, 0) AS analysis_count FROM cases c LEFT JOIN (SELECT case_id, count(*) AS target_count FROM targets GROUP BY 1) USING (case_id) LEFT JOIN primary_p USING (case_id) LEFT JOIN (SELECT case_id, latest_risk, analyzed_at FROM latest) USING (case_id) LEFT JOIN (SELECT case_id, peak_risk, analysis_count FROM peak) USING (case_id)",
    "case_summary": _BASE + "SELECT p.case_id, targets, platforms, coalesce(artifacts, 0) AS artifacts, coalesce(analyses, 0) AS analyses FROM (SELECT case_id, sum(n)::BIGINT AS targets, string_agg(platform || '=' || n, ';' ORDER BY platform) AS platforms FROM by_platform GROUP BY 1) p LEFT JOIN (SELECT case_id, count(*) AS artifacts FROM targets JOIN artifacts USING (target_id) GROUP BY 1) USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS analyses FROM scored GROUP BY 1) USING (case_id)",
    "case_risk": _BASE + "SELECT * FROM peak",
    "latest_signal": _BASE + "SELECT * FROM latest",
    "tier_histogram": _BASE + f"SELECT bucket, count(case_id) AS n FROM (VALUES ('tier1'), ('tier2'), ('tier3'), ('unscored')) b(bucket) LEFT JOIN (SELECT c.case_id, {_TIER.format('latest_risk')} AS bucket FROM cases c LEFT JOIN latest USING (case_id)) USING (bucket) GROUP BY 1",
    "platform_histogram": _BASE + "SELECT coalesce(primary_platform, 'unknown') AS platform, count(*) AS n FROM cases LEFT JOIN primary_p USING (case_id) GROUP BY 1",
    "module_counts": _BASE + "SELECT module_name, artifact_type, count(*) AS n FROM artifacts GROUP BY 1, 2 UNION ALL SELECT 'total', '', count(*) FROM artifacts",
    "risk_timeline": _BASE + "SELECT case_id, result_id, platform, analyzed_at, risk_score, row_number() OVER w AS position, risk_score - lag(risk_score) OVER w AS change FROM scored WHERE risk_score IS NOT NULL WINDOW w AS (PARTITION BY case_id ORDER BY analyzed_at, result_id, risk_score, platform)",
    "case_text": _BASE + "SELECT case_id, coalesce(string_agg(module_name || ':' || artifact_type, ' ' ORDER BY artifact_id, module_name || ':' || artifact_type), 'no artifacts collected') AS text FROM targets LEFT JOIN artifacts USING (target_id) GROUP BY 1",
    "latest_payload": _BASE + "SELECT case_id, arg_max(sha256, artifact_id) AS sha256, max(artifact_id) AS artifact_id FROM targets JOIN artifacts USING (target_id) WHERE artifact_type = 'O' GROUP BY 1",
    "case_id_repair": _BASE + "SELECT case_id, CASE WHEN starts_with(case_id::VARCHAR, 'CASE-') THEN case_id::VARCHAR ELSE 'CASE-' || case_id END AS repaired_id FROM cases",
    "named_case_findings": _BASE + "SELECT case_name, platform, result_id, risk_score FROM cases JOIN targets USING (case_id) JOIN analyses USING (target_id) WHERE case_name LIKE '%00000001%'",
}
