"""The case-store relations as views over the tables of a data folder, and the same views in SQL.

A deployment reads its own case store; these bindings give every operator rows of the right shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import table

_TIME = "yyyy-MM-dd HH:mm:ss"


def cases(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("c_mktsegment") == "BUILDING", "closed").when(F.col("c_mktsegment") == "MACHINERY", "archived").otherwise("open")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("case_name"), status.alias("status"), F.concat(F.lit("analyst-"), F.col("c_nationkey").cast("string")).alias("analyst_name"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("target_id"), F.col("o_custkey").alias("case_id"), F.lower("o_orderpriority").alias("platform"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("username"), F.date_format("o_orderdate", _TIME).alias("added_at"),
    )


def analyses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"), F.col("l_orderkey").alias("target_id"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity") / 5).alias("risk_score"), F.date_format("l_shipdate", _TIME).alias("analyzed_at"),
    )


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("artifact_id"), F.col("l_orderkey").alias("target_id"), F.col("l_returnflag").alias("module_name"), F.col("l_linestatus").alias("artifact_type"),
        F.sha2(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), 256).alias("sha256"), F.date_format("l_shipdate", _TIME).alias("collected_at"),
    )


def collected(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts with JSON payloads of two modules; some are broken, some of another shape or type."""
    k, p = F.col("l_linenumber"), F.col("l_partkey")
    quoted = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    profile = quoted(
        '{"created": "', F.date_format("l_shipdate", "yyyy-MM-dd"), 'T08:00:00Z", "friend_count": ', (F.col("l_quantity") * 6).cast("int"), ', "description": "', F.when(p % 5 != 0, quoted(" hello ", p)).otherwise(" "), '", "groups": [{"name": "',
        F.when(p % 7 == 0, "Vibe Club").otherwise("Builders"), '"}], "games": [{"name": "', F.when(F.col("l_suppkey") % 9 == 0, "Condo 3").otherwise("Obby"), '"}], "avatar_phash": "', F.substring(F.md5(p.cast("string")), 1, 16), '"}',
    )
    raw = F.when(p % 11 == 0, '{"created": ').when(k % 3 == 1, profile).when((k % 3 == 2) & (p % 13 == 0), '{"platforms_found": "9"}').when(k % 3 == 2, quoted('{"platforms_found": ', p % 6, "}")).otherwise("[1, 2]")
    module = F.when(k % 3 == 1, "RobloxOSINT").when(k % 3 == 2, "SherlockIntegration").otherwise("other")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + k).alias("artifact_id"), F.col("l_orderkey").alias("target_id"), module.alias("module_name"), raw.alias("raw_data"))


def custody(spark: SparkSession, d: str) -> DataFrame:
    """Log entries; every third names an artifact with its hash, every fourth a target."""
    k = F.col("event_id")
    named = k % 3 == 0
    return table(spark, d, "events").select(
        k.alias("log_id"), F.date_format("ts", _TIME).alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").alias("case_id"), F.col("props").alias("notes"),
        F.when(named, k * 10 + 1).alias("artifact_id"), F.when(k % 4 == 1, k).alias("target_id"), F.concat(F.lit("analyst-"), (F.col("user_id") % 25).cast("string")).alias("analyst"),
        F.when(named, F.sha2(F.concat(F.lit("artifact "), k.cast("string")), 256)).alias("sha256"),
    )


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Analyst notes; some are on a finding, some on a target."""
    k = F.col("doc_id")
    return table(spark, d, "labels").select(
        k.alias("note_id"), (k % 150).alias("case_id"), F.when(k % 3 == 0, k).alias("target_id"), F.when(F.col("toxic") == 1, F.concat(F.lit("finding-"), k.cast("string"))).alias("finding_ref"),
        F.concat(F.lit("analyst-"), (k % 25).cast("string")).alias("analyst"), F.when(k % 10 == 7, "  ").otherwise(F.concat(F.lit(" quality "), F.col("quality").cast("string"), F.lit(" "))).alias("note"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), _TIME).alias("created_at"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities resolved by analysts."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("entity-"), k.cast("string")).alias("entity_id"), k.alias("case_id"), F.col("s_name").alias("canonical_handle"), F.concat(F.lit("analyst-"), F.col("s_nationkey").cast("string")).alias("promoted_by"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), _TIME).alias("promoted_at"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("profile_id"), F.col("turn").alias("message_index"), "text")


#: Sentences that the rules look for, one in every third message of probed profiles.
PROBES = ("how old are you", "dm me on", "reward you", "for your age")


def probed(spark: SparkSession, d: str) -> DataFrame:
    """Messages, a sentence that some rule looks for added to every third."""
    said = F.get(F.array(*map(F.lit, PROBES)), (F.col("conv_id") % 4 + F.col("turn") % 2).cast("int"))
    text = F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", "text", F.coalesce(said, F.lit("")))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("profile_id"), F.col("turn").alias("message_index"), text.alias("text"))


def hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("profile_id"), F.hour("ts").alias("hour")).distinct()


def connections(spark: SparkSession, d: str) -> DataFrame:
    """Profiles (customers) and the nodes (parts of their order lines) they are connected with."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("profile_id"), F.col("l_partkey").alias("node")).distinct()


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """Profiles (customers) and what hardly anyone else has: a part of one supplier in a band of quantities.
    Rows may repeat, for ``overlap`` counts them once."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.floor(F.col("l_quantity") / 3).cast("string")).alias("node"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("profile_id"), "node")


def handles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("handle")).agg(F.min("p_partkey").alias("profile_id"))


def avatars(spark: SparkSession, d: str) -> DataFrame:
    """64-bit hashes from embeddings. Bit i of phash is e[i] > 0 for the first vector of every three, its
    last digit that of the own id, so the three are near; bit i of dhash is e[i] > e[i + 1]."""
    def packed(bit) -> F.Column:
        nibble = lambda k: F.element_at(F.split(F.lit("0123456789abcdef"), ""), (8 * bit(4 * k) + 4 * bit(4 * k + 1) + 2 * bit(4 * k + 2) + bit(4 * k + 3) + 1))
        return F.concat(*(nibble(k) for k in range(16)))

    e, k = F.col("embedding"), F.col("vec_id")
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 64)
    first = rows.where("vec_id % 3 = 0").select(k.alias("__first"), F.substring(packed(lambda i: (e[i] > 0).cast("int")), 1, 15).alias("__p"))
    own = rows.select(k.alias("profile_id"), (k - k % 3).alias("__first"), packed(lambda i: (e[i] > e[(i + 1) % 64]).cast("int")).alias("dhash"))
    digit = F.lower(F.hex(F.col("profile_id") % 16))
    return own.join(first, "__first").select("profile_id", F.concat("__p", digit).alias("phash"), "dhash")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Risk inputs of each case, spread over their ranges by the case number."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("case_id"), F.when(k % 6 != 0, (k % 10) / 10.0).alias("classifier_score"), F.when(k % 10 >= 6, "escalate").otherwise("allow").alias("decision"), (k % 25).alias("message_count"),
        (k % 4).alias("flagged_count"), (k % 5 + 1).cast("int").alias("platform_count"), (k % 7 == 0).alias("is_tor"), (k % 5 == 0).alias("is_vpn"), F.when(k % 11 != 0, k % 120).cast("int").alias("account_age_days"),
        F.when(k % 13 != 0, k * 3 % 400).cast("int").alias("friend_count"), (k % 4 == 0).alias("late_night_activity"), (k % 3).cast("int").alias("game_history_flags"), (k % 5 - 1).cast("int").alias("prior_case_flags"),
        F.when(k % 3 == 0, k % 4).cast("int").alias("graph_lead_platforms"), (k % 3 == 1).alias("graph_has_contradictions"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Correlation profiles of customers: the first part name of their number, if any, as handle; connections, hours, avatars, messages."""
    linked = connections(spark, d)
    degree = linked.groupBy("node").agg(F.count("*").alias("degree"))
    own = linked.join(degree, "node").groupBy("profile_id").agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("connections"), F.map_from_entries(F.collect_list(F.struct(F.col("node").cast("string"), "degree"))).alias("connection_degrees"))
    awake = hours(spark, d).groupBy("profile_id").agg(F.array_sort(F.collect_list("hour")).alias("active_hours"))
    said = messages(spark, d).groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "text"))), lambda m: m["text"]).alias("messages"))
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("platform"))
    named = handles(spark, d).select(F.col("profile_id"), F.col("handle").alias("username"))
    pictures = avatars(spark, d).withColumnsRenamed({"phash": "avatar_phash", "dhash": "avatar_dhash"})
    out = base
    for part in (named, own, awake, said, pictures):
        out = out.join(part, "profile_id", "left")
    return out


def _nibble(bit, k: int) -> str:
    return f"substr('0123456789abcdef', 8*{bit(4 * k)} + 4*{bit(4 * k + 1)} + 2*{bit(4 * k + 2)} + {bit(4 * k + 3)} + 1, 1)"


_P = " || ".join(_nibble(lambda i: f"(b.embedding[{i + 1}] > 0)::int", k) for k in range(15))
_D = " || ".join(_nibble(lambda i: f"(e.embedding[{i + 1}] > e.embedding[{(i + 1) % 64 + 1}])::int", k) for k in range(16))

#: The same views for DuckDB, as common table expressions.
SQL = {
    "cases": "SELECT c_custkey AS case_id, c_name AS case_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'closed' WHEN 'MACHINERY' THEN 'archived' ELSE 'open' END AS status, 'analyst-' || c_nationkey AS analyst_name FROM customer",
    "targets": "SELECT o_orderkey AS target_id, o_custkey AS case_id, lower(o_orderpriority) AS platform, 'user' || o_custkey AS username, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS added_at FROM orders",
    "analyses": "SELECT l_orderkey * 10 + l_linenumber AS result_id, l_orderkey AS target_id, CASE WHEN l_returnflag <> 'A' THEN l_quantity / 5 END AS risk_score, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS analyzed_at FROM lineitem",
    "artifacts": "SELECT l_orderkey * 10 + l_linenumber AS artifact_id, l_orderkey AS target_id, l_returnflag AS module_name, l_linestatus AS artifact_type, sha256(l_orderkey || '|' || l_linenumber) AS sha256, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS collected_at FROM lineitem",
    "collected": """SELECT l_orderkey * 10 + l_linenumber AS artifact_id, l_orderkey AS target_id, CASE l_linenumber % 3 WHEN 1 THEN 'RobloxOSINT' WHEN 2 THEN 'SherlockIntegration' ELSE 'other' END AS module_name, CASE WHEN l_partkey % 11 = 0 THEN '{"created": ' WHEN l_linenumber % 3 = 1 THEN '{"created": "' || strftime(l_shipdate, '%Y-%m-%d') || 'T08:00:00Z", "friend_count": ' || (l_quantity * 6)::INT || ', "description": "' || CASE WHEN l_partkey % 5 <> 0 THEN ' hello ' || l_partkey ELSE ' ' END || '", "groups": [{"name": "' || CASE WHEN l_partkey % 7 = 0 THEN 'Vibe Club' ELSE 'Builders' END || '"}], "games": [{"name": "' || CASE WHEN l_suppkey % 9 = 0 THEN 'Condo 3' ELSE 'Obby' END || '"}], "avatar_phash": "' || substr(md5(l_partkey::VARCHAR), 1, 16) || '"}' WHEN l_linenumber % 3 = 2 AND l_partkey % 13 = 0 THEN '{"platforms_found": "9"}' WHEN l_linenumber % 3 = 2 THEN '{"platforms_found": ' || l_partkey % 6 || '}' ELSE '[1, 2]' END AS raw_data FROM lineitem""",
    "custody": "SELECT event_id AS log_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS action, user_id AS case_id, props AS notes, CASE WHEN event_id % 3 = 0 THEN event_id * 10 + 1 END AS artifact_id, CASE WHEN event_id % 4 = 1 THEN event_id END AS target_id, 'analyst-' || user_id % 25 AS analyst, CASE WHEN event_id % 3 = 0 THEN sha256('artifact ' || event_id) END AS sha256 FROM events",
    "notes": "SELECT doc_id AS note_id, doc_id % 150 AS case_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS target_id, CASE WHEN toxic = 1 THEN 'finding-' || doc_id END AS finding_ref, 'analyst-' || doc_id % 25 AS analyst, CASE WHEN doc_id % 10 = 7 THEN '  ' ELSE ' quality ' || quality || ' ' END AS note, strftime(DATE '2024-01-01' + (doc_id % 300)::INT, '%Y-%m-%d %H:%M:%S') AS created_at FROM labels",
    "entities": "SELECT 'entity-' || s_suppkey AS entity_id, s_suppkey AS case_id, s_name AS canonical_handle, 'analyst-' || s_nationkey AS promoted_by, strftime(DATE '2024-01-01' + (s_suppkey % 300)::INT, '%Y-%m-%d %H:%M:%S') AS promoted_at FROM supplier",
    "messages": "SELECT conv_id AS profile_id, turn AS message_index, text FROM conversations",
    "probed": f"SELECT conv_id AS profile_id, turn AS message_index, CASE WHEN turn % 3 = 0 THEN concat_ws(' ', text, coalesce({list(PROBES)}[conv_id % 4 + turn % 2 + 1], '')) ELSE text END AS text FROM conversations",
    "hours": "SELECT DISTINCT user_id AS profile_id, hour(ts) AS hour FROM events",
    "connections": "SELECT DISTINCT o_custkey AS profile_id, l_partkey AS node FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "purchases": "SELECT DISTINCT o_custkey AS profile_id, concat_ws(':', l_partkey, l_suppkey, floor(l_quantity / 3)::BIGINT) AS node FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "handles": "SELECT min(p_partkey) AS profile_id, p_name AS handle FROM part GROUP BY p_name",
    "signals": "SELECT c_custkey AS case_id, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 10) / 10.0::DOUBLE END AS classifier_score, CASE WHEN c_custkey % 10 >= 6 THEN 'escalate' ELSE 'allow' END AS decision, c_custkey % 25 AS message_count, c_custkey % 4 AS flagged_count, c_custkey % 5 + 1 AS platform_count, c_custkey % 7 = 0 AS is_tor, c_custkey % 5 = 0 AS is_vpn, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 120 END AS account_age_days, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey * 3 % 400 END AS friend_count, c_custkey % 4 = 0 AS late_night_activity, c_custkey % 3 AS game_history_flags, c_custkey % 5 - 1 AS prior_case_flags, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END AS graph_lead_platforms, c_custkey % 3 = 1 AS graph_has_contradictions FROM customer",
    "avatars": f"SELECT e.vec_id AS profile_id, {_P} || substr('0123456789abcdef', e.vec_id % 16 + 1, 1) AS phash, {_D} AS dhash FROM embeddings e JOIN embeddings b ON b.vec_id = e.vec_id - e.vec_id % 3 WHERE len(e.embedding) = 64 AND len(b.embedding) = 64",
}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views for a DuckDB statement."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
