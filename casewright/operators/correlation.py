"""Record linkage of profiles from five signals, without comparing all pairs.

A lead needs a fused strength of 0.45; style and timing together reach 0.40 at most. Every lead therefore
shares a connection, has a near avatar hash, or has a similar and rare handle. The three candidate sets
come from equality joins on node, hash band and handle block, and only their union is scored. With other
weights the bound may fail; then ``candidates`` must be given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from . import blocks, overlap
from .components import connected_components
from .scratch import Scratch

# Weights of the signals, lead threshold, blend of style and meaning, limits.
WEIGHTS = {"username": 0.25, "stylometry": 0.25, "timing": 0.15, "network": 0.25, "avatar": 0.10}
LEAD, MIN_MESSAGES, STYLE_SHARE = 0.45, 5, 0.65
NEAR_BITS, DISTINCTIVE_DEGREE = 8, 20
ALL_DAY_OVERLAP, ALL_DAY_HOURS, PENALTY = 8, 10, 0.15
MIN_USERNAME = 0.20

#: Columns of a profile; only profile_id is required to be present and not null.
PROFILE = {
    "profile_id": "long", "platform": "string", "username": "string", "messages": "array<string>", "active_hours": "array<int>", "connections": "array<string>",
    "connection_degrees": "map<string,bigint>", "avatar_phash": "string", "avatar_dhash": "string", "embedding": "array<double>",
}


def profiles(df: DataFrame) -> DataFrame:
    """``df`` with all profile columns; hours and connections are sets."""
    have = set(df.columns)
    return df.select(*((F.array_distinct(F.col(c).cast(t)) if c in ("active_hours", "connections") and c in have else (F.col(c) if c in have else F.lit(None)).cast(t)).alias(c) for c, t in PROFILE.items()))


def network_candidates(p: DataFrame) -> DataFrame:
    """Pairs that share a connection and may be a lead by it.

    What the other signals can add at most leaves a network score that a profile's partners must reach: style
    by its messages, timing by its hours, the handle by its rarity (near avatars are candidates of their own).
    That score is a weight to be shared, so pairs meet under prefixes of their connections, the least
    popular first, and only where enough can follow; very popular connections are split (see ``overlap``).
    A profile with messages, hours and a rare handle may be a lead by any connection: that is the cost.
    """
    n = F.coalesce(F.greatest(F.size("messages"), F.lit(0)), F.lit(0))
    style = F.when(n >= MIN_MESSAGES, 1.0).otherwise(n / F.lit(float(MIN_MESSAGES)) * 0.5)
    timing = F.when(F.coalesce(F.size("active_hours") > 0, F.lit(False)), 1.0).otherwise(0.0)
    handle = F.when(F.coalesce(F.length("username") > 0, F.lit(False)), (X.handle_rarity(F.col("username")) + 1) / 2).otherwise(0.0)
    left = (F.lit(LEAD) - WEIGHTS["stylometry"] * style - WEIGHTS["timing"] * timing - WEIGHTS["username"] * handle) / WEIGHTS["network"]
    own = F.coalesce(F.try_element_at("connection_degrees", F.col("node")), F.lit(1))
    side = p.withColumn("least", F.greatest(F.lit(0.0), left)).where("least <= 1.000000001").select("profile_id", "least", F.size("connections").alias("size"), "connection_degrees", F.explode("connections").alias("node"))
    side = side.select("profile_id", "least", "size", "node", X.degree_weight(own).alias("weight"), own.alias("degree"))
    popular = side.groupBy("node").agg(F.max("degree").alias("rank"))
    need = F.col("least") * F.log2(F.col("size") + 1)
    entries = overlap.prefixes(side.join(popular, "node").select("profile_id", "node", "rank", "weight", "size", "least", need.alias("need")))
    most = F.least("l.rest", "r.rest")
    # of a network score, capped at 1, no more than the weight that may follow over the least union
    together = F.col("l.size") + F.col("r.size") - F.least("l.rest_n", "r.rest_n")
    return overlap.meetings(entries.select("profile_id", "node", "size", "least", "rest_n", "rest"), most >= F.greatest("l.least", "r.least") * F.log2(together + 1) * overlap.SLACK)


def avatar_candidates(p: DataFrame) -> DataFrame:
    """Pairs with a hash within ``NEAR_BITS``, by an index of pieces of the hashes."""
    every = None
    for kind in ("avatar_phash", "avatar_dhash"):
        hashes = p.select("profile_id", blocks.number(F.col(kind)).alias("hash")).where("hash is not null")
        distinct = hashes.select("hash").distinct()
        cut = blocks.pieces(distinct.count(), NEAR_BITS)
        l, r = blocks.asking(distinct, "hash", cut).alias("l"), blocks.entered(distinct, "hash", cut).alias("r")
        near = F.bit_count(F.col("l.hash").bitwiseXOR(F.col("r.hash"))) <= NEAR_BITS
        met = l.join(r, (F.col("l.which") == F.col("r.which")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.hash") <= F.col("r.hash")) & near).select(F.col("l.hash").alias("x"), F.col("r.hash").alias("y")).distinct()
        one, two = hashes.select(F.col("hash").alias("x"), F.col("profile_id").alias("p")), hashes.select(F.col("hash").alias("y"), F.col("profile_id").alias("q"))
        found = met.join(one, "x").join(two, "y").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        every = found if every is None else every.unionByName(found)
    return every.distinct()


def similar_handles(handles: DataFrame, least: Callable[[Column], Column]) -> DataFrame:
    """(a, b, ratio, mean) for handles (name, rarity) with a < b whose ratio reaches ``least`` of their mean
    rarity, which must not grow with it.

    A common subsequence takes common letters, each as often as it occurs. A pair that reaches the ratio
    shares a number of them that follows from the lengths; so it also shares one among the rarest letters
    of each, all but that number and one more. Handles meet by those letters only.
    """
    needed = F.greatest(F.lit(1e-9), F.least(F.lit(1.0), least((F.col("rarity") + 1) / 2)))
    cs = F.array_sort(X.chars(F.col("name")))
    lettered = handles.select("name", "rarity", F.length("name").alias("n"), needed.alias("needed"), F.transform(cs, lambda c, i: F.concat(c, (i - F.array_position(cs, c)).cast("string"))).alias("letters"))
    each = lettered.select("name", "rarity", "n", "needed", F.explode("letters").alias("letter"))
    common = each.groupBy("letter").agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("times", "letter"))
    # the shortest partner has needed / (2 - needed) of the length
    shared = F.ceil(F.col("needed") * F.col("n") / (2 - F.col("needed")) - 1e-9)
    kept = each.join(common, "letter").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - shared + 1).select("name", "rarity", "letter")
    l, r = kept.alias("l"), kept.alias("r")
    mean = (F.col("l.rarity") + F.col("r.rarity")) / 2
    possible = X.length_bound(F.col("l.name"), F.col("r.name")) >= least(mean)
    met = l.join(r, (F.col("l.letter") == F.col("r.letter")) & (F.col("l.name") < F.col("r.name")) & possible).select(F.col("l.name").alias("a"), F.col("r.name").alias("b"), mean.alias("mean")).distinct()
    return met.withColumn("ratio", X.indel_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least(F.col("mean"))).select("a", "b", "ratio", "mean")


def username_candidates(p: DataFrame) -> DataFrame:
    """Pairs of distinct handles whose similarity times mean rarity may make a lead.

    A handle adds a quarter of that at most. Without messages of both, no handle lifts timing to a lead;
    without hours of both, only a strength of 0.8 lifts style; else ``MIN_USERNAME`` does.
    """
    spoken = F.coalesce(F.size("messages") > 0, F.lit(False))
    awake = F.coalesce(F.size("active_hours") > 0, F.lit(False))
    names = p.where(F.length("username") > 0).where(spoken).select("profile_id", F.lower("username").alias("name"), awake.alias("awake"))
    distinct = names.select("name").distinct().withColumn("rarity", X.handle_rarity(F.col("name")))
    similar = similar_handles(distinct, lambda mean: F.lit(MIN_USERNAME) / F.greatest(mean, F.lit(1e-9))).select("a", "b", (F.col("ratio") * F.col("mean")).alias("strength"))
    both = similar.unionByName(distinct.select(F.col("name").alias("a"), F.col("name").alias("b"), F.col("rarity").alias("strength")))
    left = names.select(F.col("name").alias("a"), F.col("profile_id").alias("x"), F.col("awake").alias("ax"))
    right = names.select(F.col("name").alias("b"), F.col("profile_id").alias("y"), F.col("awake").alias("ay"))
    found = both.join(left, "a").join(right, "b").where("x <> y").where((F.col("ax") & F.col("ay")) | (F.col("strength") >= 0.799))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def lead_candidates(p: DataFrame) -> DataFrame:
    """A superset of all leads under the default weights."""
    return network_candidates(p).unionByName(avatar_candidates(p)).unionByName(username_candidates(p)).distinct()


def features(p: DataFrame) -> DataFrame:
    """What the signals need of each profile, computed once: no message travels with a pair."""
    number = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return p.select(
        "profile_id", F.lower("username").alias("name"), X.handle_rarity(F.col("username")).alias("rarity"), number("messages").alias("n_messages"), X.style_vector(F.col("messages")).alias("style"), "embedding",
        "active_hours", "connections", "connection_degrees", "avatar_phash", "avatar_dhash",
    )


def _signal(name: str, raw: Column, confidence: Column, rationale: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), raw.cast("double").alias("raw"), confidence.cast("double").alias("confidence"), rationale.alias("rationale"))


def signals(default_avatars: tuple[str, ...] = ()) -> dict[str, Column]:
    """The five signals of a row with structs ``x`` and ``y`` of ``features``; absent data has confidence 0,
    disjoint data score 0 at confidence 1."""
    x, y = (lambda c: F.col("x")[c]), (lambda c: F.col("y")[c])
    zero, one = F.lit(0.0), F.lit(1.0)
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    named = (F.coalesce(x("name"), F.lit("")) != "") & (F.coalesce(y("name"), F.lit("")) != "")
    username = F.when(named, X.indel_ratio(x("name"), y("name")) * (x("rarity") + y("rarity")) / 2).otherwise(zero)

    messages = F.least(x("n_messages"), y("n_messages"))
    spoken = messages > 0
    style = X.cosine(x("style"), y("style"))
    meaning = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (X.cosine(x("embedding"), y("embedding")) + 1) / 2))
    blended = F.when(x("embedding").isNotNull() & y("embedding").isNotNull(), STYLE_SHARE * style + (1 - STYLE_SHARE) * meaning).otherwise(style)
    trusted = F.when(messages >= MIN_MESSAGES, 1.0).otherwise(messages / F.lit(float(MIN_MESSAGES)) * 0.5)

    awake = ~empty(x("active_hours")) & ~empty(y("active_hours"))
    weight = lambda hs: F.aggregate(F.array_sort(hs), F.lit(0.0), lambda a, h: a + X.hour_weight(h))
    timing = weight(F.array_intersect(x("active_hours"), y("active_hours"))) / weight(F.array_union(x("active_hours"), y("active_hours")))

    linked = ~empty(x("connections")) & ~empty(y("connections"))
    shared = F.array_sort(F.array_intersect(x("connections"), y("connections")))
    degree = lambda n: F.greatest(F.coalesce(F.try_element_at(x("connection_degrees"), n), F.lit(1)), F.coalesce(F.try_element_at(y("connection_degrees"), n), F.lit(1)))
    evidence = F.aggregate(shared, F.lit(0.0), lambda a, n: a + X.degree_weight(degree(n)))
    network = F.least(F.lit(1.0), evidence / F.log2(F.size(F.array_union(x("connections"), y("connections"))) + F.lit(1)))

    known = F.lit(False) if not default_avatars else x("avatar_phash").isin(*default_avatars) | y("avatar_phash").isin(*default_avatars)
    seen = x("avatar_phash").isNotNull() & y("avatar_phash").isNotNull() & ~F.coalesce(known, F.lit(False))
    p = F.coalesce(X.hamming(x("avatar_phash"), y("avatar_phash")) <= NEAR_BITS, F.lit(False))
    both_d = x("avatar_dhash").isNotNull() & y("avatar_dhash").isNotNull()
    d = F.coalesce(X.hamming(x("avatar_dhash"), y("avatar_dhash")) <= NEAR_BITS, F.lit(False))
    avatar = F.when(~seen, 0.0).when(both_d & p & d, 1.0).when(both_d & (p | d), 0.5).when(~both_d & p, 0.7).otherwise(0.0)
    avatar_sure = F.when(~seen, 0.0).when(both_d & (p != d), 0.7).when(~both_d & p, 0.7).otherwise(1.0)

    percent = lambda c: F.format_string("%.2f", c)
    return {
        "username": _signal("username", username, F.when(named, one).otherwise(zero), F.concat(F.lit("handle similarity weighted by rarity: "), percent(username))),
        "stylometry": _signal("stylometry", F.when(spoken, blended).otherwise(zero), F.when(spoken, trusted).otherwise(zero), F.concat(F.lit("writing style similarity over at least "), messages.cast("string"), F.lit(" messages"))),
        "timing": _signal("timing", F.when(awake, timing).otherwise(zero), F.when(awake, one).otherwise(zero), F.lit("shared activity hours weighted by how unusual they are")),
        "network": _signal("network", F.when(linked, network).otherwise(zero), F.when(linked, one).otherwise(zero), F.concat(F.coalesce(F.size(F.filter(shared, lambda n: degree(n) <= DISTINCTIVE_DEGREE)), F.lit(0)).cast("string"), F.lit(" distinctive shared connection(s)"))),
        "avatar": _signal("avatar", avatar, avatar_sure, F.lit("perceptual hashes compared by differing bits")),
    }


def score_pairs(p: DataFrame, pairs: DataFrame, default_avatars: tuple[str, ...] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """Scores (a, b) pairs: signals, contradiction, fused strength, lead flag and rationale.

    ``contradiction_note`` is null for a clean pair. A contradiction lowers the strength by the penalty.
    """
    weights = weights or WEIGHTS
    scratch = Scratch(p.sparkSession, "features")
    pairs = scratch.keep(pairs.select("a", "b"), "pairs")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("profile_id")).distinct()
    known = scratch.keep(features(p.join(paired, "profile_id", "left_semi")), "features")
    row = F.struct(*known.columns)
    rows = pairs.join(known.select(F.col("profile_id").alias("a"), row.alias("x")), "a").join(known.select(F.col("profile_id").alias("b"), row.alias("y")), "b")
    found = signals(default_avatars)
    rows = rows.withColumn("signals", F.array(*(found[n] for n in weights)))
    hours = lambda c: F.coalesce(F.size(F.col(c)["active_hours"]), F.lit(0))
    overlap = F.coalesce(F.size(F.array_intersect(F.col("x")["active_hours"], F.col("y")["active_hours"])), F.lit(0))
    all_day = (overlap >= ALL_DAY_OVERLAP) & (hours("x") >= ALL_DAY_HOURS) & (hours("y") >= ALL_DAY_HOURS)
    rows = rows.withColumn("has_contradiction", all_day)
    total = F.lit(0.0)
    for k, n in enumerate(weights):
        total = total + F.col("signals")[k]["raw"] * F.col("signals")[k]["confidence"] * weights[n]
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - F.when(F.col("has_contradiction"), PENALTY).otherwise(0.0)))
    rows = rows.withColumn("strength", strength).withColumn("is_lead", F.col("strength") >= LEAD)
    ranked = F.array_sort(F.transform("signals", lambda s, k: F.struct((-(s["raw"] * s["confidence"])).alias("by"), k.alias("k"), F.concat_ws(": ", s["name"], s["rationale"]).alias("text"))))
    reasons = F.transform(F.slice(F.filter(ranked, lambda s: s["by"] < 0), 1, 5), lambda s: s["text"])
    note = F.when(F.col("has_contradiction"), "both accounts are active around the clock; the overlap of hours is not evidence")
    return rows.select("a", "b", "strength", "is_lead", "has_contradiction", note.alias("contradiction_note"), "signals", reasons.alias("rationale"))


def top_signal(scored: DataFrame) -> DataFrame:
    """The strongest signal of each pair; the first one wins a tie."""
    best = F.array_sort(F.transform("signals", lambda s, k: F.struct((-(s["raw"] * s["confidence"])).alias("by"), k.alias("k"), s["name"].alias("name"))))[0]
    return scored.select("a", "b", best["name"].alias("top_signal"))


def network_overlap(connections: DataFrame) -> DataFrame:
    """Network signal of every pair that shares a node, from (profile_id, node) rows: shared nodes,
    distinctive ones, and the score over the union of both neighbourhoods."""
    return overlap.sharing(connections)


#: Blocks of hour sets: at least so many sets in one, at most so many blocks.
HOUR_SETS, HOUR_BLOCKS = 128, 256


def hour_overlap(hours: DataFrame) -> DataFrame:
    """Timing signal of every two different sets of active hours that meet.

    Profiles (profile_id, hour) are reduced to their 24-bit sets, and each set lists how many profiles have it.
    Sets are dealt into blocks, each two blocks meet once, in a task that follows from the number of blocks;
    a pair costs some operations on bits.
    """
    masks = hours.groupBy("profile_id").agg(F.sum(F.expr("shiftleft(1L, hour)")).alias("mask"))
    scratch = Scratch(hours.sparkSession, "hours")
    sets = scratch.keep(masks.groupBy("mask").agg(F.count("*").alias("profiles")), "sets")
    blocks = max(1, min(HOUR_BLOCKS, -(-sets.count() // HOUR_SETS)))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("mask"), F.lit(blocks)).cast("int"))
    cells = min(blocks * (blocks + 1) // 2, 2000)
    left = dealt.select(F.col("block").alias("low"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("high"), F.col("mask").alias("m"), F.col("profiles").alias("p")).repartition(cells, "low", "high")
    right = dealt.select(F.col("block").alias("high"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("low"), F.col("mask").alias("n"), F.col("profiles").alias("q")).repartition(cells, "low", "high")
    met = left.join(right, ["low", "high"]).where("(low < high OR m < n) AND (m & n) <> 0")
    swap = F.col("m") > F.col("n")
    pairs = met.select(F.least("m", "n").alias("mask_a"), F.greatest("m", "n").alias("mask_b"), F.when(swap, F.col("q")).otherwise(F.col("p")).alias("profiles_a"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("profiles_b"))

    def weight(mask: Column) -> Column:
        total = F.lit(0.0)
        for h in range(24):
            total = total + F.when(mask.bitwiseAND(F.lit(1 << h)) != 0, X.hour_weight(F.lit(h))).otherwise(0.0)
        return total

    a, b = F.col("mask_a"), F.col("mask_b")
    return pairs.select("mask_a", "mask_b", "profiles_a", "profiles_b", (weight(a.bitwiseAND(b)) / weight(a.bitwiseOR(b))).alias("score"))


def clusters(p: DataFrame, scored: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(profile_id, component_id): groups joined by leads, singletons included."""
    scratch = scratch or Scratch(p.sparkSession, "clusters")
    labels = connected_components(scored.where("is_lead").select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    return p.select("profile_id").join(labels.select(F.col("node").alias("profile_id"), "component"), "profile_id", "left").select("profile_id", F.coalesce("component", "profile_id").alias("component_id"))


#: Queries of one label that one task takes, and the products of vectors it holds at a time.
ASKED, PRODUCTS = 16_384, 4_000_000


def _plain(vector: Column, length: int) -> Column:
    """Whether a vector has the length and finite components only."""
    return F.coalesce((F.size(vector) == length) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def _top(k: int):
    """The ``k`` best rows of each query, of two groups of plain vectors.

    Products of matrices tell which rows may be among them; these are measured like ``functions.text.cosine``,
    component by component, so equal vectors tie.
    """

    def run(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "similarity": []}
        if len(q) and len(rows):
            ask, held = np.stack(q["q"].to_numpy()).astype("float64"), np.stack(rows["embedding"].to_numpy()).astype("float64")
            norm = lambda m: np.sqrt(np.cumsum(m * m, axis=1)[:, -1])
            na, nh, qid, vid = norm(ask), norm(held), q["query_id"].to_numpy(), rows["vec_id"].to_numpy()
            unit = lambda m, n: m / np.where(n == 0, 1.0, n)[:, None]
            uh = unit(held, nh).T
            step = max(1, PRODUCTS // len(held))
            for at in range(0, len(ask), step):
                near = unit(ask[at : at + step], na[at : at + step]) @ uh
                for line, x in enumerate(near, at):
                    x[vid == qid[line]] = -2.0
                    least = np.partition(x, -k)[-k] if len(x) > k else -1.5
                    may = np.flatnonzero(x >= max(least - 1e-9, -1.5))
                    both = na[line] * nh[may]
                    with np.errstate(all="ignore"):
                        exact = np.where(both == 0, 0.0, np.cumsum(ask[line] * held[may], axis=1)[:, -1] / both)
                    best = np.lexsort((vid[may], -exact))[:k]
                    out["query_id"].append(np.full(len(best), qid[line]))
                    out["vec_id"].append(vid[may][best])
                    out["similarity"].append(exact[best])
        return pd.DataFrame({c: np.concatenate(v) if v else np.array([], "float64" if c == "similarity" else "int64") for c, v in out.items()})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, block: int = 100_000, predicate: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows by cosine for each row of ``queries``, within the same label, among the rows whose
    other columns fulfil ``predicate``, if there is one; it is applied before anything is compared or moved.

    The stated queries meet all rows of their label, dealt into blocks of about ``block`` rows and ``ASKED``
    queries, so a label of any size spreads over many tasks, each of which passes on at most ``k`` rows a query.
    Vectors of finite components and of the usual length are compared as matrices; what is null, not finite or
    of another length on either side is compared row by row.
    """
    rows = (rows if predicate is None else rows.where(predicate)).where("label IS NOT NULL").select("vec_id", "label", "embedding")
    asked = queries.where("label IS NOT NULL").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    usual = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = usual.n if usual else 0
    # squares that are beyond doubles, or vanish, are left to the row by row way too
    measured = lambda v: _plain(F.col(v), length) & F.coalesce(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).between(1e-200, 1e200), F.lit(False))
    asked, rows = asked.withColumn("ok", measured("q")), rows.withColumn("ok", measured("embedding"))
    parts = lambda df, per: df.where("ok").groupBy("label").agg(F.ceil(F.count("*") / per).cast("int").alias("parts"))
    part = lambda of, name: F.pmod(F.xxhash64(of), F.col(name)).cast("int")
    counts = parts(rows, block).withColumnRenamed("parts", "blocks").join(parts(asked, ASKED).withColumnRenamed("parts", "turns"), "label")
    number = counts.agg(F.sum(F.col("blocks").cast("long") * F.col("turns"))).first()[0] or 0
    tasks = int(max(1, min(number, 10_000)))
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    keys = ["label", "block", "turn"]
    q = asked.where("ok").join(counts, "label").withColumn("turn", part("query_id", "turns")).withColumn("block", each("blocks")).select(*(F.col(c).alias(f"of_{c}") for c in keys), "query_id", "q").repartition(tasks, *(f"of_{c}" for c in keys))
    dealt = rows.where("ok").join(counts, "label").withColumn("block", part("vec_id", "blocks")).withColumn("turn", each("turns")).select(*keys, "vec_id", "embedding").repartition(tasks, *keys)
    found = q.groupBy(*(f"of_{c}" for c in keys)).cogroup(dealt.groupBy(*keys)).applyInPandas(_top(k), "query_id long, vec_id long, similarity double")
    odd = lambda a, b: a.join(b, "label").where("vec_id <> query_id").select("query_id", "vec_id", X.cosine(F.col("q"), F.col("embedding")).alias("similarity"))
    scored = found.unionByName(odd(asked.where("NOT ok").drop("ok"), rows.drop("ok"))).unionByName(odd(asked.where("ok").drop("ok"), rows.where("NOT ok").drop("ok")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")
