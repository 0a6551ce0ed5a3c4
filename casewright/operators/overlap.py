"""Pairs of sets that share members: all of them by lists, those that share enough by prefixes.

``sharing`` writes down, for each set and each of its members, the list of later sets with that member. Lists go
to the task of their set, where its pairs are counted: what is moved is one number and one size a pair and
member, never a pair, and no pair is joined with anything.

``overlapping`` takes that way too, unless thresholds leave few candidates.

All sets are put in one order of members, the rarest first. If two sets share as much as they must, the
member they share first stands so early in both that what follows it still suffices; so each set is entered
under these members only, its prefix. Entries carry how many members and how much weight follow, and a
meeting that cannot suffice any more is dropped where it happens. A member that more than ``block`` sets are
entered under is cut into blocks on both sides of the join, each two blocks meeting once in a task of their
own.

A set has to fit in a row, where it is compared; how many sets a member has is not bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from ..functions import text as X
from .scratch import Scratch

BLOCK = 4096
#: Pairs that one task counts, and the meetings that cost as much as one candidate, for which two sets are fetched.
PAIRS, FETCH = 1_000_000, 20
#: Pairs of the profiles of one part, whose lists are sorted there; the more, the fewer parts a list goes to.
PART_PAIRS = 4_000_000
#: Sums of weights in another order may differ by this share.
SLACK = 1 - 1e-9


def prefixes(members: DataFrame, least_shared: int = 1) -> DataFrame:
    """The entries of sets: members (profile_id, node, rank, weight, size, need) with ``rest_n`` and ``rest``,
    the number and weight of members from this one on, and ``tail_n`` and ``tail``, those of members left out.

    ``rank`` orders the members alike in all sets, ``need`` is the weight that any partner must share with
    the set, at least; its own weights must not be below those of the pair.
    """
    behind = Window.partitionBy("profile_id").orderBy(F.desc("rank"), F.desc("node")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = members.withColumn("rest_n", F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("rank"), F.desc("node")))).withColumn("rest", F.sum("weight").over(behind))
    ranked = ranked.withColumn("kept", (F.col("rest_n") >= least_shared) & (F.col("rest") >= F.col("need") * SLACK))
    left = lambda name: F.coalesce(F.max(F.when(~F.col("kept"), F.col(name))).over(Window.partitionBy("profile_id")), F.lit(0))
    return ranked.withColumn("tail_n", left("rest_n")).withColumn("tail", left("rest")).where("kept").drop("kept")


def _met(entries: DataFrame, block: int) -> DataFrame:
    """The meetings of entries under their members: structs ``l`` and ``r`` of two profiles, each two once."""
    crowded = entries.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    dealt = entries.join(crowded, "node", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("profile_id"), F.col("parts")).cast("int"))
    row = F.struct(*(c for c in entries.columns if c != "node"))
    # each two parts of a member meet in the cell of the lower and the higher one
    left = dealt.select("node", F.col("part").alias("low"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("high"), row.alias("l"))
    right = dealt.select("node", F.col("part").alias("high"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("low"), row.alias("r"))
    return left.join(right, ["node", "low", "high"]).where((F.col("low") < F.col("high")) | (F.col("l.profile_id") < F.col("r.profile_id")))


def meetings(entries: DataFrame, suffices: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) with a < b that meet under a member and pass ``suffices`` (over structs ``l`` and ``r``)."""
    met = _met(entries, block)
    if suffices is not None:
        met = met.where(suffices)
    return met.select(F.least("l.profile_id", "r.profile_id").alias("a"), F.greatest("l.profile_id", "r.profile_id").alias("b")).distinct()


def weighed(connections: DataFrame) -> DataFrame:
    """Distinct (profile_id, node) with the degree of the node, its weight and the size of the profile's set."""
    rows = connections.select("profile_id", "node").where("profile_id IS NOT NULL AND node IS NOT NULL").distinct()
    degree = rows.groupBy("node").agg(F.count("*").alias("degree"))
    size = rows.groupBy("profile_id").agg(F.count("*").alias("size"))
    return rows.join(degree, "node").join(size, "profile_id").withColumn("weight", X.degree_weight(F.col("degree")))


def candidates(rows: DataFrame, least_shared: int = 1, least_score: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Pairs of ``weighed`` sets that may share ``least_shared`` members and score ``least_score``."""
    need = lambda together: F.lit(float(least_score)) * F.log2(together + 1)
    entries = prefixes(rows.select("profile_id", "node", F.col("degree").alias("rank"), "weight", "size", need(F.col("size")).alias("need")), least_shared)
    met = _met(entries.select("profile_id", "node", "size", "weight", "rest_n", "rest", "tail_n", "tail"), block)
    # at the first common member enough must follow; what two prefixes share is known, what may come to it lies
    # behind the earlier end of the two
    follows = F.least("l.rest", "r.rest") >= need(F.col("l.size") + F.col("r.size") - F.least("l.rest_n", "r.rest_n")) * SLACK
    pairs = met.groupBy(F.least("l.profile_id", "r.profile_id").alias("a"), F.greatest("l.profile_id", "r.profile_id").alias("b")).agg(
        F.bool_or(follows).alias("follows"), (F.count("*") + F.max(F.greatest("l.tail_n", "r.tail_n"))).alias("n"), (F.sum("l.weight") + F.max(F.greatest("l.tail", "r.tail"))).alias("weight"), F.max(F.col("l.size") + F.col("r.size")).alias("both")
    )
    enough = (F.col("n") >= least_shared) & (F.col("weight") >= need(F.greatest(F.lit(0), F.col("both") - F.col("n"))) * SLACK)
    return pairs.where(F.col("follows") & enough).select("a", "b")


def held(connections: DataFrame) -> DataFrame:
    """Distinct (profile_id, node) without nulls, kept."""
    rows = connections.select("profile_id", "node").where("profile_id IS NOT NULL AND node IS NOT NULL").distinct()
    return Scratch(connections.sparkSession, "sets").keep(rows, "sets")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of ``held`` whose node two sets or more have, with its degree and the size of the profile's set."""
    degree = rows.groupBy("node").agg(F.count("*").alias("degree")).where("degree > 1")
    size = rows.groupBy("profile_id").agg(F.count("*").cast("int").alias("size"))
    return rows.join(degree, "node").join(size, "profile_id")


def counted(connections: DataFrame) -> DataFrame:
    """The rows of ``_shared`` from connections, which are moved once, to the other rows of their node.

    Repeats go there and the sets of a node are counted there. Of a node that only one set has nothing but that
    set is written down, for its size.
    """
    rows = connections.select("profile_id", "node").where("profile_id IS NOT NULL AND node IS NOT NULL").repartition("node").distinct()
    rows = rows.withColumn("degree", F.count("*").over(Window.partitionBy("node")))
    several = lambda name: F.when(F.col("degree") > 1, F.col(name)).alias(name)
    kept = Scratch(connections.sparkSession, "sets").keep(rows.select("profile_id", several("node"), several("degree")), "sets")
    size = kept.groupBy("profile_id").agg(F.count("*").cast("int").alias("size"))
    return kept.where("node IS NOT NULL").join(size, "profile_id")


def lists(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(a, size, degree, others, keys but the first): for each set and member the sets (id, size) with a larger id that have the member too.

    Sets meet under equal ``keys``. Members of more than ``block`` sets have a row for each of their blocks.
    """
    parts = F.ceil(F.col("degree") / block).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("profile_id"), F.col("parts")).cast("int"))
    listed = dealt.groupBy(*keys, "degree", "parts", "part").agg(F.array_sort(F.collect_list(F.struct(F.col("profile_id").alias("id"), "size"))).alias("m"))
    kept = keys[1:]
    own = listed.select(*kept, "degree", "m", F.posexplode("m").alias("at", "x"))
    found = own.select(*kept, F.col("x.id").alias("a"), "x.size", "degree", F.slice("m", F.col("at") + 2, F.size("m")).alias("others"))
    if rows.where(F.col("degree") > block).isEmpty():
        return found.where(F.size("others") > 0)
    across = _across(listed, keys).select(*kept, "degree", F.explode("m").alias("x"), "all")
    other = F.filter("all", lambda y: y["id"] > F.col("x.id"))
    return found.unionByName(across.select(*kept, F.col("x.id").alias("a"), "x.size", "degree", other.alias("others"))).where(F.size("others") > 0)


def _across(listed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, degree, m, all): every two blocks of one member, from both sides."""
    crowded = listed.where("parts > 1")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = crowded.select(*keys, "degree", F.col("part").alias("mine"), each.alias("theirs"), "m").where("mine <> theirs")
    right = crowded.select(*keys, F.col("part").alias("theirs"), each.alias("mine"), F.col("m").alias("all")).where("mine <> theirs")
    return left.join(right, [*keys, "mine", "theirs"])


def _tasks(rows: DataFrame, keys: list[str]) -> int:
    """Tasks for the pairs that meet under equal keys."""
    met = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(met / PAIRS))


def sharing(connections: DataFrame, least_shared: int = 1, least_score: float = 0.0, groups: DataFrame | None = None, block: int = BLOCK, sets: DataFrame | None = None) -> DataFrame:
    """The rows of ``overlapping``, from lists; with ``groups`` (profile_id, group) of the pairs within a group, and that.

    Degrees and sizes are always those of all rows. The number of tasks follows from the number of pairs.
    """
    from .correlation import DISTINCTIVE_DEGREE

    spark = connections.sparkSession
    rows, keys = counted(connections) if sets is None else _shared(sets), ["node"]
    if groups is not None:
        rows, keys = rows.join(groups.select("profile_id", "group"), "profile_id").where("group IS NOT NULL"), ["node", "group"]
    rows = Scratch(spark, "sharing").keep(rows, "shared")
    tasks = _tasks(rows, keys)
    # ids and sizes apart: two plain arrays move at a third of the bytes of one of structs
    moved = lists(rows, keys, block).select(*keys[1:], "a", "size", "degree", F.col("others.id").alias("b"), F.col("others.size").alias("with")).repartition(tasks, "a")
    weighed = moved.withColumns({"weight": X.degree_weight(F.col("degree")), "near": (F.col("degree") <= DISTINCTIVE_DEGREE).cast("int")})
    met = weighed.select(*keys[1:], "a", "size", "weight", "near", F.inline(F.arrays_zip("b", "with"))).select(*keys[1:], "a", "b", (F.col("size") + F.col("with")).alias("both"), "weight", "near")
    # the rows of a set are in one task already, so this moves nothing
    pairs = met.groupBy("a", "b", "both", *keys[1:]).agg(F.count("*").alias("shared"), F.sum("near").alias("distinctive"), F.sum("weight").alias("evidence"))
    together = F.col("both") - F.col("shared")
    found = pairs.select("a", "b", "shared", "distinctive", together.cast("long").alias("together"), F.least(F.lit(1.0), F.col("evidence") / F.log2(together + 1)).alias("score"), *keys[1:])
    return found.where((F.col("shared") >= least_shared) & (F.col("score") >= least_score))


def _bounds(ids: DataFrame, parts: int) -> list:
    """Ids at which ranges of about as many rows begin; none for ids that are not whole numbers."""
    if parts < 2 or not isinstance(ids.schema["id"].dataType, IntegralType):
        return []
    return sorted(set(ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] or []))


def _part(profile: Column, bounds: list, parts: int) -> Column:
    """The number of the range that an id lies in, by halving; without ranges one by its hash."""
    if not bounds:
        return F.pmod(F.xxhash64(profile), F.lit(parts)).cast("int")
    starts = F.lit(bounds)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step - 1) <= profile, at + step).otherwise(at))


def dealt_lists(listed: DataFrame, parts: int, bounds: list, block: int = BLOCK) -> DataFrame:
    """(part, mine, others): each list once for each part of the profiles in it, with those of the part.

    Ids near each other are often in the same lists, so parts are ranges of ids. A list goes to as many parts as it
    has profiles at most, which is what it costs if they have nothing to do with each other.
    """
    met = listed.select("m", F.col("m").alias("all"))
    if not listed.where("parts > 1").isEmpty():
        met = met.unionByName(_across(listed, ["node"]).select("m", "all"))
    placed = met.select("m", "all", F.transform("m", lambda x: _part(x, bounds, parts)).alias("at"))
    each = placed.select("m", "all", "at", F.explode(F.array_distinct("at")).alias("part"))
    return each.select("part", F.filter("m", lambda x, k: F.get("at", k) == F.col("part")).alias("mine"), F.col("all").alias("others"))


def neighbours(connections: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, others): for each profile that shares a member, the ids of those it shares one with, in order.

    Rows move once, to their member, where the list of its profiles is written down. Lists move to parts of the
    profiles (see ``dealt_lists``), where those of each profile become one.
    """
    rows = connections.select("profile_id", "node").where("profile_id IS NOT NULL AND node IS NOT NULL").repartition("node").distinct()
    rows = rows.withColumn("degree", F.count("*").over(Window.partitionBy("node"))).where("degree > 1").withColumn("parts", F.ceil(F.col("degree") / block).cast("int"))
    grouped = rows.withColumn("part", F.pmod(F.xxhash64("profile_id"), F.col("parts")).cast("int")).groupBy("node", "degree", "parts", "part")
    listed = Scratch(connections.sparkSession, "neighbours").keep(grouped.agg(F.array_sort(F.collect_list("profile_id")).alias("m")), "lists")
    met, low, high = listed.agg(F.sum(F.size("m") * (F.col("degree") - 1) / 2), F.min(F.array_min("m")), F.max(F.array_max("m"))).first()
    tasks = max(int(connections.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((met or 0) / PART_PAIRS))
    given = listed.schema["m"].dataType
    if isinstance(given.elementType, IntegralType) and met and -(2**31) <= low and high < 2**31:
        listed = listed.withColumn("m", F.col("m").cast("array<int>"))  # half the bytes to move and sort
    dealt = dealt_lists(listed, tasks, _bounds(listed.select(F.explode("m").alias("id")), tasks), block).repartitionById(tasks, "part")
    # the rows of a profile are in one task already, so this moves nothing
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("others"))))
    found = dealt.select("part", F.explode("mine").alias("node"), "others").groupBy("node", "part").agg(every.alias("all"))
    return found.select(F.col("node").cast(given.elementType).alias("node"), F.array_remove("all", F.col("node")).cast(given).alias("others"))


def overlapping(connections: DataFrame, least_shared: int = 1, least_score: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(a, b, shared, distinctive, together, score) of all pairs that share ``least_shared`` members and reach
    ``least_score``, from (profile_id, node) rows; see ``correlation.network_overlap`` for the measure.

    Repeated rows count once, rows without profile or node not at all; an empty table gives no pairs. Prefixes are
    taken where their meetings, each of which may fetch two sets, are few against those of whole sets.
    """
    from .correlation import DISTINCTIVE_DEGREE

    if least_shared <= 1 and least_score <= 0:
        return sharing(connections, least_shared, least_score, None, block)
    own = held(connections)
    met = lambda entries: entries.groupBy("node").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    rows = weighed(own)
    by_score = rows.select("profile_id", "node", F.col("degree").alias("rank"), "weight", "size", (F.lit(float(least_score)) * F.log2(F.col("size") + 1)).alias("need"))
    if met(prefixes(by_score, least_shared)) * FETCH > met(own):
        return sharing(connections, least_shared, least_score, None, block, own)
    sets = rows.groupBy("profile_id").agg(F.collect_list(F.struct("node", "degree")).alias("members"))
    pairs = candidates(rows, least_shared, least_score, block)
    side = lambda name, to: sets.select(F.col("profile_id").alias(name), F.col("members").alias(to))
    found = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    found = found.select("a", "b", F.array_sort(F.transform(F.array_intersect("x", "y"), lambda m: m["degree"])).alias("degrees"), (F.size("x") + F.size("y")).alias("both"))
    evidence = F.aggregate("degrees", F.lit(0.0), lambda s, d: s + X.degree_weight(d))
    together = F.col("both") - F.size("degrees")
    found = found.select("a", "b", F.size("degrees").cast("long").alias("shared"), F.size(F.filter("degrees", lambda d: d <= DISTINCTIVE_DEGREE)).cast("long").alias("distinctive"), together.cast("long").alias("together"), F.least(F.lit(1.0), evidence / F.log2(together + 1)).alias("score"))
    return found.where((F.col("shared") >= least_shared) & (F.col("score") >= least_score))
