"""URL filters as a sort-merge range join, from built-in functions only.

A rule (host, path) becomes a canonical key, the host's labels reversed and then the path; the keys it
covers form the interval [key, key + last code point]. A url has one key for every ending of its host, so
a rule on a domain meets its subdomains. Rules and urls of one host ending are sorted together. Intervals
nest, so at each place of the sorted sequence a stack of rules is active: a rule's start opens it on top
of the rules around it, its end leaves the stack of the rule around it. The sweep carries the latest
stack to each url, whose longest rule is on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.scratch import Scratch
from .literals import literal_rows

#: (host, path, verdict)
Rule = tuple[str, str, str]
_AFTER = "\U0010ffff"  # sorts behind every continuation of a path
_END, _START, _URL = 0, 1, 2
#: Urls of one host ending are dealt over so many parts for each shuffle partition that their share fills.
PARTS = 4


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules given as literals: host, path, verdict."""
    return literal_rows(spark, "host string, path string, verdict string", [(h.lower(), p, v) for h, p, v in rules])


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path). The host follows the first ``://``; only A-Z are lower-cased."""
    after = F.regexp_extract(F.col(url).cast("string"), r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(page_id).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def _reversed(host) -> F.Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _boundaries(rules: DataFrame) -> DataFrame:
    """(ending, place, kind, stack): each rule's start with the rules active from there, innermost last,
    and its end with those that stay. A rule meets the rules around it through the prefixes of its path."""
    rules = rules.select(_reversed("host").alias("ending"), "path", F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict").alias("entry"))
    # the same key twice: blocking wins
    rules = rules.groupBy("ending", "path").agg(F.max_by("entry", "entry.verdict").alias("entry"))
    around = rules.select("ending", F.col("path").alias("prefix"), F.struct(F.length("path").alias("depth"), F.col("entry").alias("entry")).alias("outer"))
    prefixes = rules.select("ending", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("prefix"))
    nested = prefixes.join(around, ["ending", "prefix"]).groupBy("ending", "path").agg(F.sort_array(F.collect_list("outer")).alias("outer"))
    stack = F.transform("outer", lambda x: x["entry"])
    opened = nested.select("ending", F.col("path").alias("place"), F.lit(_START).alias("kind"), stack.alias("stack"))
    closed = nested.select("ending", F.concat("path", F.lit(_AFTER)).alias("place"), F.lit(_END).alias("kind"), F.slice(stack, 1, F.size("outer") - 1).alias("stack"))
    return opened.unionByName(closed)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row (page_id, host, path, rule, verdict) per input row.

    ``rules`` has host, path, verdict. A rule fits a url if the url's host is the rule's or ends in
    ``.`` and the rule's, and the url's path starts with the rule's. The longest rule (host and path
    together) wins, at equal length the one with the longer host; of the same rule twice, ``block`` wins
    over ``allow``. Without a rule, ``rule`` is null and the verdict is ``default``. A url that is null or
    has no ``://`` has empty host and path and meets no rule, unless a rule has an empty host. Repeated
    rows come back as often as they stand; a null page_id stays null; other columns are ignored.
    """
    spark = pages.sparkSession
    # equal rows are judged once and dealt out again at the end
    rows = parsed(pages, page_id, url).groupBy("page_id", "host", "path").agg(F.count("*").alias("times"))
    bounds = _boundaries(rules)
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("deepest"))
    ending = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.col("deepest"))), lambda n: F.array_join(F.reverse(F.slice("labels", -n, n)), "."))
    urls = rows.join(F.broadcast(deepest)).withColumn("labels", F.split("host", r"\.", -1))  # one row: the depth of the deepest rule
    # ending null: the row itself, whichever rules there are
    probes = urls.select("page_id", "host", "path", "times", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.when(F.col("deepest") > 0, ending).otherwise(F.array().cast("array<string>")))).alias("ending"))
    ruled = probes.join(bounds.select("ending").distinct().withColumn("met", F.lit(True)), "ending", "left").where("met or ending is null").drop("met")
    scratch = Scratch(spark, "urls")
    ruled = scratch.keep(ruled, "ruled")  # counted first, then swept
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * PARTS
    sizes = scratch.keep(ruled.groupBy("ending").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n").alias("total"))
    dealt = sizes.join(F.broadcast(total)).select("ending", F.ceil(F.col("n") * parts / F.col("total")).cast("int").alias("parts"))
    known = dealt.where("ending is not null")
    sent = ruled.join(known, "ending", "left").select(
        F.coalesce("ending", F.lit("")).alias("ending"), F.pmod(F.xxhash64("page_id", "host", "path"), F.coalesce("parts", F.lit(parts))).alias("part"), F.col("path").alias("place"), F.lit(_URL).alias("kind"),
        F.lit(None).cast(bounds.schema["stack"].dataType).alias("stack"), "page_id", "host", "path", "times", F.col("ending").isNull().alias("bare"),
    )
    copies = bounds.join(known, "ending").select(
        "ending", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), "place", "kind", "stack",
        F.lit(None).cast(sent.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("times"), F.lit(False).alias("bare"),
    )
    sweep = Window.partitionBy("ending", "part", "bare").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = sent.unionByName(copies).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("kind") == _URL)
    top = F.when(F.size("stack") > 0, F.element_at("stack", -1))
    best = swept.select("page_id", "host", "path", "times", F.when(top.isNotNull(), F.struct(top["size"].alias("size"), F.length("ending").alias("host_size"), top["rule"].alias("rule"), top["verdict"].alias("verdict"))).alias("hit"))
    best = best.groupBy("page_id", "host", "path").agg(F.max("hit").alias("hit"), F.max("times").alias("times"))
    return best.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy")).drop("copy")


#: The rules of the query.
QUERY_RULES: tuple[Rule, ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
