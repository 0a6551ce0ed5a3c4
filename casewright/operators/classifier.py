"""Rule-based classification of message lists.

A rule pack is data: categories with patterns and weights, context patterns that silence a message, and
thresholds. Counting hits is one expression per category over the message text, so the whole scan stays
inside one projection; profiles are then aggregated once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Categories with their weight, label and patterns, in order of weight.
RULES: dict[str, tuple[float, str, tuple[str, ...]]] = {
    "secrecy_solicitation": (0.24, "secrecy solicitation detected", (
        r"\bdon'?t\s+tell\s+your\s+(parents?|mom|dad|family|guardians?)\b",
        r"\bkeep\s+this\s+(a\s+)?secret\b",
        r"\bjust\s+between\s+(you\s+and\s+me|us)\b",
        r"\bif\s+you\s+tell\s+(anyone|them)\b",
        r"\bthis\s+is\s+(just\s+)?between\s+us\b",
        r"\byour\s+(parents?|family)\s+wouldn'?t\s+understand\b",
        r"\bthey\s+wouldn'?t\s+get\s+it\b",
    )),
    "platform_migration": (0.18, "platform migration pressure detected", (
        r"\b(add|find|follow)\s+me\s+on\s+(discord|snapchat|instagram|telegram|whatsapp|kik|signal)\b",
        r"\b(move|go|switch|talk)\s+(to|on)\s+(discord|snapchat|instagram|telegram|whatsapp|kik)\b",
        r"\bmy\s+(discord|snap|insta|telegram)\s+(is|tag|username|handle)\b",
        r"\bdm\s+me\s+on\b",
        r"\bmore\s+private\s+(on|there)\b",
        r"\bbetter\s+(on|there)\s+(discord|snap)\b",
    )),
    "age_probing": (0.16, "age probing detected", (
        r"\bhow\s+old\s+are\s+you\b",
        r"\bwhat'?s\s+your\s+age\b",
        r"\bare\s+you\s+(really\s+)?\d+\b",
        r"\byou\s+don'?t\s+seem\s+\d+\b",
        r"\bdo\s+your\s+parents?\s+(let|allow)\b",
        r"\bwhat\s+grade\s+are\s+you\s+in\b",
        r"\bdo\s+you\s+go\s+to\s+(school|college)\b",
        r"\bare\s+you\s+in\s+(middle|high)\s+school\b",
    )),
    "isolation_language": (0.14, "isolation language detected", (
        r"\b(let'?s|let us)\s+(talk|chat|hang)\s+(somewhere\s+)?private\b",
        r"\bjust\s+(the\s+two\s+of\s+us|us)\b",
        r"\bdon'?t\s+(tell|let)\s+(anyone|your\s+(parents?|mom|dad|friends?))\b",
        r"\bour\s+(little\s+)?secret\b",
        r"\bnobody\s+(needs?\s+to\s+)?know\b",
        r"\bkeep\s+(this|it)\s+(between\s+us|quiet|secret)\b",
        r"\baway\s+from\s+(everyone|the\s+others?|the\s+group)\b",
    )),
    "identity_probing": (0.10, "identity and location probing detected", (
        r"\bwhat'?s\s+your\s+(real\s+)?(name|address|school|location|city|phone)\b",
        r"\bwhere\s+do\s+you\s+(live|go\s+to\s+school)\b",
        r"\bdo\s+you\s+have\s+(a\s+phone|snapchat|instagram)\b",
        r"\bcan\s+you\s+(send|share)\s+(me\s+)?(a\s+)?(photo|pic|picture|selfie)\b",
        r"\bsend\s+(me\s+)?(a\s+)?(photo|pic|picture|selfie)\b",
        r"\bwhat\s+do\s+you\s+look\s+like\b",
    )),
    "gift_incentive": (0.10, "gift or incentive offers detected", (
        r"\bi'?ll\s+(give|send|buy)\s+you\s+(robux|v-?bucks|gift\s+cards?|money|presents?)\b",
        r"\bfree\s+robux\b",
        r"\bi\s+can\s+(get|buy|send)\s+you\b",
        r"\bif\s+you\s+(do|send|give)\s+.{0,30}(i'?ll\s+(give|send|buy))\b",
        r"\breward\s+you\b",
        r"\brobux\s+for\b",
        r"\bgift\s+card\s+if\b",
    )),
    "compliment_escalation": (0.05, "compliment escalation detected", (
        r"\byou'?re\s+(so\s+)?(mature|grown\s+up|different|special|not\s+like\s+other\s+kids)\b",
        r"\bfor\s+your\s+age\b",
        r"\byou\s+(seem|look|act)\s+(older|more\s+mature)\b",
        r"\byou'?re\s+so\s+(pretty|beautiful|cute|hot|attractive)\b",
        r"\bi\s+(really\s+)?like\s+(talking\s+to\s+)?you\b",
        r"\byou'?re\s+special\s+to\s+me\b",
        r"\bi'?ve\s+never\s+(met|talked\s+to)\s+(anyone|someone)\s+like\s+you\b",
    )),
    "trust_building": (0.03, "trust-building language detected", (
        r"\bi\s+(really\s+)?trust\s+you\b",
        r"\byou\s+can\s+trust\s+me\b",
        r"\bi\s+understand\s+you\b",
        r"\bno\s+one\s+else\s+(understands?|gets?\s+it)\b",
        r"\bwe\s+have\s+(such\s+a\s+)?special\s+(connection|bond|relationship)\b",
        r"\bi'?m\s+(not\s+like\s+)?other\s+(guys?|people|adults?)\b",
    )),
}
# A message that matches one of these is not scored.
SILENCED = (
    r"\bdo\s+not\s+groom\b",
    r"\bnot\s+grooming\b",
    r"\bchild\s+protection\b",
    r"\bsafety\s+training\b",
    r"\breport\s+to\s+cybertip\b",
    r"\bthis\s+is\s+an?\s+example\b",
    r"\beducational\b",
    r"\btraining\b",
)
_UNICODE = "(?iuU)"
# What RE2 takes for a word, its borders, spaces and digits, and for the letters that fold with others.
_WORD = "(?-i:[0-9A-Za-z_])"
_RE2 = {r"\b": f"(?:(?={_WORD})(?<!{_WORD})|(?!{_WORD})(?<={_WORD}))", r"\s": r"[\t\n\f\r ]", r"\d": "[0-9]", "s": "[s\u017f]", "k": "[k\u212a]"}


@dataclass(frozen=True)
class RulePack:
    """Categories (weight, label, patterns), silencing patterns and decision thresholds."""

    rules: dict[str, tuple[float, str, tuple[str, ...]]]
    silenced: tuple[str, ...] = ()
    escalate: float = 0.55
    review: float = 0.25
    #: Sets of categories that together raise the score; the first that applies counts.
    sequences: tuple[tuple[frozenset[str], float], ...] = ()
    many_categories: tuple[int, float] = (4, 0.10)
    #: Words, spaces and digits are ASCII, as in the regular expressions of SQL engines; else Unicode's.
    ascii: bool = False

    def pattern(self, p: str) -> str:
        """A pattern (whose character classes hold no s, k or escapes) with its flags, for Spark."""
        return "(?id)" + re.sub(r"\\.|[sk]", lambda m: _RE2.get(m[0], m[0]), p) if self.ascii else _UNICODE + p

    def compiled(self, p: str) -> re.Pattern[str]:
        """The same for Python."""
        return re.compile(self.pattern(p).removeprefix("(?id)"), re.IGNORECASE | re.ASCII) if self.ascii else re.compile(p, re.IGNORECASE)


#: Registered rule packs by name; the first one registered is the default.
_PACKS: dict[str, RulePack] = {}


def register(name: str, pack: RulePack) -> None:
    _PACKS[name] = pack


def pack(name: str = "conversation_safety") -> RulePack:
    return _PACKS[name]


register("conversation_safety", RulePack(RULES, SILENCED, sequences=((frozenset({"age_probing", "platform_migration", "secrecy_solicitation"}), 0.15), (frozenset({"compliment_escalation", "trust_building", "identity_probing"}), 0.08))))


def _bounded(p: str) -> bool:
    """Whether all of a pattern stands behind the border of a word that it begins with."""
    plain = re.sub(r"\\.", "", p)
    depth = 0
    for c in plain:
        depth += (c == "(") - (c == ")")
        if c == "[" or (c == "|" and depth == 0):
            return False
    return p.startswith(r"\b")


def _any(patterns: tuple[str, ...]) -> str | None:
    """A pattern that is found where one of ``patterns`` is; borders of words, which are few, are looked for first.
    None if patterns refer to groups by number or name, or to none at all."""
    if not patterns or any(re.search(r"\\[1-9kQ]|\(\?P?<[A-Za-z]|\(\?[a-zA-Z-]+\)", p) for p in patterns):
        return None
    inner = [f"(?:{p[2:]})" for p in patterns if _bounded(p)]
    return "|".join([*([r"\b(?:" + "|".join(inner) + ")"] if inner else []), *(f"(?:{p})" for p in patterns if not _bounded(p))])


def message_hits(messages: DataFrame, rules: RulePack | None = None) -> DataFrame:
    """profile_id, message_index, silenced and one hit count for each category."""
    rules = rules or pack()
    text = F.coalesce(F.col("text"), F.lit(""))
    silenced = text.rlike(rules.pattern("(" + "|".join(rules.silenced) + ")")) if rules.silenced else F.lit(False)

    def hits(patterns: tuple[str, ...]) -> Column:
        total = F.lit(0)
        for p in patterns:
            total = total + F.regexp_count(text, F.lit(rules.pattern(p)))
        return F.when(F.col("silenced") | ~F.col("__some"), 0).otherwise(total).cast("long")

    # most messages match nothing, which one scan tells
    every = _any(tuple(p for x in rules.rules.values() for p in x[2]))
    some = F.lit(True) if every is None else text.rlike(rules.pattern(every))
    return messages.select("profile_id", "message_index", "text", silenced.alias("silenced"), some.alias("__some")).select("profile_id", "message_index", "silenced", *(hits(x[2]).alias(name) for name, x in rules.rules.items()))


def category_hits(messages: DataFrame, rules: RulePack | None = None) -> DataFrame:
    """(profile_id, category, hits) for categories with a hit."""
    rules = rules or pack()
    counted = message_hits(messages, rules).groupBy("profile_id").agg(*(F.sum(c).alias(c) for c in rules.rules))
    return counted.unpivot("profile_id", list(rules.rules), "category", "hits").where("hits > 0")


def classify(messages: DataFrame, profiles: DataFrame | None = None, rules: RulePack | None = None) -> DataFrame:
    """One row per profile with messages: counts, category scores, score, decision, top signals, notes.

    ``profiles`` may add account_age_days and friend_count, which can raise the score of young accounts
    with many contacts. Sequence rules look at the set of categories only, not at their order.
    """
    rules = rules or pack()
    names = list(rules.rules)
    hit = message_hits(messages, rules)
    flagged = F.lit(False)
    for c in names:
        flagged = flagged | (F.col(c) > 0)
    out = hit.groupBy("profile_id").agg(F.count("*").alias("message_count"), F.count_if(flagged).alias("flagged_count"), *(F.sum(c).alias(c) for c in names))
    scores = {c: F.least(F.lit(1.0), F.col(c) / F.lit(3.0)) * rules.rules[c][0] for c in names}
    total = F.lit(0.0)
    for c in names:
        total = total + scores[c]
    n_categories = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in names), F.lit(0))
    bonus = F.when(n_categories >= rules.many_categories[0], rules.many_categories[1]).otherwise(0.0)
    for needed, value in reversed(rules.sequences):
        every = F.lit(True)
        for c in sorted(needed):
            every = every & (F.col(c) > 0)
        bonus = F.when(every, value).otherwise(bonus)
    out = out.withColumn("sequence_bonus", bonus).withColumn("language_score", F.least(F.lit(1.0), total + F.col("sequence_bonus")))
    if profiles is None:
        out = out.withColumns({"account_age_days": F.lit(None).cast("int"), "friend_count": F.lit(None).cast("int")})
    else:
        out = out.join(profiles.select("profile_id", "account_age_days", "friend_count"), "profile_id", "left")
    young = F.col("account_age_days") < 30
    boost = F.when(young & (F.col("friend_count") > 100), 0.12).otherwise(0.0) + F.when(young & (F.col("friend_count") > 200), 0.08).otherwise(0.0)
    out = out.withColumn("boost", boost).withColumn("score", F.least(F.lit(1.0), F.col("language_score") + F.col("boost")))
    decision = (
        F.when((F.col("message_count") < 2) & (F.col("score") < rules.escalate), "allow").when(F.col("message_count") < 2, "review")
        .when((F.col("score") >= rules.escalate) & (F.col("flagged_count") >= 2), "escalate").when(F.col("score") >= rules.review, "review").otherwise("allow")
    )
    ranked = F.array(*(F.struct((-scores[c]).alias("by"), F.lit(k).alias("k"), F.col(c).alias("hits"), F.lit(rules.rules[c][1]).alias("label")) for k, c in enumerate(names)))
    best = F.slice(F.array_sort(F.filter(ranked, lambda x: x["hits"] > 0)), 1, 5)
    signals = F.transform(best, lambda x: F.concat(x["label"], F.lit(" ("), x["hits"].cast("string"), F.when(x["hits"] == 1, " instance)").otherwise(" instances)")))
    notes = F.concat_ws("; ", F.when(F.col("sequence_bonus") > 0, "multi-step pattern sequence detected"), F.when((F.col("flagged_count") > 0) & (F.col("flagged_count") < F.col("message_count")) & (F.col("message_count") >= 5), "pattern spread across multiple messages"), F.when(F.col("boost") > 0, "velocity signals applied"))
    return out.withColumns({"decision": decision, "top_signals": signals, "notes": notes})


def match_details(messages: DataFrame, rules: RulePack | None = None) -> DataFrame:
    """Every hit with category, matched text and start offset. No built-in lists all positions of a
    pattern, so this detail view, for review of single profiles, runs in Arrow batches."""
    rules = rules or pack()
    patterns = [(c, p) for c, x in rules.rules.items() for p in x[2]]
    silenced = rules.silenced

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(c, rules.compiled(p)) for c, p in patterns]
        quiet = [rules.compiled(p) for p in silenced]
        for batch in batches:
            rows = [
                (pid, index, c, m[0], m.start())
                for pid, index, text in zip(batch.profile_id, batch.message_index, batch.text.fillna(""), strict=True)
                if not any(q.search(text) for q in quiet)
                for c, p in compiled
                for m in p.finditer(text)
            ]
            yield pd.DataFrame(rows, columns=["profile_id", "message_index", "category", "matched_text", "position"])

    return messages.select("profile_id", "message_index", "text").mapInPandas(run, "profile_id long, message_index long, category string, matched_text string, position long")
