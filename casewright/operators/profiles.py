"""Platform profiles: one normalised shape, review leads by rule, and export rows.

Leads are reasons for a human to look, never findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .custody import uuid5

# Keys of a normalised profile, terms and limits of the review rules.
KEYS = ("platform", "user_id", "username", "display_name", "description", "created_at", "avatar_url", "flags", "raw")
REVIEW_TERMS = ("condo", "scented con", "vibe", "18+", "nsfw")
OFFSITE_TERMS = ("add me on", "dm me", "snap me", "discord", "kik", "message me on", "find me on")
SERVER_TERMS = ("nsfw", "18+", "e-girl", "e-boy", "condo", "dating", "hookup", "teen dating", "vibe", "nudes")
MANY_FRIENDS, SMALL_SERVER, MIN_PRESENCE, BUSY_SHARE = 200, 50, 10, 0.6
HTML_TAGS = ("<!doctype html", "<html", "<head", "<body")


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a text contains one of the terms, in any case."""
    found = F.lit(False)
    for term in terms:
        found = found | F.lower(text).contains(term)
    return F.coalesce(found, F.lit(False))


def matched_terms(text: Column, terms: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(F.lower(text).contains(t), t) for t in terms))))


def looks_like_html(text: Column) -> Column:
    """Whether one of four tags stands in the first 512 characters after leading white space."""
    head = F.lower(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 512))
    return F.coalesce(any_term(head, HTML_TAGS), F.lit(False))


def normalise(rows: DataFrame, platform: str, mapping: dict[str, str]) -> DataFrame:
    """``rows`` in the normalised shape; keys without a source column are null, ``raw`` holds all of it."""
    raw = F.to_json(F.struct("*"))
    columns = {k: F.col(mapping[k]).cast("string") if k in mapping else F.lit(None).cast("string") for k in KEYS}
    columns |= {"platform": F.lit(platform), "raw": raw}
    return rows.select(*(columns[k].alias(k) for k in KEYS))


def valid_keys(keys: Column) -> Column:
    """Whether an array of keys equals the normalised ones as a set."""
    want = F.array(*map(F.lit, KEYS))
    return (F.size(F.array_except(keys, want)) == 0) & (F.size(F.array_except(want, keys)) == 0)


def lead(name: str, weight: float, on: Column) -> Column:
    return F.when(on, F.struct(F.lit(name).alias("name"), F.lit(min(1.0, max(0.0, weight))).alias("weight")))


def account_leads(rows: DataFrame) -> DataFrame:
    """Accounts (profile_id, display_name, description, is_banned, friend_count, groups, games: arrays of
    names) with their review leads."""
    text = F.coalesce("description", F.lit(""))
    named = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda n: any_term(n, REVIEW_TERMS))
    leads = F.array_compact(
        F.array(
            lead("account_banned", 0.3, F.coalesce("is_banned", F.lit(False))),
            lead("sparse_profile", 0.2, (F.coalesce("display_name", F.lit("")) == "") & (text == "")),
            lead("offsite_contact_solicitation", 0.5, any_term(text, OFFSITE_TERMS)),
            lead("large_friend_network", 0.2, F.coalesce(F.col("friend_count") >= MANY_FRIENDS, F.lit(False))),
            lead("group_name_review_lead", 0.4, named("groups")),
            lead("game_name_review_lead", 0.4, named("games")),
        )
    )
    return rows.select("profile_id", leads.alias("leads"))


def server_leads(rows: DataFrame) -> DataFrame:
    """Servers (profile_id, display_name, description, features, verification_level, members, presence)
    with their review leads."""
    either = any_term(F.coalesce("display_name", F.lit("")), SERVER_TERMS) | any_term(F.coalesce("description", F.lit("")), SERVER_TERMS)
    public = F.exists(F.coalesce("features", F.array().cast("array<string>")), lambda f: (F.lower(f) == "invite_splash") | F.lower(f).contains("nsfw"))
    busy = (F.col("members") > 0) & (F.col("members") <= SMALL_SERVER) & (F.col("presence") >= F.greatest(F.lit(MIN_PRESENCE), F.floor(F.col("members") * BUSY_SHARE)))
    leads = F.array_compact(F.array(lead("server_name_or_bio_review_lead", 0.4, either), lead("low_verification_public_server", 0.2, F.coalesce(F.col("verification_level") == 0, F.lit(False)) & public), lead("small_high_activity_server", 0.2, F.coalesce(busy, F.lit(False)))))
    return rows.select("profile_id", leads.alias("leads"))


def lead_rows(found: DataFrame) -> DataFrame:
    return found.select("profile_id", F.explode("leads").alias("lead")).select("profile_id", "lead.name", "lead.weight")


def invite_codes(text: Column) -> Column:
    """Distinct invite codes in a text, as first seen."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)discord(?:\.gg|(?:app)?\.com/invite)/([A-Za-z0-9-]{2,32})"), F.lit(1)))


def site_hits(stdout: Column, limit: int = 20) -> Column:
    """Site names of a username scan's output lines ``[+] Site: http...``, the first ``limit``."""
    lines = F.filter(F.split(stdout, r"\r?\n"), lambda x: x.contains("[+] ") & x.contains("http"))
    return F.slice(F.transform(lines, lambda x: F.regexp_extract(x, r"\[\+\] ([^:]+):", 1)), 1, limit)


def account_objects(targets: DataFrame) -> DataFrame:
    """Account rows of an exchange bundle with stable ids."""
    platform = F.coalesce(F.nullif(F.lower("platform"), F.lit("")), F.lit("unknown"))
    name = F.concat_ws(":", platform, F.col("username"))
    return targets.select("case_id", F.concat(F.lit("user-account--"), uuid5(name)).alias("id"), platform.alias("account_type"), F.col("username").alias("account_login")).distinct()


def relationship_objects(pairs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Relationships between known accounts (profile_id, id); confidence is the strength in percent."""
    end = lambda side: accounts.select(F.col("profile_id").alias(side), F.col("id").alias(f"{side}_ref"))
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("strength") * 100).cast("int")))
    return pairs.join(end("a"), "a").join(end("b"), "b").select(F.col("a_ref").alias("source_ref"), F.col("b_ref").alias("target_ref"), confidence.alias("confidence"), F.when(F.col("has_contradiction"), "contradiction observed").otherwise("correlation lead").alias("note"))


#: Name space of the stable ids of an exchange bundle.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def stable_id(kind: str, *parts: Column) -> Column:
    """``kind--uuid`` from the parts of an object that do not change."""
    return F.concat(F.lit(f"{kind}--"), uuid5(F.concat_ws("|", F.lit(kind), *(p.cast("string") for p in parts)), NAMESPACE))


def identity_objects(entities: DataFrame, as_of: str) -> DataFrame:
    """One identity per resolved entity (case_id, id, name, identity_class, created): a human decision over
    accounts, not a claim about a person."""
    return entities.select("case_id", "entity_id", stable_id("identity", F.lit("entity"), F.col("entity_id")).alias("id"), F.col("canonical_handle").alias("name"), F.lit("unknown").alias("identity_class"), F.lit(as_of).alias("created"))


def membership_objects(entities: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
    """Relationships between an entity's identity and the accounts of its members."""
    rows = members.join(entities.select("entity_id", "case_id"), "entity_id")
    account = F.concat(F.lit("user-account--"), uuid5(F.concat_ws(":", "platform", "username")))
    return rows.select("case_id", stable_id("relationship", F.lit("membership"), F.col("entity_id"), F.col("profile_id")).alias("id"), stable_id("identity", F.lit("entity"), F.col("entity_id")).alias("source_ref"), account.alias("target_ref"), F.lit(as_of).alias("created"))


def grouping_objects(objects: DataFrame, as_of: str) -> DataFrame:
    """One grouping per case over its objects (case_id, id), in order of their ids."""
    rows = objects.groupBy("case_id").agg(F.array_sort(F.collect_set("id")).alias("object_refs"))
    return rows.select("case_id", stable_id("grouping", F.col("case_id")).alias("id"), F.lit("suspicious-activity").alias("context"), F.lit(as_of).alias("created"), "object_refs")


class Registry:
    """Platforms by name in lower case: how their rows are normalised, which leads they yield, and whether
    they are available."""

    def __init__(self):
        self._held: dict[str, tuple[dict[str, str], Callable[[DataFrame], DataFrame] | None, bool]] = {}

    def register(self, platform: str, mapping: dict[str, str], leads: Callable[[DataFrame], DataFrame] | None = None, available: bool = True) -> None:
        self._held[platform.lower()] = (mapping, leads, available)

    def platforms(self) -> list[str]:
        return sorted(self._held)

    def capabilities(self) -> dict[str, bool]:
        return {name: self._held[name][2] for name in self.platforms()}

    def normalised(self, platform: str | None, rows: DataFrame) -> DataFrame | None:
        """``rows`` in the normalised shape; None for a platform that is not registered."""
        found = self._held.get((platform or "").lower())
        return None if found is None else normalise(rows, platform.lower(), found[0])

    def leads(self, platform: str | None, rows: DataFrame) -> DataFrame | None:
        found = self._held.get((platform or "").lower())
        return None if found is None or found[1] is None else found[1](rows)


def default_registry() -> Registry:
    """The two platforms whose rows the review rules know."""
    out = Registry()
    out.register("roblox", {"user_id": "profile_id", "display_name": "display_name", "description": "description"}, account_leads)
    out.register("discord", {"user_id": "profile_id", "display_name": "display_name", "description": "description"}, server_leads)
    return out
