"""Redaction of personal data by pattern and by tagged values, with counts.

Masks are applied one after the other, as replaced text must not match again; each count is taken on the
text that its mask sees. Only form is recognised, never meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T, functions as F

from ..functions.text import let

# Digits and white space of any script, as the masks mean them.
_D, _S = r"\p{Nd}", r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_OCTET = rf"(?:25[0-5]|2[0-4]{_D}|1?{_D}?{_D})"
_GAP = rf"[{_S[1:-1]}.\-]?"
# Kinds in order of application, with pattern and placeholder. Look-behinds, \G and possessive
# quantifiers spare starts and retries that cannot match, and the recursion of nested repeats; what is
# matched is the same as without them.
KINDS: dict[str, tuple[str, str]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[REDACTED - EMAIL]"),
    "ssn": (rf"(?<!{_D}){_D}{{3}}-{_D}{{2}}-{_D}{{4}}(?!{_D})", "[REDACTED - SSN]"),
    "ipv4": (rf"(?<!{_D})(?:{_OCTET}\.){{3}}{_OCTET}(?!{_D})", "[REDACTED - IP]"),
    "ipv6": (
        r"(?<![0-9A-Fa-f:])(?=[0-9A-Fa-f]++:)((?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9]*+[A-Fa-f][0-9A-Fa-f]*+:){2,}+[0-9A-Fa-f]++)(?![0-9A-Fa-f:])",
        "[REDACTED - IP]",
    ),
    "phone": (rf"(?<!{_D})(?:\+?{_D}{{1,3}}{_GAP})?(?:\(?{_D}{{3}}\)?{_GAP}){_D}{{3}}{_GAP}{_D}{{4}}(?!{_D})", "[REDACTED - PHONE]"),
}
#: What a text must hold for a mask to match at all, and its least length; texts without it are not searched further.
_NEEDS = {"email": ("@", 6), "ssn": ("-", 11), "ipv4": (".", 7), "ipv6": (":", 3), "phone": ("", 10)}
#: Parts of every match that are found in one pass, so that times and numbers are not searched further either.
_PARTS = {"ipv6": r"::|[A-Fa-f][0-9A-Fa-f]*+:|(?::[0-9A-Fa-f]{1,4}){7}", "phone": rf"{_D}{{3}}\)?{_GAP}{_D}{{3}}{_GAP}{_D}{{4}}"}
#: Found in every text that any mask changes, in one pass: two digits before four, digits around a point, or what an address needs.
_ANY = rf"@|{_D}(?:\.{_D}|{_D}\P{{Nd}}?{_D}{{4}})|:(?::|[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{6}})|[A-Fa-f][0-9A-Fa-f]*+:"
#: Policies differ in the placeholder of tagged values.
POLICIES = {"standard": "[REDACTED - PROTECTED]", "minor_involved": "[REDACTED - MINOR]"}


def placeholder(policy: str) -> str:
    if policy not in POLICIES:
        raise ValueError(f"unknown redaction policy {policy!r}")
    return POLICIES[policy]


def _mask(text: Column, kind: str) -> Column:
    pattern, mark = KINDS[kind]
    needed, least = _NEEDS[kind]
    may = (F.length(text) >= least) & F.contains(text, F.lit(needed))
    return F.when(may & text.rlike(_PARTS[kind]) if kind in _PARTS else may, F.regexp_replace(text, pattern, mark)).otherwise(text)


def _masker(kind: str):
    return lambda text: _mask(text, kind)


def mask_patterns(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` masked and one count column for each kind; null texts count zero.

    Matches are counted only in texts that the mask changes.
    """
    for kind, (pattern, _) in KINDS.items():
        df = df.withColumn("__masked", _mask(F.col(column), kind))
        changed = F.col("__masked") != F.col(column)
        df = df.withColumn(f"n_{kind}", F.when(changed, F.regexp_count(F.col(column), F.lit(pattern))).otherwise(0).cast("long")).withColumn(column, F.col("__masked")).drop("__masked")
    return df


def masked(text: Column, protected: tuple[str, ...] = (), policy: str = "standard") -> Column:
    """``text`` with all patterns and then the protected values masked; null stays null."""
    chain = text
    for kind in KINDS:
        chain = let(chain, _masker(kind))
    text = F.when(text.rlike(_ANY), chain).otherwise(text)
    for value in protected:
        text = F.regexp_replace(text, F.lit(r"(?iu)\Q" + value.replace(r"\E", r"\E\\E\Q") + r"\E"), F.lit(placeholder(policy)))
    return text


#: Stands for the placeholder of tagged values while others are looked for, so that texts do not grow meanwhile.
_STAND = "\x01"


def _sought(values: Column) -> Column:
    """The values to look for with what spares a search: lower case, whether they are ASCII, and whether they have
    no letter and nothing in common with a placeholder."""
    known = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.transform(known, lambda v: F.struct(v.alias("v"), F.lower(v).alias("low"), (F.octet_length(v) == F.length(v)).alias("ascii"), v.rlike(r"\A[\x02-\x7F&&[^A-Za-z\[\]\x20-]]+\z").alias("apart")))


def _hide(text: Column, sought: Column, policy: str) -> Column:
    """``text`` with every one of ``_sought`` masked. A pattern is only made for a value that may be there: in
    ASCII lower case tells whether it is, and what has no case is replaced as it stands."""
    mark, stand = F.lit(placeholder(policy)), F.lit(_STAND)
    quoted = lambda v: F.concat(F.lit(r"(?iu)\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    search = lambda t, x: F.regexp_replace(t, quoted(x["v"]), mark)

    def shown(x: Column):
        absent = lambda t: x["ascii"] & (F.octet_length(t) == F.length(t)) & ~F.contains(F.lower(t), x["low"])
        return lambda t: F.when(absent(t), t).otherwise(search(t, x))

    step = lambda t, x: F.when(x["apart"], F.replace(t, x["v"], stand)).otherwise(let(F.replace(t, stand, mark), shown(x)))
    of = lambda t: F.when(F.contains(t, stand), F.aggregate(sought, t, search)).otherwise(F.replace(F.aggregate(sought, t, step), stand, mark))
    return let(text, of)


def mask_protected(text: Column, values: Column, policy: str = "standard") -> Column:
    """``text`` with every value of an array masked, anywhere and in any case, in array order."""
    return _hide(text, _sought(values), policy)


def redact_frame(df: DataFrame, protected: tuple[str, ...] = (), policy: str = "standard", keep: tuple[str, ...] = ()) -> DataFrame:
    """All text in ``df`` masked, in nested structs, arrays and map values too; map keys, other types and
    the columns of ``keep`` stay as they are."""
    return df.select(*(F.col(f"`{f.name}`") if f.name in keep else _walk(F.col(f"`{f.name}`"), f.dataType, protected, policy).alias(f.name) for f in df.schema))


def _walk(c: Column, kind: T.DataType, protected: tuple[str, ...], policy: str) -> Column:
    if isinstance(kind, T.StringType):
        return masked(c, protected, policy)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _walk(x, kind.elementType, protected, policy))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _walk(v, kind.valueType, protected, policy))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_walk(c[f.name], f.dataType, protected, policy).alias(f.name) for f in kind)))
    return c


def tally(df: DataFrame, column: str) -> DataFrame:
    """(kind, n): how often each kind was masked over the whole table."""
    counted = mask_patterns(df.select(column), column).agg(*(F.coalesce(F.sum(f"n_{k}"), F.lit(0)).cast("long").alias(k) for k in KINDS))
    return counted.unpivot([], list(KINDS), "kind", "n")


def protected_tags(notes: DataFrame, key: str = "case_id", text: str = "text", position: str = "position") -> DataFrame:
    """(key, values): tagged values (lines ``protected: value``) of each key, distinct, as first seen."""
    lines = notes.select(key, position, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line_no", "line"))
    value = F.regexp_extract("line", r"(?i)^\s*protected\s*:\s*(.*?)\s*$", 1)
    found = lines.select(key, position, "line_no", value.alias("value")).where("value <> ''")
    first = found.groupBy(key, "value").agg(F.min(F.struct(position, "line_no")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def tagged_values(cases: DataFrame, targets: DataFrame, analyses: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """(case_id, values): protected values of each case from the notes of its targets, its description, the
    notes on its analyses, and a table of protected parties if there is one; distinct, as first seen in
    that order."""

    def surface(rows: DataFrame, rank: int, order: str, text: str) -> DataFrame:
        return rows.where(F.col(text).isNotNull()).select("case_id", F.struct(F.lit(rank).alias("surface"), F.col(order).cast("long").alias("row")).alias("position"), F.col(text).alias("text"))

    owned = analyses.join(targets.select("target_id", "case_id"), "target_id")
    rows = surface(targets, 0, "target_id", "notes").unionByName(surface(cases.withColumn("__n", F.lit(0)), 1, "__n", "description")).unionByName(surface(owned, 2, "result_id", "analyst_notes"))
    if parties is not None:
        rows = rows.unionByName(surface(parties.where("value <> ''").withColumns({"__n": F.monotonically_increasing_id(), "__t": F.concat(F.lit("protected: "), "value")}), 3, "__n", "__t"))
    return protected_tags(rows)


def case_export(cases: DataFrame, targets: DataFrame, analyses: DataFrame, artifacts: DataFrame, values: DataFrame, policy: str = "standard") -> DataFrame:
    """(case_id, case_name, description, targets): each case with its targets, their analyses, newest first,
    and artifacts in order, all text masked by the patterns and then by the case's protected values. Ids,
    hashes, platforms and times are text like any other and masked where they look like personal data."""
    newest = F.array_sort(F.collect_list(F.struct("analyzed_at", "result_id", "risk_score", "analyst_notes")))
    found = analyses.groupBy("target_id").agg(F.transform(F.reverse(newest), lambda x: F.struct(x["risk_score"].alias("risk_score"), x["analyst_notes"].alias("analyst_notes"), x["analyzed_at"].alias("analyzed_at"))).alias("analyses"))
    held = artifacts.groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("artifact_id", "module_name", "artifact_type", "collected_at"))), lambda x: F.struct(x["module_name"].alias("module_name"), x["artifact_type"].alias("artifact_type"), x["collected_at"].alias("collected_at"))).alias("artifacts"))
    rows = targets.join(found, "target_id", "left").join(held, "target_id", "left")
    own = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "platform", "username", "notes", "analyses", "artifacts"))).alias("targets"))
    out = cases.select("case_id", "case_name", "description").join(own, "case_id", "left").join(values, "case_id", "left")
    kinds, hidden = out.schema, F.col("values")
    out = out.withColumn("values", _sought(F.coalesce("values", F.array().cast("array<string>"))))

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return _hide(masked(c), hidden, policy)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(walk(c[f.name], f.dataType).alias(f.name) for f in kind)))
        return c

    return out.select("case_id", *(walk(F.col(c), kinds[c].dataType).alias(c) for c in ("case_name", "description", "targets")))
