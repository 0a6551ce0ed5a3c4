"""Personal data by weak supervision, from built-in functions only.

Candidate spans come from regular expressions (strict ones, whose hits always count, and loose ones).
Labelers vote on each loose candidate: its shape and checksum, gazetteers of country codes and given names,
cue words before it, and its context. Votes are few and discrete, so candidates are aggregated to vote
patterns; expectation-maximisation over the pattern counts estimates each labeler's reliability. A logistic
span classifier, which sees not only the votes but features of the span and its surroundings that no
labeler looks at, is fitted to the resulting posteriors and decides on every loose candidate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..operators.scratch import Scratch

# Strict patterns and kinds, in the order in which ties at one start are listed. The
# look-behinds and possessive groups only spare retries that cannot match; the matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Gazetteers of given names, and of countries with the length of their account numbers.
GIVEN = (
    "Aisha Alexander Alice Amelia Amir Ana Andrea Anna Anne Antonio Arthur Benjamin Carlos Carmen Charles Charlotte Chen Christine Claire Daniel David Diego Elena Elizabeth Emily Emma Eric Fatima Felix Francesca "
    "Francisco Fritz Gabriel George Giulia Hannah Hans Helen Henry Hiroshi Ibrahim Ines Isabel Ivan Jack Jacques James Jan Jane Javier Jean Jessica Joana John Jonas Jorge Joseph Juan Julia Karl Kate Klaus Laura "
    "Lena Linda Louis Lucas Luis Manuel Marco Maria Marie Mark Martin Mary Matthew Mehmet Michael Miguel Mohammed Monika Nicolas Nina Noah Olga Oliver Pablo Patricia Paul Pedro Peter Philip Pierre Priya Rachel "
    "Ravi Robert Rosa Samuel Sandra Sarah Sergei Sofia Stefan Susan Thomas Ursula Victor Wei William Yuki Yusuf"
).split()
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Loose patterns; their spans are judged by the classifier.
LOOSE = {
    "loose_phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "loose_card": r"(?<![0-9A-Za-z-])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9A-Za-z-])",
    "loose_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[a-z]{2,24})(?![a-z0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": r"(?<![\p{L}])(?=\p{Lu})(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?|(?:__GIVEN__)\x20(?:\p{Lu}\.\x20)?\p{Lu}\p{Ll}{1,30})(?!\p{L})",
}
LOOSE["name"] = LOOSE["name"].replace("__GIVEN__", "|".join(GIVEN))
KINDS = (*BASE, *LOOSE)
#: What a text must hold for a pattern to match at all.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "loose_phone": r"[0-9]{3}[.\x20-]", "national_id": r"[0-9]-[0-9]", "loose_card": r"[0-9]{4}", "loose_email": r"(?i)[\[(]at[\])]", "iban": r"[A-Z]{2}[0-9]{2}"}

# Cue words for each loose kind, looked for in the words just before a candidate.
CUES = {
    "loose_phone": "phone tel telephone call mobile cell fax whatsapp dial",
    "national_id": "ssn social security id identification national taxpayer",
    "loose_card": "card visa mastercard amex credit debit pan",
    "loose_email": "email mail contact write reach",
    "iban": "iban account bank transfer",
    "name": "name contact patient signed sincerely dear author regards",
}
PERSONAL = "my your his her their our me contact customer patient employee"
#: Code points of context before and after a candidate that the labelers see.
CONTEXT = 40
VOTES = ("shape", "gazetteer", "cue", "personal", "not_measure")
#: Features of the span and its surroundings for the classifier, beside its kind.
FEATURES = ("long", "separated", "digits_around", "capital_before", "line_start", "line_end", "labelled", "quoted")
#: Rounds of expectation-maximisation and of the classifier's steps; prior share of personal data; penalty on weights.
EM_ROUNDS, FIT_ROUNDS, PRIOR, PENALTY = 30, 50, 0.5, 1e-3
#: A labeler is taken to be right this often before any data is seen, with the weight of so many votes.
ASSUMED, STRENGTH = 0.8, 20.0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass the Luhn test."""
    figures = F.transform(F.split(F.reverse(_digits(x)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(F.filter(figures, lambda c: c.isNotNull()), F.lit(0), lambda a, b: a + b) % 10 == 0


def _n_digits(x: Column) -> Column:
    return F.length(_digits(x))


def _strict(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(_n_digits(x).between(14, 19), luhn(x)).otherwise(False)
    if kind == "phone":
        return _n_digits(x).between(10, 15)
    return F.lit(True)


def running_sums(numbers: Column) -> Column:
    """Sums of an array up to each of its elements, by doubling: as many passes as the length has bits."""
    steps = F.when(F.size(numbers) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(numbers) - F.lit(0.5))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, numbers, lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, (i - F.pow(F.lit(2.0), k).cast("int")).cast("int")), F.lit(0).cast("long"))))


def located(text: Column, kind: str, pattern: str) -> Column:
    """Array of (start, end, kind, value, before, after) of all matches. The pieces between matches give
    the offsets, and what stands around a match, up to its neighbours of the same kind."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:string,value:string,before:string,after:string>>)")

    def place(found: Column, gaps: Column) -> Column:
        ends = running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, x: (F.length(gap) + F.length(x)).cast("long")))

        def span(e: Column, x: Column, i: Column) -> Column:
            before, after = F.substring(F.get(gaps, i), -CONTEXT, CONTEXT), F.substring(F.get(gaps, i + 1), 1, CONTEXT)
            return F.struct((F.get(e, i) - F.length(x)).cast("long").alias("start"), F.get(e, i).alias("end"), F.lit(kind).alias("kind"), x.alias("value"), before.alias("before"), after.alias("after"))

        return let(ends, lambda e: F.transform(found, lambda x, i: span(e, x, i)))

    def spans(found: Column) -> Column:
        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda gaps: place(found, gaps)))

    matches = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(text.rlike(_NEEDS[kind]), matches).otherwise(empty) if kind in _NEEDS else matches


def running_best(numbers: Column) -> Column:
    """The largest element of an array up to each of its elements, nulls left out, by doubling."""
    steps = F.when(F.size(numbers) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(numbers) - F.lit(0.5))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, numbers, lambda best, k: F.transform(best, lambda x, i: F.greatest(x, F.get(best, (i - F.pow(F.lit(2.0), k).cast("int")).cast("int")))))


def _untouched(found: Column, base: Column) -> Column:
    """The spans of ``found`` that no span of ``base`` touches. All are put in order of their starts; a
    span is touched if a strict one before it ends behind its start or the next one starts before its end."""

    def marked(spans: Column, strict: bool) -> Column:
        return F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), F.lit(strict).alias("strict"), x["end"].alias("end"), i.alias("i")))

    def of(every: Column) -> Column:
        def free(reach: Column, ahead: Column) -> Column:
            n = F.size(every)
            kept = F.transform(every, lambda x, i: F.struct(x.alias("x"), (~x["strict"] & (F.coalesce(F.get(reach, i), F.lit(-1)) <= x["start"]) & (F.coalesce(-F.get(ahead, n - 1 - i), F.lit(1 << 62)) >= x["end"])).alias("free")))
            return F.transform(F.filter(kept, lambda y: y["free"]), lambda y: F.get(found, y["x"]["i"]))

        reach = running_best(F.transform(every, lambda x: F.when(x["strict"], x["end"])))
        ahead = running_best(F.transform(F.reverse(every), lambda x: F.when(x["strict"], -x["start"])))
        return let(reach, lambda r: let(ahead, lambda a: free(r, a)))

    either = (F.size(found) == 0) | (F.size(base) == 0)
    return F.when(either, found).otherwise(let(F.array_sort(F.concat(marked(found, False), marked(base, True))), of))


def base_spans(text: Column) -> Column:
    """All strict spans that pass their tests, in text order, ties in the order of kinds."""
    return _in_order(_plain(F.concat(*(_passing(located(text, kind, pattern), kind) for kind, pattern in BASE.items()))))


def _passing(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _strict(kind, x["value"]))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def _in_order(spans: Column) -> Column:
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), _rank(x["kind"]).alias("rank"), x["end"].alias("end"), x.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))


def _any_word(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(r"(?i)(?<![\p{L}])(?:" + "|".join(words) + r")(?![\p{L}])")


def _iban(value: Column) -> Column:
    """Length by country and remainder 1 by 97, letters counting from 10 on."""
    plain = F.regexp_replace(value, r"\x20", "")
    right = F.lit(False)
    for country, n in IBAN_LENGTHS.items():
        right = F.when(plain.startswith(country), F.length(plain) == n).otherwise(right)
    figures = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    digit = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(figures, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(digit(c) > 9, a * 100 + digit(c)).otherwise(a * 10 + digit(c)) % 97)
    return F.when(right, rest == 1).otherwise(False)


def _shape(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "loose_phone", ~_digits(value).rlike(r"^(\d)\1*$"))
        .when(kind == "national_id", ~value.rlike(r"^(000|666|9\d\d)|-00-|-0000$"))
        .when(kind == "loose_card", luhn(value))
        .when(kind == "iban", _iban(value))
        .otherwise(F.lit(True))
    )


def feature_of(name: str, kind: Column, value: Column, before: Column, after: Column) -> Column:
    """One feature of a span or its surroundings, true or false."""
    patterns = {
        "digits_around": r"[0-9]\W{0,3}$", "capital_before": r"\p{Lu}\p{Ll}+\W{1,2}$", "line_start": r"(?:^|\n)[\x20\t]*$", "labelled": r"[:=]\s*$", "quoted": r"[\"'(<\[]$",
    }
    if name == "long":
        return F.length(value) > 14
    if name == "separated":
        return value.rlike(r"[\x20.()-]")
    if name == "line_end":
        return after.rlike(r"^[.,;]?[\x20\t]*(?:\n|$)")
    return before.rlike(patterns[name]) | (after.rlike(r"^\W{0,3}[0-9]") if name == "digits_around" else F.lit(False))


def vote_of(name: str, kind: Column, value: Column, before: Column, after: Column) -> Column:
    """The vote of one labeler: 1 for personal data, -1 against, 0 for no opinion."""
    if name == "shape":  # a checksum speaks for a candidate, any other shape only against it
        return F.when(~_shape(kind, value), -1).when(kind.isin("loose_card", "iban"), 1).otherwise(0)
    if name == "gazetteer":
        return F.when((kind == "name") & value.rlike(r"^(?:\p{L}+\.?\x20)?(?:" + "|".join(GIVEN) + r")(?!\p{L})"), 1).when((kind == "iban") & value.rlike("^(?:" + "|".join(IBAN_LENGTHS) + ")"), 1).otherwise(0)
    if name == "cue":
        cue = F.lit(False)
        for k, words in CUES.items():
            cue = F.when(kind == k, _any_word(before, words.split())).otherwise(cue)
        return F.when(cue, 1).otherwise(0)
    if name == "personal":
        return F.when(_any_word(before, PERSONAL.split()), 1).otherwise(0)
    numbered = r"(?i)(?:version|isbn|doi|page|no|nr|order|invoice|part)[\s.:#=]*$"
    return F.when(after.rlike(r"^\s*(?:%|kg|km|cm|mm|ms|px|€|\$|USD|EUR)") | before.rlike(numbered), -1).otherwise(0)


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]]) -> list[float]:
    """Posterior that a candidate of each vote pattern is personal data, by expectation-maximisation.

    A labeler is right with an unknown rate when it votes; abstentions say nothing. At most
    ``3 ** len(VOTES)`` patterns go in, however many candidates there are.
    """
    right, prior = [ASSUMED] * len(VOTES), PRIOR
    posterior: list[float] = []
    for _ in range(EM_ROUNDS):
        posterior = []
        for pattern, _n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(pattern, right, strict=True))
            posterior.append(1 / (1 + math.exp(-max(-60.0, min(60.0, odds)))))
        total = sum(n for _, n in patterns)
        prior = min(0.95, max(0.05, (PRIOR * STRENGTH + sum(p * n for p, (_, n) in zip(posterior, patterns, strict=True))) / (STRENGTH + total)))
        for k in range(len(VOTES)):
            good, cast = ASSUMED * STRENGTH, STRENGTH
            for p, (pattern, n) in zip(posterior, patterns, strict=True):
                if pattern[k]:
                    good, cast = good + n * (p if pattern[k] > 0 else 1 - p), cast + n
            right[k] = min(0.99, max(0.51, good / cast))
    return posterior


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], posterior: Sequence[float]) -> tuple[float, list[float]]:
    """Intercept and weights of a logistic classifier, fitted to the posteriors by Newton's steps with a
    small penalty. ``patterns`` are different inputs and how often each occurs."""
    x = np.array([(*p, 1) for p, _ in patterns], float)
    share = np.array([n for _, n in patterns], float)
    share /= share.sum()
    out = np.zeros(x.shape[1])
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        slope = x.T @ (share * (p - posterior)) + PENALTY * out
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(out))
        step = np.linalg.solve(bend, slope)
        out -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(out[-1]), out[:-1].tolist()


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, loose): strict spans, and loose candidates that no strict span touches, these with
    the text before and after them."""
    t = F.col("__text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("doc_id", base_spans(t).alias("base"), _in_order(F.concat(*(located(t, k, p) for k, p in LOOSE.items()))).alias("found"))
    return rows.select("doc_id", "base", _untouched(F.col("found"), F.col("base")).alias("loose"))


def _inputs(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """What the classifier sees of a candidate: votes, features, and which kind it is."""
    args = (kind, value, before, after)
    out = {v: vote_of(v, *args).cast("int") for v in VOTES}
    out |= {f: F.when(feature_of(f, *args), 1).otherwise(0) for f in FEATURES}
    return out | {f"is_{k}": F.when(kind == k, 1).otherwise(0) for k in LOOSE}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, base, spans) per input row; spans are (start, end, kind, value) in code points.

    ``base`` are the strict spans, ``spans`` these and the loose ones that the classifier accepts, by start,
    then in the order of kinds, then by end. Null and empty texts have none; a null doc_id stays null;
    repeated rows stay repeated and count as often in the statistics; other columns are ignored; an empty
    table gives no rows. All candidates of the table take part in the estimation. One pass over the
    texts, whole and in time near their length; the spans found are kept and the texts not read again.
    The only shuffle is the count of different inputs, of which there are at most some hundred thousand
    whatever the table's size; they are what the driver fits on.
    """
    rows = Scratch(docs.sparkSession, "pii").keep(candidates(docs, doc_id, text), "candidates")
    seen = rows.where(F.size("loose") > 0).select(F.explode("loose").alias("c")).select("c.*")
    seen = seen.select(*(x.alias(n) for n, x in _inputs(*map(F.col, ("kind", "value", "before", "after"))).items()))
    names = seen.columns
    counted = sorted(tuple(r) for r in seen.groupBy(*names).agg(F.count("*").alias("n")).collect())
    if not counted:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    votes: Counter[tuple[int, ...]] = Counter()
    for r in counted:
        votes[r[: len(VOTES)]] += r[-1]
    sure = dict(zip(votes, estimate(list(votes.items())), strict=True))
    bias, weights = fit([(r[:-1], r[-1]) for r in counted], [sure[r[: len(VOTES)]] for r in counted])
    return _accept(rows, bias, dict(zip(names, weights, strict=True)))


def _accept(rows: DataFrame, bias: float, weights: dict[str, float]) -> DataFrame:
    """The strict spans and the loose candidates with a score of zero or more."""

    def score(x: Column) -> Column:
        total = F.lit(bias)
        for name, value in _inputs(x["kind"], x["value"], x["before"], x["after"]).items():
            total = total + F.lit(weights[name]) * value
        return total

    accepted = F.filter("loose", lambda x: score(x) >= 0)
    return rows.select("doc_id", "base", _in_order(F.concat("base", _plain(accepted))).alias("spans"))


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
