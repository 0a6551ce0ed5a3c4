"""Secret scans by assignment-aware lexing.

Fixed patterns give the base spans. Beside them each line is lexed as source or configuration text:
statements become (target name, operands) pairs, a name inside an indented or bracketed block carries the
names of the blocks around it, names that stand for constants are replaced by the literals they were
given anywhere in the document, and every literal is scored by how sensitive its targets' names are and
how much it looks like a credential rather than a placeholder.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import accumulate
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The base patterns and the smallest length of what must be long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")

# Words of target names. Pairs are words that must both occur.
STRONG = frozenset("password passwd passphrase pwd secret token apikey credential credentials".split())
STRONG_PAIRS = tuple(frozenset(x.split()) for x in ("api key", "private key", "access key", "signing key", "encryption key", "auth key", "connection string"))
WEAK = frozenset("auth key pass salt pin".split())
HARMLESS = frozenset("id name url uri path file count length size type field label placeholder prompt hint expires expiry max min limit regex pattern policy reset page".split())
_TELLING = STRONG.union(*STRONG_PAIRS, WEAK, HARMLESS)
CUES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "salt", "pin", "connection")
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|changeme|change[_-]?me|example.*|placeholder|your[_-].*|todo|none|null|true|false|undefined|test|dummy|default|\$\{.*\}|\$\(.*\)|<.*>|%.*%|\{\{.*\}\})$")
THRESHOLD = 0.6

_QUOTED = {'"': r'"(?:[^"\\]|\\.)*+"', "'": r"'(?:[^'\\]|\\.)*+'", "`": r"`[^`]*+`"}
_CONFIG = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)[ \t]*[:=][ \t]*(?P<bare>[^\s\"'`;,]+)[;,]?[ \t]*$", re.MULTILINE)
_STATEMENT = re.compile(r"^.*[=:<].*$", re.MULTILINE)
@lru_cache(maxsize=8)
def _token(unclosed: frozenset[str]) -> re.Pattern:
    quoted = "|".join(x for q, x in _QUOTED.items() if q not in unclosed) or "(?!)"
    return re.compile(rf"""(?P<text>{quoted})|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)|(?P<op>:=|=>|<-|==|!=|<=|>=|[=:+\[\]])|(?P<other>\S)""")


_OPENING = re.compile(r"""^([ \t]*)(?:-[ \t]+)?["']?([A-Za-z_][A-Za-z0-9_.-]*)["']?[ \t]*[:=]?[ \t]*[:={\[][ \t]*$""", re.MULTILINE)
_INDENT = re.compile(r"[ \t]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ASSIGNS = frozenset((":=", "=>", "<-", "=", ":"))


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


class Literal(NamedTuple):
    start: int
    end: int
    value: str


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    lowered = text.lower()
    if any(x in lowered for x in ASSIGN_WORDS):
        out += [Span("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [Span("access", *m.span(), 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return out + [Span("hex", *m.span(), 1.0) for m in HEX.finditer(text)]


def words_of(name: str) -> frozenset[str]:
    """The words of a name that tell whether it is sensitive, plurals as singulars too."""
    words = {x.lower() for x in _WORDS.findall(name)}
    return _TELLING & (words | {x[:-1] for x in words if x.endswith("s")})


def words_score(words: frozenset[str]) -> float:
    """How sensitive a target of these words is, 0 to 1."""
    if words & STRONG or any(pair <= words for pair in STRONG_PAIRS):
        score = 1.0
    elif words & WEAK:
        score = 0.5
    else:
        return 0.0
    return score * (0.3 if words & HARMLESS else 1.0)


def name_score(name: str) -> float:
    """How sensitive a target of this name is, 0 to 1."""
    return words_score(words_of(name))


def literal_score(value: str) -> float:
    """How much a literal looks like a credential, 0 to 1."""
    if len(value) < MIN_ASSIGN or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    mixed = any(x.isdigit() for x in value) and any(x.isalpha() for x in value)
    return 0.5 + 0.25 * mixed + 0.25 * (entropy >= 3) - 0.5 * any(x.isspace() for x in value)


def blocks(text: str) -> list[tuple[int, int, frozenset[str]]]:
    """(start, end, words) of the blocks that a line ``name:``, ``name = {`` or the like opens: up to the
    next line that holds something and is indented no further. Inner blocks come after those around them
    and carry their words too."""
    opened = {m.start(): (len(m[1]), m[2]) for m in _OPENING.finditer(text)}
    out: list[tuple[int, int, frozenset[str]]] = []
    stack: list[tuple[int, int]] = []  # indentation and place in ``out``
    at = min(opened, default=len(text))
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        indent = _INDENT.match(text, at, end).end() - at
        if at + indent < end:
            while stack and stack[-1][0] >= indent:
                start, _, words = out[place := stack.pop()[1]]
                out[place] = (start, at, words)
            if at in opened:
                words = words_of(opened[at][1]) | (out[stack[-1][1]][2] if stack else frozenset())
                stack.append((indent, len(out)))
                out.append((end, len(text), words))
        at = end + 1
    return out


def tokens_of(text: str, start: int, end: int) -> list[tuple[str, str, int, int]]:
    """(kind, token, start, end) of a line. Where a quote is not closed, no later one of its kind is."""
    out, unclosed = [], frozenset()
    while start < end:
        for m in _token(unclosed).finditer(text, start, end):
            out.append((m.lastgroup, m[0], m.start(), m.end()))
            start = m.end()
            if m.lastgroup == "other" and m[0] in _QUOTED and m[0] not in unclosed:
                unclosed |= {m[0]}
                break
        else:
            break
    return out


def statements(text: str) -> Iterator[tuple[int, str, list[Literal | str]]]:
    """(place, target name, operands) of every assignment; an operand is a literal or the name of a constant."""
    for line in _STATEMENT.finditer(text):
        tokens = tokens_of(text, *line.span())
        for k in range(1, len(tokens) - 1):
            if tokens[k][1] not in _ASSIGNS or tokens[k][0] != "op":
                continue
            left = k - 1
            if tokens[left][1] == "]" and left >= 2:  # config["name"] = ...
                left -= 1
            kind, shown, _, _ = tokens[left]
            if kind not in ("name", "text"):
                continue
            target = shown.strip("\"'`")
            if tokens[k][1] == "=" and left >= 2 and tokens[left - 1][1] == ":" and tokens[left - 2][0] == "name":
                target = tokens[left - 2][1]  # name: type = ...
            operands: list[Literal | str] = []
            at = k + 1
            while at < len(tokens):
                kind, shown, start, end = tokens[at]
                if kind == "text":
                    operands.append(Literal(start + 1, end - 1, shown[1:-1]))
                elif kind == "name":
                    operands.append(shown)
                else:
                    break
                if at + 1 >= len(tokens) or tokens[at + 1][1] != "+":
                    break
                at += 2
            if operands:
                yield line.start(), target, operands
    for m in _CONFIG.finditer(text):
        yield m.start(), m["name"], [Literal(*m.span("bare"), m["bare"])]


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants.

    The most sensitive names are followed first, so every name is followed once, with its best weight.
    """
    lowered = text.lower()
    if not any(x in lowered for x in CUES):  # no name that scores is without one of these
        return []
    given: dict[str | tuple[int, str], list[Literal | str]] = defaultdict(list)
    weights: dict[str | tuple[int, str], float] = {}
    around, inside = blocks(text)[::-1], []
    for place, name, operands in sorted(statements(text), key=lambda x: x[0]):
        while around and around[-1][0] <= place:
            inside.append(around.pop())
        while inside and inside[-1][1] <= place:
            inside.pop()
        given[name] += operands
        if weight := name_score(name):
            weights[name] = weight
        if inside and (outer := words_score(words_of(name) | inside[-1][2])) > weight:
            # only what is given here stands in the block; the name may mean something else elsewhere
            given[place, name] += operands
            weights[place, name] = outer
    best: dict[Literal, float] = {}
    seen = set()
    for target, weight in sorted(weights.items(), key=lambda x: -x[1]):
        queue = [target]
        while queue:
            name = queue.pop()
            if name in seen:
                continue
            seen.add(name)
            for x in given.get(name, ()):
                if isinstance(x, Literal):
                    best[x] = max(best.get(x, 0.0), weight * literal_score(x.value))
                else:
                    queue.append(x)
    return [Span("literal", x.start, x.end, score) for x, score in best.items() if score >= THRESHOLD]


def find_spans(text: str) -> list[Span]:
    """Base spans and the literals that no base span covers, by start, then kind."""
    base = sorted(base_spans(text), key=lambda x: x.start)
    more = literal_spans(text)
    if more:
        starts, reach = [x.start for x in base], [0, *accumulate((x.end for x in base), max)]
        more = [x for x in more if reach[bisect_right(starts, x.start)] < x.end]
    return sorted(base + more, key=lambda x: (x.start, KINDS.index(x.kind), x.end))


def masked(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with the union of the spans replaced by ``mark``, one for each stretch."""
    out, at = [], 0
    stretches: list[list[int]] = []
    for x in sorted(spans, key=lambda x: x.start):
        if stretches and x.start <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], x.end)
        else:
            stretches.append([x.start, x.end])
    for start, end in stretches:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, spans) per input row; offsets count code points, ends are exclusive.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows stay repeated; other
    columns are ignored; an empty table gives no rows. Spans that start together stand in the order of
    their kinds. Whole texts, however long, in one pass without a shuffle and in time near their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x._asdict() for x in find_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def mask_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in its column ``text`` masked; nulls stay null, all columns stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            held = batch.column(at).to_pylist()
            clean = pa.array([x and masked(x, find_spans(x)) for x in held], pa.string())
            yield pa.RecordBatch.from_arrays([clean if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
