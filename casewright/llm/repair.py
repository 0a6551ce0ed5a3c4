"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A conversation is well formed if the initials of its roles give ``(s?(ua)+)?``: perhaps a system row, then
user and assistant by turns, or nothing. Edits are keeping a row (0), giving it the role user or assistant
(1), deleting it (2, and blank or repeated rows have to go) and inserting an empty row of either role (5);
a truncated row that stays costs 5 more. Of all cheapest edits the one whose letters (D, I, K, R) are least
is taken.

The rows of a conversation and the four states of the pattern make a graph without cycles of no cost, whose
arcs are edits. An arc lies on a cheapest path, is tight, if the least cost before it, its own and the least
cost behind it add up to the whole. The path of least letters is walked from the start over tight arcs,
taking the least letter that leaves the frontier. (Letters fix the states: from each state only one role may
come next besides a kept s, so the frontier holds one state.)

No conversation has to fit into a task. All rows are put in order by ranges of (conv_id, turn), each stands in
a block of ``block`` neighbours, and the rows of one conversation in one block are a piece. A piece is boiled down
to sixteen numbers, the least costs between states, and one byte for each row; least costs before and behind
each piece are then carried along the pieces, four numbers at a time; pieces find their tight arcs by
themselves, for each state that they may be entered in; a last walk over the pieces tells which state that is.

Rows: nulls in role and text count as one space; rows without conv_id are one conversation. Rows of one turn
(nulls first) are ordered by the SHA-256 of role and text, so equal rows are interchangeable. Further columns
are ignored. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scratch import Scratch

BLOCK = 1024
RELABEL, DELETE, INSERT, LATE = 1, 2, 5, 5
SPACE = r"\x20\x09-\x0D"
#: The state an inserted or relabelled row leads to: nothing yet, after s, after u, after a.
NEXT = (2, 2, 3, 2)
ROLE = ("", "", "user", "assistant")
OTHER, SYSTEM, USER, ASSISTANT, GONE, CUT = 0, 1, 2, 3, 4, 8
NEVER = 1 << 40
#: What remains to be paid in each state behind the last row.
END = (0, 2 * INSERT, INSERT, 0)

_NUMBERS = pa.list_(pa.int64())
_PIECE = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("codes", pa.binary()), ("costs", _NUMBERS), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_AHEAD = pa.schema([*_PIECE, ("before", _NUMBERS)])
_BEHIND = pa.schema([*_AHEAD, ("behind", _NUMBERS), ("total", pa.int64()), ("last", pa.bool_())])
_WALKED = pa.schema([*(f for f in _PIECE if f.name != "costs"), ("total", pa.int64()), ("exits", _NUMBERS), ("letters", pa.list_(pa.string()))])
_CHOSEN = pa.schema([*(f for f in _WALKED if f.name not in ("exits", "letters")), ("entry", pa.int64()), ("audit", pa.string())])


@dataclass
class Repaired:
    """``report``: a row per conversation with conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``rows``: what the edits leave, with conv_id, place and step (their order), edit, role, text."""

    report: DataFrame
    rows: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """The damage that the query repairs, by ``crc32("conv_id:turn") % 20``; nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats
    it, 4 gives it the role user."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _cheaper(values, first) -> list[int]:
    """Costs of states once rows may be inserted: what ``first`` (forwards) or the rest (backwards) makes cheaper."""
    a, b, c, d = values
    if first:
        c = min(c, min(a, b, d) + INSERT)
        return [a, b, c, min(d, c + INSERT)]
    c = min(c, d + INSERT)
    return [min(a, c + INSERT), min(b, c + INSERT), c, min(d, c + INSERT)]


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """Letter, state before, state after and cost of the edits that take one row."""
    out = [("D", s, s, DELETE) for s in range(4)]
    if not code & GONE:
        late, kind = LATE if code & CUT else 0, code & 3
        kept = {SYSTEM: [(0, 1)], USER: [(0, 2), (1, 2), (3, 2)], ASSISTANT: [(2, 3)]}.get(kind, [])
        out += [("K", s, t, late) for s, t in kept] + [("R", s, NEXT[s], RELABEL + late) for s in range(4)]
    return out


_ARCS = [_arcs(code) for code in range(16)]


def _forward(values: list[int], code: int) -> list[int]:
    """Least costs behind a row from those before it, insertions before the row included."""
    values, out = _cheaper(values, True), [NEVER] * 4
    for _, s, t, cost in _ARCS[code]:
        out[t] = min(out[t], values[s] + cost)
    return out


def _backward(values: list[int], code: int) -> list[int]:
    out = [NEVER] * 4
    for _, s, t, cost in _ARCS[code]:
        out[s] = min(out[s], values[t] + cost)
    return _cheaper(out, False)


def _walk(codes: bytes, before: list[int], behind: list[int], total: int, last: bool) -> tuple[list[int], list[str]]:
    """For each state that a piece may be entered in: the state it is left in and the least letters; else -1, none."""
    ahead, rest = [_cheaper(before, True)], [behind]
    for code in codes:
        ahead.append(_cheaper(_forward(ahead[-1], code), True))
    for code in reversed(codes):
        rest.append(_backward(rest[-1], code))
    rest.reverse()
    exits, letters = [], []
    for entry in range(4):
        if before[entry] + rest[0][entry] != total:
            exits.append(-1)
            letters.append(None)
            continue
        place, frontier, taken = 0, {entry}, []
        cost = {entry: before[entry]}
        while True:
            best: str | None = None
            found: dict[int, int] = {}
            for s in frontier:
                tight = [("I", place, NEXT[s], INSERT)] if place < len(codes) or last else []
                if place < len(codes):
                    tight += [(letter, place + 1, t, c) for letter, a, t, c in _ARCS[codes[place]] if a == s]
                for letter, to, t, c in tight:
                    if ahead[place][s] == cost[s] and cost[s] + c + rest[to][t] == total and (best is None or letter <= best):
                        if letter != best:
                            best, found, step = letter, {}, to
                        found[t] = cost[s] + c
            if best is None:
                break
            place, frontier, cost = step, set(found), found
            taken.append(best)
        exits.append(min(frontier))
        letters.append("".join(taken))
    return exits, letters


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _dealt(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _illegal(a: int, b: int) -> bool:
    return (a & 3, b & 3) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _pieces(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, pos, turn, code, fault) in the order of pos, as pieces of one conversation and block."""

    def close(key, rows: list[dict]) -> dict:
        codes = bytes(r["code"] for r in rows)
        costs = []
        for entry in range(4):
            values = [NEVER] * 4
            values[entry] = 0
            for code in codes:
                values = _forward(values, code)
            costs += values
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        return {
            "conv_id": key[0], "at": rows[0]["pos"], "codes": codes, "costs": costs, "illegal": sum(map(_illegal, codes, codes[1:])),
            "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
        } | {name: sum(r["fault"] == k for r in rows) for k, name in enumerate(("blank", "duplicate", "truncated"), 1)}

    def run() -> Iterator[dict]:
        key, held = None, []
        for row in _rows(batches):
            at = row["conv_id"], row["pos"] // block
            if held and at != key:
                yield close(key, held)
                held = []
            key = at
            held.append(row)
        if held:
            yield close(key, held)

    return _dealt(run(), _PIECE)


def _multiplied(values: list[int], costs: list[int]) -> list[int]:
    return [min(values[s] + costs[4 * s + t] for s in range(4)) for t in range(4)]


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, each with the least costs before it; a turn or a pair of rows over two pieces counted once."""

    def run() -> Iterator[dict]:
        held: dict | None = None
        for row in _rows(batches):
            if held is None or held["conv_id"] != row["conv_id"]:
                values, high = [0, NEVER, NEVER, NEVER], None
            else:
                row["illegal"] += _illegal(held["codes"][-1], row["codes"][0])
                row["turns"] -= row["low"] is not None and row["low"] == high
            held, high = row, row["high"] if row["high"] is not None else high
            yield row | {"before": values}
            values = _multiplied(values, row["costs"])

    return _dealt(run(), _AHEAD)


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the last to the first, each with the least costs behind it and those of the whole."""

    def run() -> Iterator[dict]:
        conv, begun = None, False
        for row in _rows(batches):
            last = not begun or conv != row["conv_id"]
            if last:
                conv, begun, values = row["conv_id"], True, list(END)
                total = min(map(sum, zip(_multiplied(row["before"], row["costs"]), values, strict=True)))
            yield row | {"behind": values, "total": total, "last": last}
            values = _cheaper([min(row["costs"][4 * s + t] + values[t] for t in range(4)) for s in range(4)], False)

    return _dealt(run(), _BEHIND)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[dict]:
        for row in _rows(batches):
            exits, letters = _walk(row["codes"], row["before"], row["behind"], row["total"], row["last"])
            yield {k: row[k] for k in _WALKED.names if k in row} | {"exits": exits, "letters": letters}

    return _dealt(run(), _WALKED)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[dict]:
        conv, begun, state = None, False, 0
        for row in _rows(batches):
            if not begun or conv != row["conv_id"]:
                conv, begun, state = row["conv_id"], True, 0
            yield {k: row[k] for k in _CHOSEN.names if k in row} | {"entry": state, "audit": row["letters"][state]}
            state = row["exits"][state]

    return _dealt(run(), _CHOSEN)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", _NUMBERS: "array<long>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


_STEP = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("step", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("given", pa.string())])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits that leave a row, with the place of the row they take and the role they give."""

    def run() -> Iterator[dict]:
        for row in _rows(batches):
            pos, state = row["at"], row["entry"]
            for k, letter in enumerate(row["audit"]):
                if letter != "D":
                    kept_system = letter == "K" and state == 0 and row["codes"][pos - row["at"]] & 3 == SYSTEM
                    state = 1 if kept_system else NEXT[state]
                    yield {"conv_id": row["conv_id"], "place": row["at"], "step": k, "pos": None if letter == "I" else pos, "edit": letter, "given": None if letter == "K" else ROLE[state]}
                pos += letter != "I"

    return _dealt(run(), _STEP)


def repair(rows: DataFrame, block: int = BLOCK) -> Repaired:
    """Repair every conversation of ``rows`` (conv_id, turn, role, text)."""
    scratch = Scratch(rows.sparkSession, "repair")
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), F.monotonically_increasing_id().alias("id"))
    plain = plain.withColumn("same", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    order = ["conv_id", "turn", "same", "id"]
    tail = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    fault = F.when(tail == "", 1).when(~tail.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    ordered = plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    ordered = scratch.keep(ordered.select("conv_id", "turn", "role", "text", "same", "pos", code.alias("code"), fault.alias("fault")), "ordered")

    seen = ordered.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("of"), "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    slim = ordered.select("conv_id", "turn", "pos", "code", "fault", "same", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("of")).join(seen, ["of", "same"], "left")
    first_fault = F.when(F.col("fault") == 1, 1).when(F.col("first") < F.col("pos"), 2).otherwise(F.col("fault"))
    slim = slim.select("conv_id", "turn", "pos", "code", first_fault.alias("fault")).withColumn("code", (F.col("code") + F.when(F.col("fault").isin(1, 2), GONE).when(F.col("fault") == 3, CUT).otherwise(0)).cast("int"))

    pieces = slim.repartition(F.floor(F.col("pos") / block)).sortWithinPartitions("pos").mapInArrow(partial(_pieces, block), _ddl(_PIECE))
    carried = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_ahead, _ddl(_AHEAD)).sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(_behind, _ddl(_BEHIND))
    walked = carried.repartition("conv_id", "at").mapInArrow(_walked, _ddl(_WALKED))
    chosen = scratch.keep(walked.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_chosen, _ddl(_CHOSEN)), "chosen")

    total = lambda name: F.sum(name).alias(name)
    report = chosen.groupBy("conv_id").agg(
        (F.max("high") - F.min("low") + 1 - F.sum("turns")).alias("gaps"), *map(total, ("blank", "duplicate", "truncated", "illegal")), F.max("total").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    ).withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    return Repaired(report, _left(ordered, chosen))


def _left(ordered: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired rows: what the edits of all pieces leave, joined with the rows they take."""
    steps = chosen.mapInArrow(_steps, _ddl(_STEP))
    taken = ordered.select("pos", F.col("role").alias("had"), "text")
    role, text = F.coalesce("given", "had"), F.coalesce("text", F.lit(""))
    return steps.join(taken, "pos", "left").select("conv_id", "place", "step", "edit", role.alias("role"), text.alias("text"))


_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[dict]:
        conv, state = None, None
        for row in _rows(batches):
            if state is None or conv != row["conv_id"]:
                if state is not None:
                    yield {"conv_id": conv, "repaired_sha256": state.hexdigest()}
                conv, state = row["conv_id"], hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{row['role']}:{row['text']}".encode())
        if state is not None:
            yield {"conv_id": conv, "repaired_sha256": state.hexdigest()}

    return _dealt(run(), _DIGEST)


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, ``role:text`` joined by newlines, in one pass over its sorted rows."""
    ordered = rows.select("conv_id", "place", "step", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return ordered.mapInArrow(_digests, _ddl(_DIGEST))


def audited(conversations: DataFrame) -> DataFrame:
    """The reports and digests of all ``conversations`` after ``damage``; zeros and nothing where no row is left."""
    found = repair(damage(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = every["conv_id"].eqNullSafe
    report, digest = found.report.withColumnRenamed("conv_id", "of"), digests(found.rows).withColumnRenamed("conv_id", "of")
    joined = every.join(report, same(report["of"]), "left").drop("of").join(digest, same(digest["of"]), "left").drop("of")
    numbers = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
