"""Conversation repair against a plain search over all edits, in one piece and in many."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from casewright.llm import repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def plain_audit(rows):
    """(cost, audit, repaired texts) of rows (initial, fault, role, text), by trying every edit."""

    @cache
    def best(i, state):
        if i == len(rows):
            return min([(0, "")] * (state in ("", "a")) + [(5 + (5 if state == "s" else 0), "II" if state == "s" else "I")] * (state in ("s", "u")))
        initial, fault = rows[i][:2]
        found = []
        # at most two insertions before a row are ever worth while
        for inserted in range(3):
            at = state
            for _ in range(inserted):
                at = NEXT[at]
            head, cost = "I" * inserted, 5 * inserted
            edits = [("D", at, 2)]
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                if initial == NEXT[at] or (initial == "s" and at == ""):
                    edits.append(("K", initial, late))
                edits.append(("R", NEXT[at], 1 + late))
            for letter, to, price in edits:
                rest = best(i + 1, to)
                found.append((cost + price + rest[0], head + letter + rest[1]))
        return min(found)

    cost, audit = best(0, "")
    out, i, state = [], 0, ""
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append(f"{NAME[state]}:")
            continue
        if letter == "K":
            state = rows[i][0]
            out.append(f"{rows[i][2]}:{rows[i][3]}")
        elif letter == "R":
            state = NEXT[state]
            out.append(f"{NAME[state]}:{rows[i][3]}")
        i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return cost, audit, "\n".join(out)


def plain_report(rows):
    """The report of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, faulty = set(), []
    for _, role, text in rows:
        tail = re.sub(r"[ \t\n\v\f\r]", "", text)[-1:]
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role[:1], fault, role, text))
    cost, audit, repaired = plain_audit(tuple(faulty)) if rows else (0, "", "")
    turns = {t for t, _, _ in rows if t is not None}
    count = lambda name: sum(f[1] == name for f in faulty)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()


def some_rows(seed, conversations, most):
    draw = random.Random(seed)
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "sys"], ["Yes.", "No!", "And", " ", "", None, "Why? \n", "a.b", "Öl.", "x" * 3000]
    return [(c, draw.choice([None, *range(6)]), draw.choice(roles), draw.choice(texts)) for c in [None, 1 << 60, *range(conversations)] for _ in range(draw.randrange(most + 1))]


@pytest.mark.parametrize("block", [3, repair.BLOCK])
def test_equals_a_plain_search(spark, block):
    rows = some_rows(block, 60, 9) + [(7_000, k % 40, draw, f"{k}{'.' * (k % 3)}") for k, draw in enumerate(random.Random(1).choices(["system", "user", "assistant"], k=80))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "2 AS code", "3 AS same", "4 AS at")
    found = repair.repair(table, block)
    digest = {r.conv_id: r.repaired_sha256 for r in repair.digests(found.rows).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv_id, hashlib.sha256().hexdigest())) for r in found.report.collect()}
    want = {c: plain_report([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    kept = found.rows.where("conv_id = 7000").collect()
    assert {r.edit for r in kept} <= {"K", "R", "I"} and len(kept) == sum(x != "D" for x in got[7_000][6])


def test_damage_and_lost_conversations(spark):
    rows = some_rows(5, 80, 4)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = lambda x: " " if x is None else str(x)
    left = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        harm = zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        left[c] += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.audited(table).collect()}
    assert got == {c: plain_report(x) for c, x in left.items()} and any(not x for x in left.values())


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.audited(none).collect() == [] and repair.repair(none).rows.collect() == []
