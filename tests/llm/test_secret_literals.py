"""Literals in blocks and through long chains of constants, and the time that large texts take."""

import random
import time

import pytest

from casewright.llm import secret_scan as S


def literals(text):
    return [text[x.start : x.end] for x in S.find_spans(text) if x.kind == "literal"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("secrets:\n  db: hunter2xyz\n  retries: 3\nname: hunter2xyz9\n", ["hunter2xyz"]),
        ('{\n  "credentials": {\n    "db": {\n      "value": "q1w2e3r4"\n    }\n  },\n  "title": "q1w2e3r4t5"\n}', ["q1w2e3r4"]),
        ("credentials = {\n  main = 'zz99yy88'\n  url = 'https://x9.example'\n}\n", ["zz99yy88"]),
        ("secrets:\n\n\n  a: abc123def\n", ["abc123def"]),
        ("paths:\n  db: hunter2xyz\n", []),
        ("the secret:\nnothing = 'abc123def'\n", []),
        ("private:\n  key: abcd1234efgh\n", ["abcd1234efgh"]),
    ],
)
def test_blocks_lend_their_names(text, want):
    assert literals(text) == want


def closure(text):
    """Every target followed by itself, name by name."""
    given = {}
    for _, name, operands in S.statements(text):
        given.setdefault(name, []).extend(operands)
    best = {}
    for target in given:
        queue, seen = list(given[target]), {target}
        while queue:
            x = queue.pop()
            if isinstance(x, S.Literal):
                best[x] = max(best.get(x, 0), S.name_score(target) * S.literal_score(x.value))
            elif x not in seen:
                seen.add(x)
                queue += given.get(x, [])
    return {(x.start, x.end) for x, score in best.items() if score >= S.THRESHOLD}


def test_constants_by_brute_force():
    rng = random.Random(2)
    names = ["a", "b", "c", "d", "my_password", "auth_salt", "token_count", "x1", "x2"]
    for _ in range(200):
        lines = []
        for _ in range(rng.randint(1, 12)):
            target = rng.choice(names)
            lines.append(f"{target} = " + (f'"{rng.getrandbits(48):x}zk"' if rng.random() < 0.4 else " + ".join(rng.choice(names) for _ in range(rng.randint(1, 3)))))
        text = "\n".join(lines)
        assert {(x.start, x.end) for x in S.literal_spans(text)} == closure(text)


@pytest.mark.parametrize(
    "text",
    [
        "".join(f"password_{k} = k{k}\nk{k} = k{k + 1}\n" for k in range(20_000)) + 'k20000 = "s3cr3tValue9"',
        "password = " + "a + " * 100_000 + '"s3cr3tValue9"',
        "".join(f"{' ' * (k % 50)}secret{k}:\n" for k in range(50_000)),
        "\n".join(f'pwd{k} = "s3cr3tValue{k}" ; token=abcdef{k}' for k in range(20_000)),
        "secret: " + '"' * 300_000, "my_secret = '" + "\\'" * 200_000,
    ],
)
def test_long_texts_take_time_near_their_length(text):
    start = time.process_time()
    S.find_spans(text)
    assert time.process_time() - start < 20


def test_every_scoring_name_holds_a_cue():
    assert all(any(c in w for c in S.CUES) for w in S.STRONG | S.WEAK) and all(any(c in w for w in pair for c in S.CUES) for pair in S.STRONG_PAIRS)
