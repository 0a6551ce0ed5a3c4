"""Cutting texts into pieces that a byte-level BPE encodes independently, with a bounded memo.

A single space between two non-space characters always starts a new pre-token, and a lone line break
between two non-space characters is a pre-token of its own. Texts without two adjacent white-space
characters are therefore cut at spaces and line breaks with plain string splits; any other text is cut
only at the spaces that are safe. Equal pieces are then encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

_ADJACENT = re.compile(r"\s\s")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_MEMO_PIECE = 64


def cut(text: str) -> list[list[str]]:
    """Lines of pieces. The first piece of a line stands bare, the others follow a space; lines are
    joined by a line break."""
    if text and not text[0].isspace() and not text[-1].isspace() and not _ADJACENT.search(text):
        return [line.split(" ") for line in text.split("\n")]
    return [_SAFE_SPACE.split(text)]


class PieceCoder:
    """Encodes texts piece by piece.

    ``encode_many`` turns strings into the bytes of their ids. The memo holds at most ``limit`` pieces
    and is emptied when full, so memory stays bounded however many different words there are. The cuts
    hold for one pre-token pattern; with another, ``cutting`` must be off and texts are encoded whole.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 150_000, cutting: bool = True):
        self._encode_many, self._limit, self._cutting = encode_many, limit, cutting
        self._heads: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {}
        self._break = encode_many(["\n"])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; ``texts`` should be a few MB together (see ``in_small_lots``)."""
        cuts = [cut(x) if self._cutting else [[x]] for x in texts]
        heads, tails = set(), set()
        for lines in cuts:
            for line in lines:
                heads.add(line[0])
                tails.update(islice(line, 1, None))
        if len(self._heads) + len(self._tails) > self._limit:
            self._heads.clear()
            self._tails.clear()
        long_ones = self._learn(self._heads, heads - self._heads.keys(), "")
        long_ones += self._learn(self._tails, tails - self._tails.keys(), " ")
        out = []
        head, tail = self._heads, self._tails.__getitem__
        for lines in cuts:
            parts: list[bytes] = []
            for k, line in enumerate(lines):
                if k:
                    parts.append(self._break)
                parts.append(head[line[0]])
                parts.extend(map(tail, islice(line, 1, None)))
            out.append(b"".join(parts))
        for memo, piece in long_ones:
            memo.pop(piece, None)
        return out

    def _learn(self, memo: dict[str, bytes], new: set[str], before: str) -> list[tuple[dict[str, bytes], str]]:
        fresh = list(new)
        memo.update(zip(fresh, self._encode_many([before + x if x or before else "" for x in fresh]), strict=True))
        return [(memo, x) for x in fresh if len(x) > _MEMO_PIECE]


def in_small_lots(texts: list, chars: int = 1_000_000, sizes: bool = False) -> Iterator[slice]:
    """Consecutive slices of ``texts`` (or of their sizes) of about ``chars`` each, at least one text."""
    start = held = 0
    for k, x in enumerate(texts):
        n = x if sizes else len(x)
        if held and held + n > chars:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))
