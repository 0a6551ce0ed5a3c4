"""Near 64-bit hashes by an index of pieces.

Hashes are cut into a few pieces. If two hashes differ in ``near`` bits at most, one of their pieces differs in
few: with ``near = a * m + b`` over m pieces, one of the first b + 1 in a bits at most, or one of the others in
a - 1. Stored hashes are entered under their pieces as they are, m rows each; a query asks for its own pieces
and all that are as near as that. The more hashes are stored, the longer the pieces are, so that few of them
share one by chance: the number of pieces is the one for which asking and comparing cost least together.
Exact for any number of hashes.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let

BITS = 64


def _ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def _cut(near: int, m: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of the pieces that have to be asked for, if there are ``m``."""
    a, b = divmod(near, m)
    cuts = [BITS * k // m for k in range(m + 1)]
    radii = [a if k <= b else a - 1 for k in range(m)]
    return [(low, high - low, r) for low, high, r in zip(cuts, cuts[1:], radii) if r >= 0]


def cost(n: int, pieces: list[tuple[int, int, int]]) -> float:
    """Rows asked for and hashes compared for one query among ``n`` hashes that are spread evenly."""
    return sum(_ball(bits, radius) * (1 + n / 2**bits) for _, bits, radius in pieces)


def pieces(n: int, near: int) -> list[tuple[int, int, int]]:
    """The cheapest cut for ``n`` stored hashes."""
    return min((_cut(near, m) for m in range(1, near + 2)), key=lambda p: cost(n, p))


def number(hex_text: Column) -> Column:
    """A hash of sixteen hex digits as a signed number; null for anything else."""
    return F.when(hex_text.rlike("^[0-9a-fA-F]{16}$"), F.conv(hex_text, 16, -10).cast("long"))


def _piece(value: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1 if bits < BITS else -1))


def _around(value: Column, bits: int, radius: int) -> Column:
    """All numbers of ``bits`` bits that differ from ``value`` in ``radius`` of them at most."""

    def further(level: Column) -> Column:
        rest = lambda x: F.when(x["last"] < bits - 1, F.sequence(x["last"] + 1, F.lit(bits - 1))).otherwise(F.array().cast("array<int>"))
        # a bit is flipped behind the last one that was, so each number comes once
        return F.flatten(F.transform(level, lambda x: F.transform(rest(x), lambda k: F.struct(x["v"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)).alias("v"), k.alias("last")))))

    def levels(level: Column, left: int) -> Column:
        return level if left == 0 else let(further(level), lambda x: F.concat(level, levels(x, left - 1)))

    start = F.array(F.struct(value.alias("v"), F.lit(-1).alias("last")))
    return F.transform(levels(start, radius), lambda x: x["v"])


def entered(df: DataFrame, column: str, cut: list[tuple[int, int, int]]) -> DataFrame:
    """``df`` with a row for every piece of ``column``: ``which`` piece, and its ``value``."""
    values = F.array(*(_piece(F.col(column), shift, bits) for shift, bits, _ in cut))
    return df.select("*", F.posexplode(values).alias("which", "value"))


def asking(df: DataFrame, column: str, cut: list[tuple[int, int, int]]) -> DataFrame:
    """``df`` with a row for every piece that a near hash may have: ``which`` piece, and the ``value``."""
    near = F.array(*(_around(_piece(F.col(column), shift, bits), bits, radius) for shift, bits, radius in cut))
    return df.select("*", F.posexplode(near).alias("which", "__values")).select("*", F.explode("__values").alias("value")).drop("__values")
