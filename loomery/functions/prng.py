"""A stateless generator in BIGINT arithmetic: the same draw for the same (seed, row, draw), however data are split.

With M = 2**31 - 1 and p5(h) = h**5 mod M (a permutation, as 5 and M - 1 have no common factor), a draw is
p5(p5(mix(seed, row, draw)) + shift(draw)). No product passes 2**62, so ANSI overflow cannot occur. ``seed`` and
``row`` must be below 2**31.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = 2147483647


def _p5(h):
    square = (h * h) % M
    return ((square * square) % M) * h % M


def with_draws(df: DataFrame, row: str, seed: int | Column, draws: dict[str, int]) -> DataFrame:
    """Adds a long column in [0, M) per name in ``draws``; each stage is a projection of its own to stay small."""
    r = F.col(row).cast("long")
    df = df.withColumns({f"_h_{n}": (F.lit(seed).cast("long") * 7919 + 1 + r * 48271 + F.lit(d * 69621).cast("long")) % M for n, d in draws.items()})
    df = df.withColumns({f"_h_{n}": _p5(F.col(f"_h_{n}")) for n in draws})
    df = df.withColumns({f"_h_{n}": (F.col(f"_h_{n}") + (d * 16807 + 11)) % M for n, d in draws.items()})
    return df.withColumns({n: _p5(F.col(f"_h_{n}")) for n in draws}).drop(*(f"_h_{n}" for n in draws))


def draws_of(rows, seed: int, draw: int):
    """The draws of :func:`with_draws` for whole numbers, or arrays of them (of 64 bits)."""
    return (_p5((_p5((seed * 7919 + 1 + rows * 48271 + draw * 69621) % M) + draw * 16807 + 11) % M)) % M


def unit(draw):
    """A draw as a double in [0, 1)."""
    return draw / F.lit(float(M))


def sql_draw(row: str, seed: int, draw: int) -> str:
    """The same draw as a DuckDB expression without subqueries."""
    h = f"((CAST({seed} AS BIGINT) * 7919 + ({row}) * 48271 + {draw} * 69621 + 1) % {M})"
    p5 = lambda x: f"list_transform([{x}], lambda h: (((h*h) % {M}) * ((h*h) % {M}) % {M}) * h % {M})[1]"
    return p5(f"({p5(h)} + {draw * 16807 + 11}) % {M}")
