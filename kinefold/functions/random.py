"""Deterministic draws: an integer congruential generator over key columns, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2_147_483_647


def draw_sql(seed: int, *keys: str) -> str:
    """A number in [0, 1) as SQL text, from integer key expressions."""
    state = f"CAST({seed + 1} AS BIGINT)"
    for key in (*keys, "7", "11"):
        state = f"(({state} * 48271 + 1 + (({key}) % 1000003 + 1000003)) % {MODULUS})"
    return f"(CAST({state} AS DOUBLE) / CAST({MODULUS} AS DOUBLE))"


def draw(seed: int, *keys: str) -> Column:
    """The same number as a column."""
    return F.expr(draw_sql(seed, *keys))
