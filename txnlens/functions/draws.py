"""Repeatable draws: a random number that depends only on a seed and key columns.

The same key always draws the same number, whatever the partitioning and however often a lost
task is run again. Draws are built as SQL text, one expression each, since they are used by the
dozen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(seed: str, keys: tuple[str, ...]) -> str:
    """A 48-bit number: 12 hex digits of a digest, exact in a double."""
    text = f"concat_ws('|', '{seed}', {', '.join(keys)})"
    return f"cast(conv(substr(md5({text}), 1, 12), 16, 10) as bigint)"


def _unit(seed: str, keys: tuple[str, ...]) -> str:
    return f"({_number(seed, keys)} / {float(2**48)!r}D)"


def _literal(value: str | int | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def values_array(values: list) -> Column:
    return F.expr(f"array({', '.join(map(_literal, values))})")


def hash_number(seed: str, *keys: str) -> Column:
    """A whole number in [0, 2^48)."""
    return F.expr(_number(seed, keys))


def draw(seed: str, *keys: str) -> Column:
    """A number in [0, 1)."""
    return F.expr(_unit(seed, keys))


def between(seed: str, low: float, high: float, *keys: str) -> Column:
    """A number in [low, high)."""
    return F.expr(f"{low!r}D + {_unit(seed, keys)} * {high - low!r}D")


def whole(seed: str, low: int, high: int, *keys: str) -> Column:
    """A whole number from low to high, both included."""
    return F.expr(f"cast({low} + floor({_unit(seed, keys)} * {high - low + 1}) as int)")


def pick(values: list, seed: str, *keys: str) -> Column:
    """One of the values, all equally likely."""
    place = F.expr(f"cast(floor({_unit(seed, keys)} * {len(values)}) as int) + 1")
    return F.element_at(values_array(values), place)


def weighted_pick(weights: dict[str, float], seed: str, *keys: str) -> Column:
    """One of the values by its weight; weights need not add up to 1."""
    reach = f"{_unit(seed, keys)} * {_literal(float(sum(weights.values())))}"
    running, cases = 0.0, []
    *head, last = weights
    for value in head:
        running += weights[value]
        cases.append(f"when {reach} < {_literal(running)} then {_literal(value)}")
    return F.expr(f"case {' '.join(cases)} else {_literal(last)} end" if cases else _literal(last))


def digits(seed: str, count: int, *keys: str) -> Column:
    """A string of random digits with leading zeros kept."""
    return F.expr(f"lpad(cast({_number(seed, keys)} % {10**count} as string), {count}, '0')")


def account_number(seed: str, *keys: str) -> Column:
    return F.concat(F.lit("ACCT"), digits(seed, 8, *keys))


def phone_number(seed: str, *keys: str) -> Column:
    return F.concat(F.lit("+1"), digits(seed, 10, *keys))


def trait(name: str, bounds: tuple[float, float], places: int, *keys: str) -> Column:
    """A sticky attribute: the same key always has the same rounded value."""
    return F.round(between(f"trait-{name}", *bounds, *keys), places)
