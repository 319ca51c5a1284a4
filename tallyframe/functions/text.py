"""Small string expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Drop all leading and trailing white space, not blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (strip(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.when(~blank(c), c)


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def token_sort(c: Column) -> Column:
    """White-space separated tokens in code-point order, joined by one blank."""
    return F.array_join(F.array_sort(F.split(collapse(c), " ")), " ")


def or_none(c: Column) -> Column:
    """Text of a value as it appears inside explanations: nulls read `None`."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Constant map lookup; null where the key is absent."""
    if not table:
        return F.lit(None).cast("string")
    entries = ", ".join(_literal(x) for pair in table.items() for x in pair)
    return F.try_element_at(F.expr(f"map({entries})"), key)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_UNIT = 1 << 52  # a double below 1 in these units is a whole number and a rest that has at most as many bits


def fixed_two(x: str) -> str:
    """SQL text of a double with two decimals: its exact binary value, rounded half to even.

    `format_string` rounds the shortest decimal form instead, so 2.675, which lies below that number, would
    become 2.68. Beyond 9e15, where doubles have no decimals, and for values that are no numbers that form is kept.
    """
    return f"""
        CASE WHEN abs({x}) < 9e15D THEN get(transform(transform(transform(transform(array({x}),
            v -> named_struct('v', v, 'w', floor(abs(v)), 's', (abs(v) - floor(abs(v))) * {_UNIT}D)),
            a -> named_struct('v', a.v, 'w', a.w, 'n', floor(a.s) * 100L, 'rest', floor((a.s - floor(a.s)) * {_UNIT}D) * 100L)),
            b -> named_struct('v', b.v, 'w', b.w, 'cents', shiftright(b.n, 52) + CASE
                WHEN {_UNIT // 2}L - (b.n & {_UNIT - 1}L) < 0 THEN 1
                WHEN {_UNIT // 2}L - (b.n & {_UNIT - 1}L) > 100 THEN 0
                WHEN b.rest > ({_UNIT // 2}L - (b.n & {_UNIT - 1}L)) * {_UNIT}L THEN 1
                WHEN b.rest < ({_UNIT // 2}L - (b.n & {_UNIT - 1}L)) * {_UNIT}L THEN 0
                ELSE shiftright(b.n, 52) % 2 END)),
            c -> concat(CASE WHEN CAST(c.v AS STRING) LIKE '-%' THEN '-' ELSE '' END,
                CAST(c.w + CAST(c.cents = 100 AS INT) AS STRING), '.', lpad(CAST(c.cents % 100 AS STRING), 2, '0'))), 0)
        ELSE format_string('%.2f', {x}) END"""
