"""Small expression helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression named inside a higher-order function's lambda is evaluated
    again for every element; binding it as a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(column: Column) -> Column:
    """Trim every kind of Unicode white space from both ends."""
    return F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def fill(template: str, *values: Column) -> Column:
    """``template.format(*values)`` as a column; surplus values are dropped."""
    parts: list[Column] = []
    used = 0
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if not field:
            field = str(used)
            used += 1
        position = int(field)
        if position >= len(values):
            raise ValueError(f"template {template!r} needs slot {position}, got {len(values)} values")
        parts.append(values[position].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def first_gap(numbers: Column) -> Column:
    """Largest k such that '1'..'k' all occur in an array of digit strings."""
    return let(
        F.array_distinct(numbers),
        lambda seen: F.array_min(
            F.array_except(
                F.sequence(F.lit(1), F.size(seen) + 1),
                F.transform(
                    F.filter(seen, lambda s: s.rlike("^[1-9][0-9]{0,8}$")), lambda s: s.cast("int")
                ),
            )
        )
        - 1,
    )
