"""String helpers as Column expressions."""

from __future__ import annotations

import shlex

from pyspark.sql import Column
from pyspark.sql import functions as F

# trim, lower, upper, startswith, reverse, replace, left and right are Spark's own.


def tokenize(c: Column, separator: str) -> Column:
    """Pieces between separators, empty ones kept."""
    return F.split(c, "[" + "".join(f"\\{x}" for x in separator) + "]", -1)


def delete_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def erase_tail(c: Column, n: int) -> Column:
    return F.left(c, F.greatest(F.length(c) - n, F.lit(0)))


def tokenize_quoted(text: str) -> list[str]:
    """White-space pieces, quoted ones whole; for driver-side option lines."""
    return shlex.split(text)


def fixed_or_scientific(c: Column, limit: float = 1e-4, digits: int = 6) -> Column:
    """Fixed notation at or above ``limit`` in size (and for 0), else scientific."""
    return F.when((F.abs(c) >= limit) | (c == 0), F.format_string(f"%.{digits}f", c)).otherwise(F.format_string(f"%.{digits}e", c))


def thousands(c: Column, width: int = 0) -> Column:
    made = F.format_number(c, 0)
    return F.lpad(made, width, " ") if width else made
