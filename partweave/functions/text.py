"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part_key(c: Column | str) -> Column:
    """The key of a part number: trimmed and upper-cased; missing is empty."""
    return F.coalesce(F.upper(F.trim(c)), F.lit(""))


def same_text(a: Column | str, b: Column | str) -> Column:
    """Whether two cells are equal apart from case and outer blanks; missing equals empty."""
    return part_key(a) == part_key(b)


def digest(c: Column | str) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)
