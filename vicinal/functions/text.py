"""Small text expressions of the sweep front ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_items(text: Column | str) -> Column:
    """Comma list as array<string>: items trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")


def csv_ints(text: Column | str) -> Column:
    """Comma list of whole numbers as array<bigint>; an item that is no number, or an empty list, is an error."""
    items = csv_items(text)
    bad = (F.size(items) < 1) | F.exists(items, lambda s: ~s.rlike("^[+-]?[0-9]+$"))
    return F.when(bad, F.raise_error(F.lit("expected a comma list of whole numbers"))).otherwise(F.transform(items, lambda s: s.cast("bigint")))


def parse_variants(text: str, known: list[str]) -> list[str]:
    """Names in a comma list, in the order given; raises on an unknown name or an empty list."""
    names = [s.strip() for s in text.split(",") if s.strip()]
    unknown = [n for n in names if n not in known]
    if unknown or not names:
        raise ValueError(f"unknown variants {unknown}; known: {known}" if unknown else "no variant given")
    return names


def variant_rank(name: Column | str) -> list[Column]:
    """Sort keys: baseline, heap, then q<N> by number, then the rest by name."""
    name = F.col(name) if isinstance(name, str) else name
    numbered = name.rlike("^q[0-9]+$")
    group = F.when(name == "baseline", 0).when(name == "heap", 1).when(numbered, 2).otherwise(3)
    return [group, F.when(numbered, F.substring(name, 2, 18).cast("bigint")).otherwise(F.lit(0).cast("bigint")), name]


def whole_numbers(text: str) -> list[int]:
    """The same list on the command line: blanks dropped; an item that is no number, or an empty list, is an error."""
    values = [int(s) for s in text.split(",") if s.strip()]
    if not values:
        raise ValueError("expected a comma list of whole numbers")
    return values
