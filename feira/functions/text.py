"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


BINARY = "UTF8_BINARY"


def full_name(first: Column, last: Column) -> Column:
    """``first last``; NULL when either part is NULL."""
    return F.concat(first, F.lit(" "), last)


def strip_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def collated(text: Column, collation: str) -> Column:
    """``text`` under a collation; the binary default leaves the column as it is."""
    return text if collation == BINARY else F.collate(text, collation)


def not_in(text: Column, *values: str) -> Column:
    """Case-insensitive NOT IN over lower-case values: a NULL text is not kept."""
    return ~F.lower(text).isin(*(v.lower() for v in values))
