"""Column helpers for maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(left: Column, right: Column) -> Column:
    """Both maps in one; where both have a key, the right one's value counts. A null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def known(**columns: Column) -> Column:
    """A map of the columns by name, without those that are null."""
    return F.map_filter(F.create_map(*[x for n, c in columns.items() for x in (F.lit(n), c.cast("string"))]), lambda _, v: v.isNotNull())
