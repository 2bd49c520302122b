"""Array and map column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(items: Column) -> Column:
    """Drop null and empty texts."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def compact_numbers(items: Column) -> Column:
    """Drop null and zero."""
    return F.filter(items, lambda x: x.isNotNull() & (x != 0))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def includes(items: Column, sought, start: int = 0) -> Column:
    """Membership from a zero-based index on."""
    return F.array_contains(F.slice(items, start + 1, 1 << 30), sought)


def map_includes(mapping: Column, sought) -> Column:
    return F.array_contains(F.map_values(mapping), sought)


def map_over(function, *arrays: Column) -> Column:
    """Apply ``function`` to the items of one or several aligned arrays; the shortest decides."""
    if len(arrays) == 1:
        return F.transform(arrays[0], function)
    size = F.least(*[F.size(a) for a in arrays])
    cut = [F.slice(a, 1, size) for a in arrays]
    if len(arrays) == 2:
        return F.zip_with(cut[0], cut[1], function)
    rows = F.arrays_zip(*[c.alias(f"a{i}") for i, c in enumerate(cut)])
    return F.transform(rows, lambda r: function(*[r[f"a{i}"] for i in range(len(arrays))]))


def fold(items: Column, start: Column, step) -> Column:
    return F.aggregate(items, start, step)
