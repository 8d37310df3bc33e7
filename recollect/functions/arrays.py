"""Sets kept in arrays and maps: order and duplicates as the domain keeps them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(requested: Column, granted: Column) -> Column:
    """Requested ids that are granted, in the order requested; no request means all granted, an empty one none."""
    granted = F.coalesce(granted, F.array().cast("array<string>"))
    return F.when(requested.isNull(), granted).otherwise(F.filter(requested, lambda x: F.array_contains(granted, x)))


def union(existing: Column, new: Column) -> Column:
    return F.array_union(existing, new)


def remove(ids: Column, x: Column) -> Column:
    return F.array_remove(ids, x)


def toggle(ids: Column, x: Column) -> Column:
    return F.when(F.array_contains(ids, x), F.array_remove(ids, x)).otherwise(F.array_append(ids, x))


def put(m: Column, key: Column, value: Column) -> Column:
    """Set one key of a map, replacing its value."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def put_all(m: Column, entries: Column) -> Column:
    """Set all keys of another map."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(entries), k)), entries)


def drop_key(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def confirmed(candidates: Column, answer: Column) -> Column:
    """Candidate ids that a model's comma-separated answer names."""
    named = F.transform(F.split(answer, ","), lambda x: F.trim(x))
    return F.filter(candidates, lambda x: F.array_contains(named, x))


def joined(ids: Column) -> Column:
    """Sorted and joined by commas, for comparison and export."""
    return F.array_join(F.array_sort(ids), ",")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas name it."""
    return F.transform(F.array(value), body)[0]
