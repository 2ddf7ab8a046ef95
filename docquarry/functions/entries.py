"""Ordered entries: what json_entries gives, changed with native array functions only.

An entries column is array(struct(name, value)); names may repeat, and order counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entry(name, value) -> Column:
    """A single entry from columns or literal texts."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(name).alias("name"), as_column(value).alias("value"))


def push_back(entries: Column, new: Column) -> Column:
    return F.array_append(entries, new)


def push_front(entries: Column, new: Column) -> Column:
    return F.array_prepend(entries, new)


def insert(entries: Column, place: int, new: Column) -> Column:
    """With new before the entry at place (from 0)."""
    return F.array_insert(entries, place + 1, new)


def insert_all(entries: Column, place: int, new: Column) -> Column:
    """With all of new before the entry at place."""
    return F.concat(F.slice(entries, 1, place), new, F.slice(entries, F.lit(place + 1), F.size(entries)))


def erase_at(entries: Column, place: int, many: int = 1) -> Column:
    return F.concat(F.slice(entries, 1, place), F.slice(entries, F.lit(place + many + 1), F.size(entries)))


def erase(entries: Column, name: str) -> Column:
    """Without any entry of that name."""
    return F.filter(entries, lambda e: e["name"] != name)


def pop_front(entries: Column) -> Column:
    return F.slice(entries, F.lit(2), F.size(entries))


def pop_back(entries: Column) -> Column:
    return F.slice(entries, F.lit(1), F.greatest(F.size(entries) - 1, F.lit(0)))


def swap(entries: Column, others: Column) -> tuple[Column, Column]:
    """Two columns of entries, each in the place of the other."""
    return others, entries


def clear(entries: Column) -> Column:
    return F.slice(entries, 1, 0)


def count(entries: Column, name: str) -> Column:
    return F.size(F.filter(entries, lambda e: e["name"] == name))


def contains(entries: Column, name: str) -> Column:
    return F.exists(entries, lambda e: e["name"] == name)


def find(entries: Column, name: str) -> Column:
    """The first entry of that name, or NULL."""
    return F.get(F.filter(entries, lambda e: e["name"] == name), F.lit(0))


def equal_range(entries: Column, name: str) -> Column:
    return F.filter(entries, lambda e: e["name"] == name)


def lower_bound(entries: Column, name: str) -> Column:
    """In sorted order, the entries from that name on."""
    return F.filter(in_order(entries), lambda e: e["name"] >= name)


def upper_bound(entries: Column, name: str) -> Column:
    """In sorted order, the entries behind that name."""
    return F.filter(in_order(entries), lambda e: e["name"] > name)


def in_order(entries: Column) -> Column:
    """By name in byte order; entries of one name keep their order."""
    placed = F.transform(entries, lambda e, i: F.struct(e["name"].alias("name"), i.alias("i"), e["value"].alias("value")))
    return F.transform(F.array_sort(placed), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def backwards(entries: Column) -> Column:
    return F.reverse(entries)


def front(entries: Column) -> Column:
    return F.get(entries, F.lit(0))


def back(entries: Column) -> Column:
    return F.get(entries, F.size(entries) - 1)


def size(entries: Column) -> Column:
    return F.size(entries)


def empty(entries: Column) -> Column:
    return F.size(entries) == 0


def to_object(entries: Column) -> Column:
    """The text of the object that has these entries. Names are escaped natively; values are JSON text as they are."""
    quoted = lambda name: F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["name"]), F.lit(":"), e["value"])), ","), F.lit("}"))
