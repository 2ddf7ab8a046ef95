"""JSON pointers as paths into VARIANT."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.pointer import index_of, parse_pointer

#: A pointer with more numeric tokens than this has too many readings to try; it is followed step by step.
MOST_NUMERIC = 4


def _key(token: str) -> str:
    return '["' + token.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def _readings(token: str) -> list[str]:
    return ([f"[{token}]"] if index_of(token) is not None and int(token) < 1 << 31 else []) + [_key(token)]


def paths(pointer: str) -> list[str]:
    """All VARIANT paths that a pointer may mean: a numeric token is an index or a name, as its parent turns out."""
    return ["$" + "".join(parts) for parts in product(*map(_readings, parse_pointer(pointer)))]


def _found(variant: Column, pointer: str, type: str) -> Column:
    tokens = parse_pointer(pointer)
    if sum(index_of(t) is not None for t in tokens) > MOST_NUMERIC:
        for token in tokens:
            variant = F.coalesce(*[F.try_variant_get(variant, "$" + r, "variant") for r in _readings(token)])
        return F.try_variant_get(variant, "$", type)
    return F.coalesce(*[F.try_variant_get(variant, path, type) for path in paths(pointer)])


def native_get(variant: Column, pointer: str, type: str = "string") -> Column:
    """What the pointer finds in a VARIANT column as a Spark type; NULL where it finds nothing, JSON null or another type."""
    return _found(variant, pointer, type)


def native_text(variant: Column, pointer: str) -> Column:
    """What the pointer finds as JSON text, with names in the order of VARIANT; JSON null is the text null."""
    return F.to_json(_found(variant, pointer, "variant"))
