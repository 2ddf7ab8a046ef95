"""Registration of all functions for SQL.

json_valid, json_parse, json_print and json_patch take their options as one more argument, a JSON object:
json_parse(doc, '{"strict": false}').
"""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..kernel import model, patch, pointer
from ..kernel.model import Members
from . import columns as c
from .tables import TABLE_FUNCTIONS


def _strict(text):
    return c._parsed(text, {})


def _found(text, ptr):
    value, tokens = _strict(text), c._tokens(ptr) if ptr is not None else None
    return pointer.NOTHING if value is pointer.NOTHING or tokens is None else pointer.find(value, tokens)


def _or_null(value, function):
    out = value if value is pointer.NOTHING else function(value)
    return None if out is pointer.NOTHING else out


def _is_array(x) -> bool:
    return isinstance(x, list) and not isinstance(x, Members)


def _set(x, name, item, overwrite):
    at = x.find(name) if isinstance(x, Members) else None
    if at is None:
        return pointer.NOTHING
    if at < 0:
        x.append((name, item))
    elif overwrite:
        x[at] = (name, item)
    return c.compact(x)


@functools.lru_cache(256)
def _options(text: str | None) -> dict:
    """Options by name from a JSON object, as the column function of that name takes them."""
    return {k: int(v) if isinstance(v, c.Decimal) else v for k, v in (c.parse(text) if text else ())}


def _printed(doc, options=None):
    return _or_null(_strict(doc), lambda v: c.printer.to_text(v, c.printer.Style(**{"pretty": True} | _options(options))))


def _patch(doc, steps, options=None):
    value, steps = _strict(doc), _strict(steps)
    if value is pointer.NOTHING:
        return None
    if steps is pointer.NOTHING:
        return {"ok": False, "results": [patch.INVALID], "doc": c.compact(value)}
    ok, results, after = patch.patch(value, steps, **_options(options))
    return {"ok": ok, "results": results, "doc": c.compact(after)}


def _two(function):
    """function of two documents, for which both must be valid."""

    def run(a, b):
        x, y = _strict(a), _strict(b)
        return None if pointer.NOTHING in (x, y) and (x is pointer.NOTHING or y is pointer.NOTHING) else _or_null(x, lambda v: function(v, y))

    return run


def _unescape(text):
    try:
        return model.unescape(text)
    except ValueError:
        return None


def _get_or_add(x, name, item):
    if not isinstance(x, Members) or item is pointer.NOTHING or name is None:
        return pointer.NOTHING
    if (at := x.find(name)) < 0:
        x.append((name, item))
    return {"value": c.compact(x[at][1]), "doc": c.compact(x)}


def _replaced(x, ptr, item):
    tokens = None if ptr is None else c._tokens(ptr)
    if tokens is None or item is pointer.NOTHING or pointer.find(x, tokens) is pointer.NOTHING:
        return pointer.NOTHING
    return c.compact(c._replaced(x, tokens, item))


def _read(text, options):
    error = _error(text, options)
    return {"doc": c.compact(c.parse(text, **options)), "error": None} if error["code"] == "ok" else {"doc": None, "error": error}


def _unusable(text):
    try:
        c.JsonSchema(text)
    except c.InvalidSchema as e:
        return {"what": e.what, "base_uri": e.base_uri, "pointer": e.pointer}
    except c.ParseError as e:
        return {"what": e.message, "base_uri": "", "pointer": ""}
    return None


def _verdict(doc, schema=None):
    error = _error(doc)
    if error["code"] != "ok":
        return {"valid": False, "error": error["message"]}
    unit = None if schema is None else c._schema(schema, ()).output(c.parse(doc), False)
    return {"valid": True, "error": None} if unit is None or unit[0][1] else {"valid": False, "error": c.compact(unit)}


def _unique(value, name):
    found = [v for k, v in value if k == name] if isinstance(value, Members) else []
    return found[0] if len(found) == 1 else pointer.NOTHING


def _flat(value):
    return [(pointer.pointer_text(at), model.type_name(x), c.compact(x)) for at, x in pointer.walk(value)]


def _failures(value, schema):
    return c._schema(schema, ()).errors(value)


#: SQL name to (function of plain values, result type). Pointers, names and schemas are arguments here.
SCALARS = {
    "json_valid": (lambda d, options=None: c._parsed(d, _options(options)) is not pointer.NOTHING, c.BOOLEAN),
    "json_parse": (lambda d, options=None: _or_null(c._parsed(d, _options(options)), c.compact), c.STRING),
    "json_compact": (lambda d: _or_null(_strict(d), c.compact), c.STRING),
    "json_relaxed": (lambda d: _or_null(c._parsed(d, {"strict": False}), c.compact), c.STRING),
    "json_get": (lambda d, p: _or_null(_found(d, p), c.compact), c.STRING),
    "json_get_unique": (lambda d, n: _or_null(_strict(d), lambda v: pointer.NOTHING if (x := _unique(v, n)) is pointer.NOTHING else c.compact(x)), c.STRING),
    "json_type": (lambda d, p: _or_null(_found(d, p), model.type_name), c.STRING),
    "json_is_type": (lambda d, t: _or_null(_strict(d), lambda v: model.type_name(v) == t), c.BOOLEAN),
    "json_size": (lambda d, p: _or_null(_found(d, p), lambda v: len(v) if isinstance(v, list) else pointer.NOTHING), c.INTEGER),
    "json_has": (lambda d, n: _or_null(_strict(d), lambda v: v.find(n) >= 0 if isinstance(v, Members) else pointer.NOTHING), c.BOOLEAN),
    "json_keys_array": (lambda d: _or_null(_strict(d), lambda v: [n for n, _ in v] if isinstance(v, Members) else pointer.NOTHING), c.STRINGS),
    "json_entries": (lambda d: _or_null(_strict(d), lambda v: [(n, c.compact(x)) for n, x in v] if isinstance(v, Members) else pointer.NOTHING), c.ENTRIES),
    "json_elements": (lambda d: _or_null(_strict(d), lambda v: [c.compact(x) for x in v] if _is_array(v) else pointer.NOTHING), c.STRINGS),
    "json_flat": (lambda d: _or_null(_strict(d), _flat), c.PATHS),
    "json_as_string": (lambda d, p: _or_null(_found(d, p), lambda v: v if isinstance(v, str) else pointer.NOTHING), c.STRING),
    "json_as_double": (lambda d, p: _or_null(_found(d, p), lambda v: float(v) if model.type_name(v) == "number" else pointer.NOTHING), c.DOUBLE),
    "json_as_boolean": (lambda d, p: _or_null(_found(d, p), lambda v: v if isinstance(v, bool) else pointer.NOTHING), c.BOOLEAN),
    "json_print": (_printed, c.STRING),
    "json_canonical": (lambda d: _or_null(_strict(d), model.canonical), c.STRING),
    "json_equals": (_two(model.equal), c.BOOLEAN),
    "json_compare": (_two(model.compare), c.INTEGER),
    "json_escape": (model.escape, c.STRING),
    "json_unescape": (_unescape, c.STRING),
    "pointer_escape": (lambda t: t.replace("~", "~0").replace("/", "~1"), c.STRING),
    "pointer_unescape": (lambda t: t.replace("~1", "/").replace("~0", "~"), c.STRING),
    "pointer_from_tokens": (lambda tokens: pointer.pointer_text([t for t in tokens if t is not None]), c.STRING),
    "json_default": (lambda n: c.compact(model.default_of(n)), c.STRING),
    "json_add": (lambda d, n, v, overwrite=True: _or_null(_strict(d), lambda x: pointer.NOTHING if n is None or (item := _strict(v)) is pointer.NOTHING else _set(x, n, item, overwrite is not False)), c.STRING),
    "json_get_or_add": (lambda d, n, v="null": _or_null(_strict(d), lambda x: _get_or_add(x, n, _strict(v))), T.StructType([T.StructField("value", c.STRING), T.StructField("doc", c.STRING)])),
    "json_set": (lambda d, p, v: _or_null(_strict(d), lambda x: _replaced(x, p, _strict(v))), c.STRING),
    "json_set_type": (lambda d, p, t: _or_null(_strict(d), lambda x: c.compact(x) if (f := _found(d, p)) is not pointer.NOTHING and model.type_name(f) == t else _replaced(x, p, model.default_of(t))), c.STRING),
    "json_read": (lambda d, options=None: _read(d, _options(options)), c.READ),
    "json_append": (_two(lambda x, item: c.compact([*x, item]) if _is_array(x) else pointer.NOTHING), c.STRING),
    "json_remove_key": (lambda d, n: _or_null(_strict(d), lambda v: c.compact(Members(m for m in v if m[0] != n)) if isinstance(v, Members) else pointer.NOTHING), c.STRING),
    "json_remove_index": (lambda d, i: _or_null(_strict(d), lambda v: c.compact([x for k, x in enumerate(v) if k != i]) if _is_array(v) else pointer.NOTHING), c.STRING),
    "json_concat": (_two(lambda x, y: c.compact(x + y) if _is_array(x) and _is_array(y) else pointer.NOTHING), c.STRING),
    "json_array_sort": (lambda d: _or_null(_strict(d), lambda v: c.compact(model.sort_array(v)) if _is_array(v) else pointer.NOTHING), c.STRING),
    "json_patch": (_patch, c.PATCHED),
    "json_schema_valid": (lambda d, s: _or_null(_strict(d), lambda v: c._schema(s, ()).is_valid(v)), c.BOOLEAN),
    "json_schema_validate": (lambda d, s: _or_null(_strict(d), lambda v: {"valid": (u := c._schema(s, ()).output(v))[0][1], "output": c.compact(u)}), c.VALIDATED),
    "json_schema_error": (_unusable, c.UNUSABLE),
    "json_patch_case": (lambda d: _or_null(_strict(d), c.suites.patch_case), c.STRING),
    "json_patch_cases": (lambda d: _or_null(_strict(d), lambda v: [c.suites.patch_case(x) for x in v] if c._is_array(v) else None), c.STRINGS),
    "json_schema_cases": (lambda d: _or_null(_strict(d), c.suites.schema_cases), c.STRINGS),
    "json_verdict": (_verdict, T.StructType([T.StructField("valid", c.BOOLEAN), T.StructField("error", c.STRING)])),
    "json_schema_failures": (lambda d, s: _or_null(_strict(d), lambda v: _failures(v, s)), c.FAILURES),
}


def register_all(spark: SparkSession) -> None:
    """Makes every function known to spark.sql under its name, but json_from, which takes any type, json_apply, which takes steps, and those of entries, which are native columns."""
    for name, (function, returns) in SCALARS.items():
        spark.udf.register(name, c.kernel_udf(function, returns))
    error = c.kernel_udf(_error, c.ERROR)
    spark.udf.register("json_parse_error", error)
    spark.udf.register("json_as_decimal", c.kernel_udf(_decimal, T.DecimalType(38, 18)))
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)


def _error(text, options=None):
    try:
        c.parse(text, **(options or {}))
    except c.ParseError as e:
        return {"code": e.code, "row": e.row, "col": e.col, "message": e.message}
    return {"code": "ok", "row": 0, "col": 0, "message": "Ok."}


def _decimal(doc, ptr):
    value = _found(doc, ptr)
    if model.type_name(value) != "number" if value is not pointer.NOTHING else True:
        return None
    if value and value.adjusted() > 19:
        return None
    return value.quantize(c.Decimal(1).scaleb(-18), c.ROUND_HALF_UP, c._WIDE)
