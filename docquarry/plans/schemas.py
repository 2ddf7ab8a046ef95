"""JSON Schemas as boolean columns over VARIANT: the keywords whose meaning native expressions can hold."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as c
from ..kernel.parser import parse
from ..kernel.schema.loading import ROOT, Node, Registry

#: What a compiled schema may use besides names that mean nothing for validity.
_KNOWN = {
    "type", "const", "enum", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems",
    "minProperties", "maxProperties", "required", "dependentRequired", "properties", "items", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
    "dependentSchemas", "additionalProperties", "$ref", "$defs", "$anchor", "$schema", "$comment", "title", "description", "default", "examples",
}
_IGNORED = {"$defs", "$anchor", "$schema", "$comment", "title", "description", "default", "examples", "then", "else"}
#: Patterns that Java and ECMAScript read alike.
_SAFE_PATTERN = re.compile(r"(?:[A-Za-z0-9 _\-@#%&=:;,/'\"<>!~]|\\[.dw\-/+*?()\[\]]|\[\^?(?:[A-Za-z0-9_ ]-[A-Za-z0-9]|[A-Za-z0-9_ .@+])+\]|[.^*+?|()]|\{\d+(?:,\d*)?\})*\$?\Z")


class NotCompilable(ValueError):
    """A schema that only the kernel can judge."""


def _literal(value) -> Column:
    if isinstance(value, Decimal):
        if len(value.as_tuple().digits) > 18 or abs(value.adjusted()) > 18:
            raise NotCompilable("a number is too long for a native comparison")
        return F.expr(f"cast({format(value, 'f')} as decimal(38,18))")
    return F.lit(value)


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _number(v: Column) -> Column:
    return _get(v, "decimal(38,18)")


def _kind(v: Column) -> Column:
    """The schema of a variant, up to its first bracket: BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, VOID, ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


_KINDS = {"string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "array": ["ARRAY"], "object": ["OBJECT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}


def _is(v: Column, name: str) -> Column:
    if name == "integer":
        return _is(v, "number") & F.coalesce(_number(v) == F.floor(_number(v)), F.lit(False))
    return _kind(v).isin(_KINDS[name])


def _child(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$" + '["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]', "variant")


def _equal(v: Column, value) -> Column:
    if value is None:
        return _is(v, "null")
    if isinstance(value, bool):
        return _is(v, "boolean") & F.coalesce(_get(v, "boolean") == F.lit(value), F.lit(False))
    if isinstance(value, Decimal):
        return _is(v, "number") & F.coalesce(_number(v) == _literal(value), F.lit(False))
    if isinstance(value, str):
        return _is(v, "string") & F.coalesce(_get(v, "string") == F.lit(value), F.lit(False))
    raise NotCompilable("equality with a container")


def _keys(v: Column) -> Column:
    return F.map_keys(_get(v, "map<string,variant>"))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out


def _compile(node: Node, v: Column, above: tuple[int, ...]) -> Column:
    """Whether variant v fits node; never NULL for a v that is not."""
    if isinstance(node.value, bool):
        return F.lit(node.value)
    if id(node) in above:
        raise NotCompilable("a schema refers back to itself")
    above = (*above, id(node))
    keys, subs = node.keys, node.subs
    if unknown := set(keys) - _KNOWN:
        raise NotCompilable(f"keywords {', '.join(sorted(unknown))}")
    sub = lambda n, x=v: _compile(n, x, above)
    when = lambda kind, test: ~_is(v, kind) | F.coalesce(test, F.lit(False))
    out = []
    for name, value in keys.items():
        if name in _IGNORED:
            continue
        if name == "$ref":
            if (target := node.refs.get("$ref")) is None:
                raise NotCompilable("an unknown reference")
            out.append(sub(target))
        elif name == "type":
            names = [value] if isinstance(value, str) else value
            test = F.lit(False)
            for n in names:
                test = test | _is(v, n)
            out.append(test)
        elif name == "const":
            out.append(_equal(v, value))
        elif name == "enum":
            test = F.lit(False)
            for x in value:
                test = test | _equal(v, x)
            out.append(test)
        elif name in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            x, limit = _number(v), _literal(value)
            out.append(when("number", {"minimum": x >= limit, "maximum": x <= limit, "exclusiveMinimum": x > limit, "exclusiveMaximum": x < limit}[name]))
        elif name == "multipleOf":
            out.append(when("number", _number(v) % _literal(value) == 0))
        elif name in ("minLength", "maxLength"):
            size, limit = F.length(_get(v, "string")), F.lit(int(value))
            out.append(when("string", size >= limit if name == "minLength" else size <= limit))
        elif name == "pattern":
            if not _SAFE_PATTERN.match(value):
                raise NotCompilable("a pattern that Java may read otherwise")
            java = value[:-1] + r"\z" if value.endswith("$") and not value.endswith("\\$") else value
            out.append(when("string", F.rlike(_get(v, "string"), F.lit(java))))
        elif name in ("minItems", "maxItems"):
            size, limit = F.size(_get(v, "array<variant>")), F.lit(int(value))
            out.append(when("array", size >= limit if name == "minItems" else size <= limit))
        elif name in ("minProperties", "maxProperties"):
            size, limit = F.size(_keys(v)), F.lit(int(value))
            out.append(when("object", size >= limit if name == "minProperties" else size <= limit))
        elif name == "required":
            out.append(when("object", _all([_child(v, n).isNotNull() for n in value])))
        elif name == "dependentRequired":
            out.append(when("object", _all([_child(v, n).isNull() | _all([_child(v, m).isNotNull() for m in more]) for n, more in value])))
        elif name == "properties":
            out.append(when("object", _all([_child(v, n).isNull() | sub(s, _child(v, n)) for n, s in subs[name].items()])))
        elif name == "additionalProperties":
            if value is not False:
                raise NotCompilable("additionalProperties other than false")
            out.append(when("object", F.size(F.array_except(_keys(v), F.array(*map(F.lit, subs.get("properties", {}))).cast("array<string>"))) == 0))
        elif name == "items":
            out.append(when("array", F.forall(_get(v, "array<variant>"), lambda x: sub(subs["items"], x))))
        elif name == "allOf":
            out.append(_all([sub(s) for s in subs[name]]))
        elif name in ("anyOf", "oneOf"):
            fits = F.lit(0)
            for s in subs[name]:
                fits = fits + F.when(sub(s), 1).otherwise(0)
            out.append(fits >= 1 if name == "anyOf" else fits == 1)
        elif name == "not":
            out.append(~sub(subs[name]))
        elif name == "if":
            then, other = (sub(subs[k]) if k in subs else F.lit(True) for k in ("then", "else"))
            out.append(F.when(sub(subs["if"]), then).otherwise(other))
        elif name == "dependentSchemas":
            out.append(when("object", _all([_child(v, n).isNull() | sub(s) for n, s in subs[name].items()])))
    return _all(out)


def schema_predicate(schema: str, variant: Column) -> Column:
    """Whether a VARIANT fits a schema. NotCompilable where native expressions can't say so."""
    value = parse(schema)
    registry = Registry()
    root = registry.load(value, ROOT, is_root=True)
    registry.link()
    return _compile(root, variant, ())


def compiled_valid(doc, schema: str) -> Column:
    """As json_schema_valid for clean documents, native as far as it goes: rows that VARIANT refuses, and schemas that
    can't be compiled, go to the kernel. Numbers must fit DECIMAL(38, 18)."""
    doc = doc if isinstance(doc, Column) else F.col(doc)
    variant = F.try_parse_json(doc)
    try:
        native = schema_predicate(schema, variant)
    except NotCompilable:
        return c.json_schema_valid(doc, schema)
    # Spark runs a Python function for every row, whatever branch it stands in; here it gets text only where it must judge
    return F.when(variant.isNull(), c.json_schema_valid(F.when(variant.isNull(), doc), schema)).otherwise(native)
