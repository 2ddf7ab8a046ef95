"""Column functions over JSON text.

Documents are STRING columns that hold JSON text, for text keeps the order of members, repeated names and numbers of any
length. SQL NULL stands for "no value": an invalid document, a member that is not there, a value of another type. JSON
null is the text `null`.

Each function runs the kernel on Arrow batches. Literal pointers, patches and schemas are compiled once on the driver's
side of the call and checked there; columns of them are parsed row by row. A malformed document gives NULL.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import model, patch, pointer, printer, suites
from ..kernel.model import Members
from ..kernel.parser import ParseError, parse
from ..kernel.schema import InvalidSchema, JsonSchema

STRING, BOOLEAN, INTEGER, DOUBLE = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()
STRINGS = T.ArrayType(STRING)
ERROR = T.StructType([T.StructField("code", STRING), T.StructField("row", INTEGER), T.StructField("col", INTEGER), T.StructField("message", STRING)])
ENTRIES = T.ArrayType(T.StructType([T.StructField("name", STRING), T.StructField("value", STRING)]))
PATHS = T.ArrayType(T.StructType([T.StructField("pointer", STRING), T.StructField("type", STRING), T.StructField("value", STRING)]))
PATCHED = T.StructType([T.StructField("ok", BOOLEAN), T.StructField("results", STRINGS), T.StructField("doc", STRING)])
VALIDATED = T.StructType([T.StructField("valid", BOOLEAN), T.StructField("output", STRING)])
FAILURES = T.ArrayType(T.StructType([T.StructField("instance_location", STRING), T.StructField("keyword_location", STRING), T.StructField("error", STRING)]))

UNUSABLE = T.StructType([T.StructField("what", STRING), T.StructField("base_uri", STRING), T.StructField("pointer", STRING)])
READ = T.StructType([T.StructField("doc", STRING), T.StructField("error", ERROR)])

_WIDE = Context(prec=100_000)


class TypeMismatch(TypeError):
    """A value is not of the type that was asked for."""


def kernel_udf(function: Callable, returns: T.DataType, whole: bool = False, read: Callable | None = None, once: bool = False):
    """An Arrow UDF that calls function on the values of each row; NULL in the first column gives NULL, unless `whole`.
    read makes values of the first column. once keeps it where it stands: Spark would else run it a second time in the
    filters on what it gives, and below the shuffle that dealt the rows out."""
    from pyspark.sql.pandas.types import to_arrow_type

    def run(*columns):
        import pyarrow as pa

        first, *rest = columns
        first, rest = read(first) if read else first.to_pylist(), [c.to_pylist() for c in rest]
        if rest:
            out = [None if x is None and not whole else function(x, *more) for x, *more in zip(first, *rest, strict=True)]
        else:
            out = [None if x is None and not whole else function(x) for x in first]
        if isinstance(returns, T.ArrayType) and isinstance(returns.elementType, T.StructType) and (listed := _listed(out, to_arrow_type(returns))) is not None:
            return listed
        return pa.array(out, to_arrow_type(returns))

    run.__name__ = getattr(function, "__name__", "kernel")
    # Spark reads from the signature how columns come and go
    import pyarrow as pa

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, returns)
    return udf.asNondeterministic() if once else udf


def _listed(out: list, kind):
    """An Arrow array of lists of structs from lists of tuples, column by column; None for lists of anything else."""
    import numpy as np
    import pyarrow as pa

    rows = [row for x in out if x for row in x]
    if rows and not isinstance(rows[0], tuple):
        return None
    fields = list(kind.value_type)
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    offsets = np.cumsum([0, *(len(x) if x else 0 for x in out)], dtype=np.int32)
    nulls = np.array([x is None for x in out], bool)
    return pa.ListArray.from_arrays(pa.array(offsets), inner, type=kind, mask=pa.array(nulls) if nulls.any() else None)


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _parsed(text, options: dict):
    """The value of a document, or NOTHING."""
    if text is None:
        return pointer.NOTHING
    try:
        return parse(text, **options)
    except ParseError:
        return pointer.NOTHING


#: Batches of up to this many bytes keep their values until the next one, for all functions on the same column.
SHARED_BYTES = 2 << 20
_shared: list = [None, None, None]  # the column of the batch, the options of its reading, its values


def _values(column, options: dict):
    """The value of each text of a batch, or NOTHING. Functions must leave values as they are, for others read them too."""
    if _shared[0] is column and _shared[1] == options:
        return _shared[2]
    values = (_parsed(text, options) for text in column.to_pylist())
    if column.nbytes <= SHARED_BYTES:
        _shared[:] = None, None, None
        values = list(values)
        _shared[:] = column, options, values
    return values


def _source(doc, options: dict) -> tuple:
    """The column of texts that doc is made of, the options of its reading, and the steps from its values to those of doc.
    Texts of _text are not read again, so functions around one another print and parse once. Only for functions that print
    or compare what they are given: printing makes 1.50 and -0 to 1.5 and 0."""
    doc = _column(doc)
    return (doc, options, ()) if options else vars(doc).get("_made_of", (doc, options, ()))


def _stepped(value, steps: tuple):
    for step in steps:
        if value is pointer.NOTHING:
            break
        value = step(value)
    return value


def _on_value(doc, function: Callable, returns: T.DataType, *more, **options) -> Column:
    """function(value, ...) of each valid document; NOTHING becomes NULL."""
    once = options.pop("once", False)
    return _on_source((_column(doc), options, ()), function, returns, *more, once=once)


def _on_source(source: tuple, function: Callable, returns: T.DataType, *more, once: bool = False) -> Column:
    doc, options, steps = source

    def run(value, *rest):
        value = _stepped(value, steps)
        if value is pointer.NOTHING:
            return None
        out = function(value, *rest)
        return None if out is pointer.NOTHING else out

    run.__name__ = function.__name__
    return kernel_udf(run, returns, whole=True, read=functools.partial(_values, options=options), once=once)(doc, *map(_column, more))


def _text(doc, step: Callable, **options) -> Column:
    """The text of step(value) of each valid document; NOTHING becomes NULL."""

    def text(value):
        out = step(value)
        return out if out is pointer.NOTHING else compact(out)

    text.__name__ = step.__name__
    doc, options, steps = source = _source(doc, options)
    out = _on_source(source, text, STRING)
    out._made_of = doc, options, (*steps, step)
    return out


@functools.lru_cache(1024)
def _tokens(text: str) -> list[str] | None:
    try:
        return pointer.parse_pointer(text)
    except pointer.PointerError:
        return None


def _at(doc, ptr, function: Callable, returns: T.DataType, **options) -> Column:
    """function(value found at ptr) of each document; NULL where nothing is found. A literal pointer is checked at once."""
    if isinstance(ptr, Column):

        def find(value, text):
            tokens = None if text is None else _tokens(text)
            found = pointer.NOTHING if tokens is None else pointer.find(value, tokens)
            return found if found is pointer.NOTHING else function(found)

        find.__name__ = function.__name__
        return _on_value(doc, find, returns, ptr, **options)
    tokens = pointer.parse_pointer(ptr)

    def find_literal(value):
        found = pointer.find(value, tokens)
        return found if found is pointer.NOTHING else function(found)

    find_literal.__name__ = function.__name__
    return _on_value(doc, find_literal, returns, **options)


def compact(value) -> str:
    return printer.to_text(value)


# parsing


def json_valid(doc, **options) -> Column:
    """Whether the text is a document. Options of all functions that parse: strict (True), allow_duplicates (True), and
    max_depth, max_array_size and max_object_size (0: no limit)."""

    def valid(text):
        return _parsed(text, options) is not pointer.NOTHING

    return kernel_udf(valid, BOOLEAN)(_column(doc))


def json_parse(doc, **options) -> Column:
    """The document as compact strict text, members in their order; NULL if it is malformed."""
    return _on_value(doc, compact, STRING, **options)


def json_parse_error(doc, **options) -> Column:
    """struct(code, row, col, message): what is wrong and where, rows and columns from 0; code ok for a valid document."""

    def error(text):
        try:
            parse(text, **options)
        except ParseError as e:
            return {"code": e.code, "row": e.row, "col": e.col, "message": e.message}
        return {"code": "ok", "row": 0, "col": 0, "message": "Ok."}

    return kernel_udf(error, ERROR)(_column(doc))


def _error_of(e: ParseError) -> dict:
    return {"code": e.code, "row": e.row, "col": e.col, "message": e.message}


def json_read(doc, once: bool = False, **options) -> Column:
    """struct(doc, error): what json_parse and json_parse_error say, from one reading; error is NULL for a valid document.
    once: see kernel_udf."""

    def read(text):
        try:
            return {"doc": compact(parse(text, **options)), "error": None}
        except ParseError as e:
            return {"doc": None, "error": _error_of(e)}

    return kernel_udf(read, READ, once=once)(_column(doc))


# access


def json_get(doc, ptr, on_missing: str = "null", **options) -> Column:
    """The text of what a JSON pointer finds. Of members with one name, the last counts. NULL where it finds nothing in a
    document, or with on_missing='error' an IndexError."""
    if on_missing == "null" and isinstance(ptr, Column):
        return _at(doc, ptr, compact, STRING, **options)
    tokens = pointer.parse_pointer(ptr)
    if on_missing == "null":

        def get_literal(value):
            return pointer.find(value, tokens)

        return _text(doc, get_literal, **options)

    def get_or_fail(value):
        if (found := pointer.find(value, tokens)) is pointer.NOTHING:
            raise IndexError(f"the pointer {ptr!r} finds nothing")
        return compact(found)

    return _on_value(doc, get_or_fail, STRING, **options)


def json_get_or_add(doc, name: str, value="null", **options) -> Column:
    """struct(value, doc): the last member of that name and the document; an object without one gets it at its end."""
    item = parse(value)

    def get_or_add(x):
        if not isinstance(x, Members):
            return pointer.NOTHING
        if (at := x.find(name)) < 0:
            x = Members([*x, (name, item)])
        return {"value": compact(x[at][1]), "doc": compact(x)}

    return _on_value(doc, get_or_add, T.StructType([T.StructField("value", STRING), T.StructField("doc", STRING)]), **options)


def json_get_unique(doc, name: str, on_repeated: str = "null", **options) -> Column:
    """The member of that name; where it occurs more than once, NULL or an error (on_repeated='error')."""

    def get_unique(value):
        found = [v for k, v in value if k == name] if isinstance(value, Members) else []
        if len(found) > 1 and on_repeated == "error":
            raise ValueError(f"more than one member is called {name!r}")
        return compact(found[0]) if len(found) == 1 else pointer.NOTHING

    return _on_value(doc, get_unique, STRING, **options)


def json_type(doc, ptr="", **options) -> Column:
    """object, array, string, number, boolean or null."""
    return _at(doc, ptr, model.type_name, STRING, **options)


def json_is_type(doc, name: str, ptr="", **options) -> Column:
    """Whether the value is of that type; NULL where there is none."""
    model.default_of(name)

    def is_type(value):
        return model.type_name(value) == name

    return _at(doc, ptr, is_type, BOOLEAN, **options)


def json_size(doc, ptr="", **options) -> Column:
    """Items of an array or members of an object, repeated names counted; NULL for scalars."""

    def size(value):
        return len(value) if isinstance(value, list) else pointer.NOTHING

    return _at(doc, ptr, size, INTEGER, **options)


def json_has(doc, name: str, **options) -> Column:
    """Whether an object has a member of that name; NULL for other values."""

    def has(value):
        return value.find(name) >= 0 if isinstance(value, Members) else pointer.NOTHING

    return _on_value(doc, has, BOOLEAN, **options)


def json_keys_array(doc, ptr="", sorted: bool = False, **options) -> Column:
    """The names of an object's members, in their order or in byte order."""

    def keys(value):
        return [name for name, _ in (model.by_name(value) if sorted else value)] if isinstance(value, Members) else pointer.NOTHING

    return _at(doc, ptr, keys, STRINGS, **options)


def json_entries(doc, ptr="", sorted: bool = False, **options) -> Column:
    """array(struct(name, value)) of an object's members."""

    def entries(value):
        return [(k, compact(v)) for k, v in (model.by_name(value) if sorted else value)] if isinstance(value, Members) else pointer.NOTHING

    return _at(doc, ptr, entries, ENTRIES, **options)


def json_elements(doc, ptr="", **options) -> Column:
    """The items of an array, as texts."""

    def elements(value):
        return [compact(x) for x in value] if isinstance(value, list) and not isinstance(value, Members) else pointer.NOTHING

    return _at(doc, ptr, elements, STRINGS, **options)


def json_flat(doc, scalars: bool = False, **options) -> Column:
    """array(struct(pointer, type, value)) of the document and everything inside it, or of the scalars in it alone, which
    saves printing each container for all that is around it."""

    def flat(value):
        return [(pointer.pointer_text(at), model.type_name(x), compact(x)) for at, x in pointer.walk(value) if not (scalars and isinstance(x, list))]

    return _on_value(doc, flat, PATHS, **options)


def _typed(doc, ptr, kind: str, convert: Callable, returns: T.DataType, on_mismatch: str, options: dict) -> Column:
    def typed(value):
        if model.type_name(value) != kind:
            if on_mismatch == "error":
                raise TypeMismatch(f"the value is of type {model.type_name(value)}, not {kind}")
            return pointer.NOTHING
        return convert(value)

    return _at(doc, ptr, typed, returns, **options)


def json_as_string(doc, ptr="", on_mismatch: str = "null", **options) -> Column:
    """The content of a string; for other values NULL, or an error with on_mismatch='error'. So for all json_as_ functions."""
    return _typed(doc, ptr, "string", str, STRING, on_mismatch, options)


def json_as_decimal(doc, ptr="", precision: int = 38, scale: int = 18, on_mismatch: str = "null", **options) -> Column:
    """A number as DECIMAL(precision, scale), rounded half up; NULL where it does not fit."""
    unit, most = Decimal(1).scaleb(-scale), Decimal(10) ** (precision - scale)

    def to_decimal(value):
        if value and value.adjusted() > precision:
            return pointer.NOTHING
        try:
            out = value.quantize(unit, ROUND_HALF_UP, _WIDE) if value.adjusted() > -scale - 2 else Decimal(0)
        except InvalidOperation:
            return pointer.NOTHING
        return out if abs(out) < most else pointer.NOTHING

    return _typed(doc, ptr, "number", to_decimal, T.DecimalType(precision, scale), on_mismatch, options)


def json_as_double(doc, ptr="", on_mismatch: str = "null", **options) -> Column:
    return _typed(doc, ptr, "number", float, DOUBLE, on_mismatch, options)


def json_as_boolean(doc, ptr="", on_mismatch: str = "null", **options) -> Column:
    return _typed(doc, ptr, "boolean", bool, BOOLEAN, on_mismatch, options)


# texts


def json_print(doc, pretty: bool = True, sorted: bool = False, escape_slash: bool = False, tabs: bool = False, relaxed: bool = False, compact_array: bool = False, color: bool = False, ptr="", of_type: str | None = None, **options) -> Column:
    """The document, or what ptr finds, as text in a style of one's choice; with of_type, NULL for values of other types."""
    style = printer.Style(pretty, sorted, escape_slash, tabs, relaxed, compact_array, color)
    if of_type is not None:
        model.default_of(of_type)

    def printed(value):
        return printer.to_text(value, style) if of_type in (None, model.type_name(value)) else pointer.NOTHING

    return _at(doc, ptr, printed, STRING, **options)


def json_compact(doc, **options) -> Column:
    return _on_value(doc, compact, STRING, **options)


def json_canonical(doc, ptr="", **options) -> Column:
    """One text for all equal documents: a key for joins, groups and distinct."""
    return _at(doc, ptr, model.canonical, STRING, **options)


def json_equals(a, b, **options) -> Column:
    """Whether two documents are equal: members in any order, numbers by value. NULL if one is no document."""

    def equals(x, other):
        y = _parsed(other, options)
        return y if y is pointer.NOTHING else model.equal(x, y)

    return _on_value(a, equals, BOOLEAN, b, **options)


def json_compare(a, b, **options) -> Column:
    """-1, 0 or 1 in a total order: by type (null, boolean, number, string, array, object), then by value."""

    def compared(x, other):
        y = _parsed(other, options)
        return pointer.NOTHING if y is pointer.NOTHING else model.compare(x, y)

    return _on_value(a, compared, INTEGER, b, **options)


def json_escape(text, slash: bool = False) -> Column:
    """Plain text as it stands between the quotes of a JSON string."""

    def escaped(x):
        return model.escape(x, slash)

    return kernel_udf(escaped, STRING)(_column(text))


def json_unescape(text, on_error: str = "null") -> Column:
    """The inverse of json_escape; NULL (or an error) where an escape is unknown or half a surrogate pair."""

    def unescaped(x):
        try:
            return model.unescape(x)
        except ValueError:
            if on_error == "error":
                raise
            return None

    return kernel_udf(unescaped, STRING)(_column(text))


def pointer_escape(token) -> Column:
    """A member name as a token of a JSON pointer. Native."""
    return F.replace(F.replace(_column(token), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_from_tokens(tokens) -> Column | str:
    """The pointer of unescaped tokens: text for a list, a native column for a column of arrays."""
    if isinstance(tokens, (list, tuple)):
        return pointer.pointer_text(tokens)
    return F.concat_ws("", F.transform(_column(tokens), lambda t: F.concat(F.lit("/"), pointer_escape(t))))


def pointer_unescape(token) -> Column:
    return F.replace(F.replace(_column(token), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


# construction and change


def json_from(value) -> Column:
    """A column of a scalar, array, map or struct type as JSON text; SQL NULL becomes JSON null. Native."""
    value = _column(value)
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_default(name: str) -> Column:
    """A literal: the value that a newly made value of a type has."""
    return F.lit(compact(model.default_of(name)))


def _changed(doc, new, function: Callable, options: dict) -> Column:
    """function(value, new value) as text; new is JSON text, or a column of it."""
    if isinstance(new, Column):
        new, how, steps = _source(new, {})

        def change(value, text):
            item = _stepped(_parsed(text, how), steps)
            out = pointer.NOTHING if item is pointer.NOTHING else function(value, item)
            return out if out is pointer.NOTHING else compact(out)

        change.__name__ = function.__name__
        return _on_source(_source(doc, options), change, STRING, new)
    item = parse(new)

    def change_literal(value):
        return function(value, item)

    change_literal.__name__ = function.__name__
    return _text(doc, change_literal, **options)


def _with_member(x: Members, name: str, item, overwrite: bool) -> Members:
    if (at := x.find(name)) < 0:
        return Members([*x, (name, item)])
    return Members([*x[:at], (name, item), *x[at + 1 :]]) if overwrite else x


def json_add(doc, name: str, value, overwrite: bool = True, **options) -> Column:
    """An object with a member set: the last one of that name gets the value (or keeps its own), else it comes at the end."""

    def added(x, item):
        if not isinstance(x, Members):
            return pointer.NOTHING
        return _with_member(x, name, item, overwrite)

    return _changed(doc, value, added, options)


def _replaced(x, tokens: list[str], item):
    """A copy of x, as far as it changes, with item for what tokens lead to, which must be there."""
    path = [x]
    for token in tokens[:-1]:
        path.append(pointer.child(path[-1], token))
    for parent, token in zip(reversed(path), reversed(tokens), strict=False):
        if isinstance(parent, Members):
            item = _with_member(parent, token, item, True)
        else:
            item = [*parent[: int(token)], item, *parent[int(token) + 1 :]]
    return item


def json_set(doc, ptr: str, value, **options) -> Column:
    """A document whose value at a literal pointer is another one, of any type; NULL where the pointer finds nothing. Of
    members with one name, the last is set."""
    tokens = pointer.parse_pointer(ptr)

    def set_at(x, item):
        return pointer.NOTHING if pointer.find(x, tokens) is pointer.NOTHING else _replaced(x, tokens, item)

    return _changed(doc, value, set_at, options)


def json_set_type(doc, ptr: str, name: str, **options) -> Column:
    """A document whose value at a literal pointer is the default of a type, unless it is of that type already; NULL where
    the pointer finds nothing."""
    tokens, empty = pointer.parse_pointer(ptr), model.default_of(name)

    def set_type(x):
        found = pointer.find(x, tokens)
        if found is pointer.NOTHING or model.type_name(found) == name:
            return found if found is pointer.NOTHING else x
        return _replaced(x, tokens, empty)

    return _text(doc, set_type, **options)


def json_append(doc, value, **options) -> Column:
    """An array with one more item at its end."""

    def appended(x, item):
        return [*x, item] if isinstance(x, list) and not isinstance(x, Members) else pointer.NOTHING

    return _changed(doc, value, appended, options)


def json_remove_key(doc, name: str, **options) -> Column:
    """An object without any member of that name."""

    def removed(x):
        return Members(m for m in x if m[0] != name) if isinstance(x, Members) else pointer.NOTHING

    return _text(doc, removed, **options)


def json_remove_index(doc, index: int, **options) -> Column:
    """An array without the item at index; one that has none there stays as it is."""

    def removed_at(x):
        return [v for i, v in enumerate(x) if i != index] if isinstance(x, list) and not isinstance(x, Members) else pointer.NOTHING

    return _text(doc, removed_at, **options)


def json_concat(a, b, **options) -> Column:
    """The items of two arrays as one."""

    def joined(x, other):
        y = _parsed(other, options)
        fit = all(isinstance(v, list) and not isinstance(v, Members) for v in (x, y))
        return compact(x + y) if fit else pointer.NOTHING

    return _on_value(a, joined, STRING, b, **options)


def json_array_sort(doc, **options) -> Column:
    """An array with its items in the order of json_compare."""

    def in_order(x):
        return compact(model.sort_array(x)) if isinstance(x, list) and not isinstance(x, Members) else pointer.NOTHING

    return _on_value(doc, in_order, STRING, **options)


def json_patch(doc, operations, rfc: bool = False, atomic: bool = False, ptr: str = "", **options) -> Column:
    """struct(ok, results, doc): a document after a JSON Patch, literal text or a column. Operations go on after one that
    fails; atomic leaves the document as it was instead. A patch that is no JSON is invalid as a whole. With ptr, what
    that pointer finds is patched and comes out alone; NULL where it finds nothing."""
    tokens = pointer.parse_pointer(ptr)

    def outcome(value, steps):
        value = pointer.find(value, tokens)
        if value is pointer.NOTHING:
            return value
        if steps is pointer.NOTHING:
            return {"ok": False, "results": [patch.INVALID], "doc": compact(value)}
        ok, results, after = patch.patch(value, steps, rfc, atomic)
        return {"ok": ok, "results": results, "doc": compact(after)}

    if isinstance(operations, Column):

        def patched(value, text):
            return pointer.NOTHING if text is None else outcome(value, _parsed(text, {}))

        return _on_source(_source(doc, options), patched, PATCHED, operations)
    steps = parse(operations)

    def patched_literal(value):
        return outcome(value, steps)

    return _on_source(_source(doc, options), patched_literal, PATCHED)


def json_patch_case(case, run_disabled: bool = False, rfc: bool = False, **options) -> Column:
    """How a test case of patches (a document with doc, patch, and expected or error) comes out: passed, failed, disabled or
    invalid. NULL for what is no document."""

    def status(value):
        return suites.patch_case(value, run_disabled, rfc)

    return _on_value(case, status, STRING, **options)


def json_patch_cases(suite, run_disabled: bool = False, rfc: bool = False, **options) -> Column:
    """How each test case of an array comes out, as json_patch_case says of one."""

    def statuses(value):
        return [suites.patch_case(x, run_disabled, rfc) for x in value] if _is_array(value) else pointer.NOTHING

    return _on_value(suite, statuses, STRINGS, **options)


def json_schema_cases(group, run_disabled: bool = False, **options) -> Column:
    """How each test of a group (a document with schema and tests, each with data and valid) comes out, as an array."""

    def statuses(value):
        return suites.schema_cases(value, run_disabled)

    return _on_value(group, statuses, STRINGS, **options)


def json_verdict(doc, schema=None, references=(), **options) -> Column:
    """struct(valid, error) of each text: whether it is a document and fits the schema, if there is one; error is the parse
    error's message, or the output unit up to the first failure."""
    loaded = None if schema is None else _Loaded(schema, references, None)

    def verdict(text):
        try:
            value = parse(text, **options)
        except ParseError as e:
            return {"valid": False, "error": e.message}
        if loaded is None:
            return {"valid": True, "error": None}
        unit = loaded.get().output(value, False)
        return {"valid": unit[0][1], "error": None if unit[0][1] else compact(unit)}

    return kernel_udf(verdict, T.StructType([T.StructField("valid", BOOLEAN), T.StructField("error", STRING)]))(_column(doc))


# several changes from one reading


class Step:
    """A change of a value by a function of the value and of the values of columns of JSON texts; see json_apply."""

    def __init__(self, function: Callable, *columns: Column):
        self.function, self.columns = function, columns


def _item_step(function: Callable, value) -> Step:
    if isinstance(value, Column):
        return Step(function, value)
    item = parse(value)
    return Step(lambda x: function(x, item))


def _is_array(x) -> bool:
    return isinstance(x, list) and not isinstance(x, Members)


def get(ptr: str) -> Step:
    """What a pointer finds."""
    tokens = pointer.parse_pointer(ptr)
    return Step(lambda x: pointer.find(x, tokens))


def add(name: str, value, overwrite: bool = True) -> Step:
    """An object with a member set, as json_add has it."""

    def added(x, item):
        if not isinstance(x, Members):
            return pointer.NOTHING
        return _with_member(x, name, item, overwrite)

    return _item_step(added, value)


def append(value) -> Step:
    """An array with one more item at its end."""
    return _item_step(lambda x, item: [*x, item] if _is_array(x) else pointer.NOTHING, value)


def remove_key(name: str) -> Step:
    """An object without any member of that name."""
    return Step(lambda x: Members(m for m in x if m[0] != name) if isinstance(x, Members) else pointer.NOTHING)


def remove_index(index: int) -> Step:
    """An array without the item at index."""
    return Step(lambda x: [v for i, v in enumerate(x) if i != index] if _is_array(x) else pointer.NOTHING)


def json_apply(doc, changes: dict[str, list[Step]], **options) -> Column:
    """struct of texts, one for each name of changes: the document after its steps, one after the other. The document is
    read once for all. A step that finds nothing, or nothing of its type, makes its text NULL."""
    columns = [c for steps in changes.values() for step in steps for c in step.columns]
    kind = T.StructType([T.StructField(name, STRING) for name in changes])
    plan = {name: [(step.function, len(step.columns)) for step in steps] for name, steps in changes.items()}

    def applied(value, *texts):
        given, out = iter(texts), {}
        for name, steps in plan.items():
            x = value
            for function, n in steps:
                items = [_parsed(next(given), {}) for _ in range(n)]
                x = pointer.NOTHING if x is pointer.NOTHING or any(i is pointer.NOTHING for i in items) else function(x, *items)
            out[name] = None if x is pointer.NOTHING else compact(x)
        return out

    return _on_value(doc, applied, kind, *columns, **options)


# schemas


@functools.lru_cache(64)
def _schema(text: str, references: tuple) -> JsonSchema:
    return JsonSchema(text, dict(references))


class _Loaded:
    """A schema that travels as text and is loaded once in each worker."""

    def __init__(self, schema, references, resolver, keywords=None, applicators=None):
        as_text = lambda x: x if isinstance(x, str) else compact(x)
        references = references if isinstance(references, dict) else {parse(as_text(r)).latest()["$id"]: r for r in references}
        fetched: dict[str, str] = {}

        def keep(uri):
            if (found := resolver(uri)) is not None:
                fetched[uri] = as_text(found)
            return found

        self.text, known = as_text(schema), {k: as_text(v) for k, v in references.items()}
        # loading here shows what is wrong before any job runs, and asks the resolver for all it is needed for
        JsonSchema(self.text, known, keep if resolver else None, keywords, applicators)
        self.references, self.keywords, self.applicators, self.own = tuple((known | fetched).items()), keywords, applicators, None

    def get(self) -> JsonSchema:
        if not (self.keywords or self.applicators):
            return _schema(self.text, self.references)
        if self.own is None:
            self.own = JsonSchema(self.text, dict(self.references), keywords=self.keywords, applicators=self.applicators)
        return self.own


def json_schema_valid(doc, schema, references=(), resolver=None, keywords=None, applicators=None, **options) -> Column:
    """Whether the document fits a JSON Schema (2020-12); NULL if it is no document. InvalidSchema is raised at once.

    keywords adds assertions of one's own: a name to a function of instance and keyword value that returns an error or None.
    applicators adds keywords with a schema as their value: a name to a function of instance and fits(value)."""
    loaded = _Loaded(schema, references, resolver, keywords, applicators)

    def fits(value):
        return loaded.get().is_valid(value)

    return _on_value(doc, fits, BOOLEAN, **options)


def json_schema_error(schema) -> Column:
    """struct(what, base_uri, pointer) of what makes the schema in a column of texts unusable; NULL for a sound one."""

    def unusable(text):
        try:
            JsonSchema(text)
        except InvalidSchema as e:
            return {"what": e.what, "base_uri": e.base_uri, "pointer": e.pointer}
        except ParseError as e:
            return {"what": e.message, "base_uri": "", "pointer": ""}
        return None

    return kernel_udf(unusable, UNUSABLE)(_column(schema))


def json_schema_validate(doc, schema, full: bool = False, references=(), resolver=None, keywords=None, applicators=None, **options) -> Column:
    """struct(valid, output): the verdict and the output unit, up to the first failure or in full."""
    loaded = _Loaded(schema, references, resolver, keywords, applicators)

    def validated(value):
        unit = loaded.get().output(value, full)
        return {"valid": unit[0][1], "output": compact(unit)}

    return _on_value(doc, validated, VALIDATED, **options)


def json_schema_failures(doc, schema, references=(), resolver=None, keywords=None, applicators=None, **options) -> Column:
    """array(struct(instance_location, keyword_location, error)) of all failures; empty for a valid document."""
    loaded = _Loaded(schema, references, resolver, keywords, applicators)

    def failures(value):
        return loaded.get().errors(value)

    return _on_value(doc, failures, FAILURES, **options)
