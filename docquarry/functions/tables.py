"""Table functions for SQL: json_tokens, json_members, json_flatten and json_schema_errors."""

from __future__ import annotations

from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..kernel import lexer, model, pointer
from ..kernel.model import Members
from ..kernel.parser import ParseError, parse
from .columns import _schema, compact


def _schema_of(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_TEXT, _INT = StringType(), IntegerType()


@udtf(returnType=_schema_of(ordinal=_INT, type=_TEXT, row=_INT, col=_INT, data=_TEXT, error=_TEXT))
class JsonTokens:
    """The tokens of a text, strict or relaxed; an invalid one is the last and has an error."""

    def eval(self, doc: str, strict: bool = True):
        for i, t in enumerate(lexer.tokens(doc, strict) if doc is not None else ()):
            yield i, t.type, t.row, t.col, t.data, t.error


@udtf(returnType=_schema_of(ordinal=_INT, name=_TEXT, value=_TEXT))
class JsonMembers:
    """The members of an object, in their order or by name."""

    def eval(self, doc: str, by_name: bool = False):
        value = _value(doc)
        if isinstance(value, Members):
            for i, (name, inner) in enumerate(model.by_name(value) if by_name else value):
                yield i, name, compact(inner)


@udtf(returnType=_schema_of(pointer=_TEXT, type=_TEXT, value=_TEXT))
class JsonFlatten:
    """A document and everything inside it, with pointers."""

    def eval(self, doc: str):
        if (value := _value(doc)) is not pointer.NOTHING:
            for at, x in pointer.walk(value):
                yield pointer.pointer_text(at), model.type_name(x), compact(x)


@udtf(returnType=_schema_of(instance_location=_TEXT, keyword_location=_TEXT, error=_TEXT))
class JsonSchemaErrors:
    """What fails when a document is held against a schema."""

    def eval(self, doc: str, schema: str):
        if (value := _value(doc)) is not pointer.NOTHING and schema is not None:
            yield from _schema(schema, ()).errors(value)


def _value(doc):
    try:
        return pointer.NOTHING if doc is None else parse(doc)
    except ParseError:
        return pointer.NOTHING


TABLE_FUNCTIONS = {"json_tokens": JsonTokens, "json_members": JsonMembers, "json_flatten": JsonFlatten, "json_schema_errors": JsonSchemaErrors}
