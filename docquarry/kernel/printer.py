"""Serialisation of values: compact, or pretty with the options of Style."""

from __future__ import annotations

import re
from decimal import Decimal
from json.encoder import encode_basestring as quoted  # in C; escapes what model.escape does without slashes
from typing import NamedTuple

from .model import Members, by_name, escape, number_text

_IDENTIFIER = re.compile(r"[_a-zA-Z][_a-zA-Z0-9]*\Z")
# fixed values: ANSI colours for a terminal
_COLORS = {"name": "\x1b[36m", "string": "\x1b[32m", "number": "\x1b[33m", "literal": "\x1b[35m"}
_PLAIN = "\x1b[0m"


class Style(NamedTuple):
    pretty: bool = False
    sorted: bool = False
    escape_slash: bool = False
    tabs: bool = False
    relaxed: bool = False
    compact_array: bool = False
    color: bool = False
    indent: int = 0


_COMPACT = Style()
#: Levels of nesting that are printed by recursion.
_ROOM = 100


def _compact(x, room: int) -> str:
    kind = type(x)
    if kind is Decimal:
        return number_text(x)
    if kind is str:
        return quoted(x)
    if not room:
        return _printed(x, _COMPACT)
    if kind is Members:
        return "{" + ",".join([f"{quoted(name)}:{_compact(item, room - 1)}" for name, item in x]) + "}"
    if kind is list:
        return "[" + ",".join([_compact(item, room - 1) for item in x]) + "]"
    return "null" if x is None else "true" if x else "false"


def to_text(value, style: Style = _COMPACT) -> str:
    """value as text. Pretty text puts each member and item on a line of its own, but for a container whose only content
    is a scalar or an empty container; compact_array keeps the items of an array on one line."""
    return _compact(value, _ROOM) if style == _COMPACT else _printed(value, style)


def _printed(value, style: Style) -> str:
    """As to_text, for any depth."""
    out: list[str] = []
    step = "\t" if style.tabs else "    "
    colored = (lambda kind, text: f"{_COLORS[kind]}{text}{_PLAIN}") if style.color else (lambda kind, text: text)
    # each entry: ready text, or a value with its depth and whether what is around it keeps to one line
    todo: list = [(value, style.indent)]
    while todo:
        entry = todo.pop()
        if isinstance(entry, str):
            out.append(entry)
            continue
        x, depth = entry
        if isinstance(x, list) and x:
            todo.extend(reversed(list(_parts(x, depth, style, step, colored))))
        elif isinstance(x, list):
            out.append("{}" if isinstance(x, Members) else "[]")
        elif x is None or isinstance(x, bool):
            out.append(colored("literal", "null" if x is None else "true" if x else "false"))
        elif isinstance(x, Decimal):
            out.append(colored("number", number_text(x)))
        else:
            out.append(colored("string", f'"{escape(x, style.escape_slash)}"'))
    return "".join(out)


def _parts(x: list, depth: int, style: Style, step: str, colored):
    is_object = isinstance(x, Members)
    one = x[0][1] if is_object else x[0]
    alone = len(x) == 1 and not (isinstance(one, list) and one)
    lines = style.pretty and not alone and (is_object or not style.compact_array)
    between = ("," if lines or not style.pretty else ", ") if not is_object else ("," if lines else ", " if style.pretty else ",")
    new_line = "\n" + step * (depth + 1) if lines else ""
    yield "{" if is_object else "["
    for i, item in enumerate(by_name(x) if is_object and style.sorted else x):
        yield (between if i else "") + new_line
        if is_object:
            name, item = item
            bare = style.relaxed and _IDENTIFIER.match(name) and name.lower() not in ("true", "false", "null")
            yield colored("name", name if bare else f'"{escape(name, style.escape_slash)}"') + (": " if style.pretty else ":")
        yield (item, depth + 1)
    if lines:
        yield "\n" + step * depth
    yield "}" if is_object else "]"
