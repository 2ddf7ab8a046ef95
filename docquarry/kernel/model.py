"""JSON values in plain Python: None, bool, Decimal, str, list, and Members for objects.

Nothing here imports Spark or keeps state between calls.
"""

from __future__ import annotations

import re
from decimal import Decimal
from functools import cmp_to_key
from operator import itemgetter

TYPES = ("null", "boolean", "number", "string", "array", "object")
#: Order of values of different types.
_RANK = {name: i for i, name in enumerate(TYPES)}


class Members(list):
    """The members of an object as (name, value) pairs: in order, and a name may occur more than once."""

    __slots__ = ()

    def find(self, name: str) -> int:
        """The place of the last member of that name, or -1."""
        for i in range(len(self) - 1, -1, -1):
            if self[i][0] == name:
                return i
        return -1

    def latest(self) -> dict:
        """Name to value; of equal names the last counts."""
        return dict(self)


def type_name(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Decimal):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, Members) else "array"


def default_of(name: str):
    """The value that a newly made value of a type has."""
    makers = {"null": lambda: None, "boolean": lambda: False, "number": lambda: Decimal(0), "string": str, "array": list, "object": Members}
    if name not in makers:
        raise ValueError(f"no JSON type is called {name!r}")
    return makers[name]()


def number_text(number: Decimal) -> str:
    """Digits without trailing zeros, and an exponent only for more than 16 digits before, or 3 zeros behind, the point."""
    text = str(number)
    if len(text) <= 16 and text.isdigit():
        return text
    sign, digits, exponent = number.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    point = len(text) + exponent  # the value is 0.text times ten to this power
    text = text.rstrip("0")
    if not text:
        return "0"
    minus = "-" if sign else ""
    mantissa = text[0] + ("." + text[1:] if len(text) > 1 else "")
    if point >= len(text) and point != 0:
        return f"{minus}{mantissa}e+{point - 1}" if point > 16 else minus + text + "0" * (point - len(text))
    if point < -3:
        return f"{minus}{mantissa}e{point - 1}"
    if point > 0:
        return f"{minus}{text[:point]}.{text[point:]}"
    return f"{minus}0.{'0' * -point}{text}"


_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\", "/": "\\/"}
_PLAIN = re.compile(r'[\x00-\x1f"\\]')
_WITH_SLASH = re.compile(r'[\x00-\x1f"\\/]')


def escape(text: str, slash: bool = False) -> str:
    """text as it stands between the quotes of a JSON string."""
    return (_WITH_SLASH if slash else _PLAIN).sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", text)


_CODE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.)|$)", re.S)
_UNESCAPES = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\", "/": "/"}
_SURROGATE = re.compile("[\ud800-\udfff]")


def unescape(text: str) -> str:
    """The inverse of escape. ValueError for an unknown escape or half a surrogate pair."""
    if "\\" not in text:
        return text

    def of(m):
        if m[1]:
            return chr(int(m[1], 16))
        if m[2] not in _UNESCAPES:
            raise ValueError(f"invalid escape {m[0]!r}")
        return _UNESCAPES[m[2]]

    out = _CODE.sub(of, text)
    if _SURROGATE.search(out):
        # neighbouring halves make one character; a half alone can't be encoded
        out = out.encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    return out


def by_name(members: Members) -> list[tuple[str, object]]:
    """Members in the byte order of their names; equal names keep their order."""
    return sorted(members, key=itemgetter(0))  # characters are in the order of their bytes in UTF-8


def canonical(value) -> str:
    """One text for all equal values: members sorted by name, numbers in their shortest form, no spaces."""
    out, todo = [], [(value,)]
    # explicit stack: documents may be nested deeper than Python recurses
    while todo:
        x = todo.pop()
        if not isinstance(x, tuple):
            out.append(x)
            continue
        x = x[0]
        if x is None:
            out.append("null")
        elif isinstance(x, bool):
            out.append("true" if x else "false")
        elif isinstance(x, Decimal):
            out.append(number_text(x))
        elif isinstance(x, str):
            out.append(f'"{escape(x)}"')
        elif isinstance(x, Members):
            out.append("{")
            todo.append("}")
            pairs = by_name(x)
            for i in range(len(pairs) - 1, -1, -1):
                todo.append((pairs[i][1],))
                todo.append(("," if i else "") + f'"{escape(pairs[i][0])}":')
        else:
            out.append("[")
            todo.append("]")
            for i in range(len(x) - 1, -1, -1):
                todo.append((x[i],))
                if i:
                    todo.append(",")
    return "".join(out)


#: Levels of nesting that are compared or copied by recursion.
_ROOM = 100


def copied(value, room: int = _ROOM):
    """A copy that shares no container with value."""
    if not isinstance(value, list):
        return value
    if room and isinstance(value, Members):
        return Members([(name, copied(x, room - 1) if isinstance(x, list) else x) for name, x in value])
    if room:
        return [copied(x, room - 1) if isinstance(x, list) else x for x in value]
    out = type(value)()
    todo = [(value, out)]
    while todo:
        old, new = todo.pop()
        for item in old:
            inner = item[1] if isinstance(old, Members) else item
            if isinstance(inner, list):
                made = type(inner)()
                todo.append((inner, made))
                inner = made
            new.append((item[0], inner) if isinstance(old, Members) else inner)
    return out


def equal(a, b, room: int = _ROOM) -> bool:
    kind = type(a)
    if kind is not type(b):
        return False
    if kind is not Members and kind is not list:
        return a == b
    if len(a) != len(b):
        return False
    if not room:
        return _equal_at_any_depth(a, b)
    if kind is list:
        for x, y in zip(a, b, strict=True):
            if not equal(x, y, room - 1):
                return False
        return True
    theirs = dict(b)
    if len(theirs) < len(b) or len(ours := dict(a)) < len(a):
        return _equal_at_any_depth(a, b)  # repeated names
    if ours.keys() != theirs.keys():
        return False
    for name, item in a:
        if not equal(item, theirs[name], room - 1):
            return False
    return True


def _equal_at_any_depth(a, b) -> bool:
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if type(x) is not type(y):
            return False
        if not isinstance(x, list):
            if x != y:
                return False
        elif len(x) != len(y):
            return False
        elif isinstance(x, Members):
            for (name, item), (other, its) in zip(by_name(x), by_name(y), strict=True):
                if name != other:
                    return False
                todo.append((item, its))
        else:
            todo.extend(zip(x, y, strict=True))
    return True


def compare(a, b) -> int:
    """-1, 0 or 1 in a total order: by type (null, boolean, number, string, array, object), then by value."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        kind, other = type_name(x), type_name(y)
        if kind != other:
            return -1 if _RANK[kind] < _RANK[other] else 1
        if kind == "null":
            continue
        if kind in ("boolean", "number", "string"):
            if kind == "string":
                x, y = x.encode("utf-8", "surrogatepass"), y.encode("utf-8", "surrogatepass")
            if x != y:
                return -1 if x < y else 1
            continue
        if kind == "object":
            x = [part for pair in by_name(x) for part in pair]
            y = [part for pair in by_name(y) for part in pair]
        steps = list(zip(x, y, strict=False))
        if len(x) != len(y):
            # after all common parts, the shorter one comes first
            stack.append((Decimal(len(x)), Decimal(len(y))))
        stack.extend(reversed(steps))
    return 0


def sort_array(items: list) -> list:
    return sorted(items, key=cmp_to_key(compare))


def unique(items: list) -> bool:
    return len({canonical(x) for x in items}) == len(items)
