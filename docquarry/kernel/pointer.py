"""JSON Pointer (RFC 6901)."""

from __future__ import annotations

import re

from .model import Members

_INDEX = re.compile(r"(?:0|[1-9][0-9]*)\Z", re.A)


class PointerError(ValueError):
    pass


class _Nothing:
    """What a pointer finds when it finds nothing; JSON null is something."""

    def __bool__(self) -> bool:
        return False

    def __repr__(self) -> str:
        return "NOTHING"


NOTHING = _Nothing()


def escape_token(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def unescape_token(token: str) -> str:
    return token.replace("~1", "/").replace("~0", "~")


def parse_pointer(text: str) -> list[str]:
    """The unescaped tokens; PointerError unless text is empty or begins with a slash."""
    if not text:
        return []
    if not text.startswith("/"):
        raise PointerError(f"a JSON pointer is empty or begins with '/': {text!r}")
    return [unescape_token(t) for t in text[1:].split("/")]


def pointer_text(tokens: list[str]) -> str:
    return "".join("/" + escape_token(t) for t in tokens)


def index_of(token: str) -> int | None:
    """The array index that a token stands for, if it does."""
    return int(token) if _INDEX.match(token) else None


def child(value, token: str):
    if isinstance(value, Members):
        at = value.find(token)
        return NOTHING if at < 0 else value[at][1]
    if isinstance(value, list):
        at = index_of(token)
        return NOTHING if at is None or at >= len(value) else value[at]
    return NOTHING


def find(value, tokens: list[str]):
    """What tokens lead to from value, or NOTHING. Of members with one name, the last counts."""
    for token in tokens:
        value = child(value, token)
        if value is NOTHING:
            return NOTHING
    return value


def walk(value, tokens: tuple[str, ...] = ()):
    """(tokens, value) of value and everything inside it, in document order."""
    todo = [(tokens, value)]
    while todo:
        at, x = todo.pop()
        yield at, x
        if isinstance(x, Members):
            todo.extend(((*at, name), item) for name, item in reversed(x))
        elif isinstance(x, list):
            todo.extend(((*at, str(i)), x[i]) for i in range(len(x) - 1, -1, -1))
