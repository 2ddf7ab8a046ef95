"""Parsing of JSON text: strict RFC 8259, or a relaxed dialect with comments, identifiers as names, split strings and
trailing separators.

Text goes through Python's C decoder first, relaxed text after one regular expression has made it strict. Whatever that
refuses, and whatever needs limits or positions, goes through a token loop with an explicit stack, so nesting has no bound
but memory.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation

from . import lexer as lx
from .model import Members, _SURROGATE, unescape

# fixed values: the error codes and their messages
MESSAGES = {
    "ok": "Ok.",
    "invalid_string": "Invalid string",
    "unterminated_string": "Unterminated string",
    "invalid_escape_code": "Invalid escape code in string",
    "invalid_utf8": "Invalid UTF8 code in string",
    "invalid_number": "Invalid number",
    "number_out_of_range": "Number out of range",
    "invalid_token": "Invalid token",
    "misplaced_right_curly_bracket": "Misplaced '}'",
    "misplaced_right_bracket": "Misplaced ']'",
    "misplaced_separator": "Misplaced ','",
    "misplaced_colon": "Misplaced ':'",
    "expected_separator_or_right_curly_bracket": "Expected ',' or '}'",
    "expected_separator_or_right_bracket": "Expected ',' or ']'",
    "expected_obj_member_name": "Expected object member name",
    "expected_colon": "Expected ':'",
    "duplicate_obj_member": "Duplicate object member name found.",
    "unterminated_array": "Unterminated array",
    "unterminated_object": "Unterminated object",
    "unexpected_character": "Unexpected character",
    "max_depth_exceeded": "Maximum nesting depth exceeded.",
    "max_array_size_exceeded": "Maximum number of array items exceeded.",
    "max_obj_size_exceeded": "Maximum number of object members exceeded.",
    "eob": "Unexpected end of file/buffer",
    "io": "I/O error",
    "internal": "Internal error",
}
_OF_TOKEN = {
    "err_string": "invalid_string",
    "err_string_unterminated": "unterminated_string",
    "err_string_escape": "invalid_escape_code",
    "err_string_utf8": "invalid_utf8",
    "err_number": "invalid_number",
    "err_number_lone_minus": "invalid_number",
    "err_number_no_frac": "invalid_number",
    "err_number_no_exp": "invalid_number",
    "err_invalid": "invalid_token",
    "err_unexpected_char": "unexpected_character",
    "err_eob": "eob",
}
#: Decimal holds exponents up to this size exactly.
_MOST_EXPONENT = 10**15


class ParseError(ValueError):
    def __init__(self, code: str, row: int, col: int):
        self.code, self.row, self.col = code, row, col
        super().__init__(f"{MESSAGES[code]} at line {row + 1}, column {col}")

    @property
    def message(self) -> str:
        return str(self)


#: What may be an escaped half of a surrogate pair; where it stands, the token loop looks closer.
_HALF = re.compile(r"\\u[dD][89a-fA-F]")


class _TooFar(ValueError):
    pass


def number(text: str) -> Decimal:
    if len(text) < 16 and text.isdigit():  # too short to be too far
        return Decimal(text)
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise _TooFar from None
    if not value.is_finite() or value and abs(value.adjusted()) > _MOST_EXPONENT:
        raise _TooFar
    return value


def _refuse(_):
    raise ValueError


class _Repeated(ValueError):
    pass


def _only_once(pairs):
    if len({name for name, _ in pairs}) != len(pairs):
        raise _Repeated
    return Members(pairs)


_DECODERS = {duplicates: json.JSONDecoder(object_pairs_hook=Members if duplicates else _only_once, parse_int=Decimal, parse_float=number, parse_constant=_refuse) for duplicates in (True, False)}


_BETWEEN = r"(?:[\t\r \n]++|//[^\n]*+|/\*[\s\S]*?\*/)*+"
#: What relaxed text has to be searched for: strings, with those that follow one; words, names among them; a separator before an
#: end; comments; and what leaves it to the token loop, such as a quote that begins no sound string.
_RELAXED = re.compile(
    rf'"{lx._CONTENT}"(?P<more>(?:{_BETWEEN}"{lx._CONTENT}")++)?+|(?P<name>{lx._WORD.pattern}+)(?={_BETWEEN}:)|{lx._WORD.pattern}+'
    rf'|(?P<last>,)(?={_BETWEEN}[\]}}])|(?P<comment>//[^\n]*+|/\*[\s\S]*?\*/)|(?P<unclear>["/]|[\[{{](?={_BETWEEN},))'
)
_NEXT_STRING = re.compile(f'{_BETWEEN}"({lx._CONTENT})"')


def _made_strict(found: re.Match) -> str:
    kind = found.lastgroup
    if kind is None:
        return found[0]
    if kind == "name":
        return found[0] if found[0] in lx._LITERALS else f'"{found[0]}"'
    if kind == "more":
        return f'"{"".join(_NEXT_STRING.findall(found[0]))}"'
    if kind == "unclear":
        raise ValueError
    return " "


def parse(text: str | bytes, strict: bool = True, allow_duplicates: bool = True, max_depth: int = 0, max_array_size: int = 0, max_object_size: int = 0):
    """The value of a document; ParseError if it has none. A limit of 0 is none."""
    if isinstance(text, (bytes, bytearray)):
        try:
            text = bytes(text).decode("utf-8")
        except UnicodeDecodeError as e:
            before = bytes(text[: e.start])
            raise ParseError("invalid_utf8", before.count(b"\n"), len(before) - before.rfind(b"\n") - 1) from None
    if not (max_depth or max_array_size or max_object_size):
        try:
            value = _DECODERS[allow_duplicates].decode(text if strict else _RELAXED.sub(_made_strict, text))
            if (text.isascii() or not _SURROGATE.search(text)) and not ("\\u" in text and _HALF.search(text)):
                return value
        except (ValueError, RecursionError):
            pass
    return _Parser(text, strict, allow_duplicates, max_depth, max_array_size, max_object_size).document()


def is_valid(text, **options) -> bool:
    try:
        parse(text, **options)
    except ParseError:
        return False
    return True


class _Parser:
    def __init__(self, text, strict, allow_duplicates, max_depth, max_array_size, max_object_size):
        self.lexer, self.strict, self.allow_duplicates = lx.Lexer(text, strict, places=False), strict, allow_duplicates
        self.max_depth, self.max_array_size, self.max_object_size = max_depth, max_array_size, max_object_size
        self.token = None
        self.whole = text.isascii() or not _SURROGATE.search(text)

    def advance(self) -> lx.Token | None:
        """Moves to the next token that is no comment, and returns it."""
        while True:
            self.token = self.lexer.next()
            if self.token is None or self.token.type != lx.COMMENT:
                break
        if self.token is not None and self.token.error:
            self.fail(_OF_TOKEN[self.token.error])
        return self.token

    def fail(self, code: str):
        raise ParseError(code, *self.lexer.place(len(self.lexer.text) if self.token is None else self.token.start))

    def content(self) -> str:
        """What stands between the quotes of the current token."""
        data = self.token.data
        if self.whole and "\\" not in data:
            return data
        try:
            data = unescape(data)
        except UnicodeError:
            self.fail("invalid_utf8")
        except ValueError:
            self.fail("invalid_escape_code")
        if _SURROGATE.search(data):
            self.fail("invalid_utf8")
        return data

    def string(self) -> str:
        """The string at the current token, with those that follow it in the relaxed dialect; moves past it."""
        first = self.content()
        if self.advance() is None or self.strict or self.token.type != lx.STRING:
            return first
        out = [first]
        while self.token is not None and self.token.type == lx.STRING:
            out.append(self.content())
            self.advance()
        return "".join(out)

    def scalar(self):
        """The scalar at the current token; moves past it."""
        kind = self.token.type
        if kind == lx.STRING:
            return self.string()
        if kind == lx.NUMBER:
            try:
                value = number(self.token.data)
            except _TooFar:
                self.fail("number_out_of_range")
        elif kind in (lx.NULL, lx.TRUE, lx.FALSE):
            value = {lx.NULL: None, lx.TRUE: True, lx.FALSE: False}[kind]
        else:
            self.fail({lx.RCBRACK: "misplaced_right_curly_bracket", lx.RBRACK: "misplaced_right_bracket", lx.SEPARATOR: "misplaced_separator", lx.COLON: "misplaced_colon"}.get(kind, "invalid_token"))
        self.advance()
        return value

    def document(self):
        if self.advance() is None:
            raise ParseError("eob", 0, 0)
        open_: list[tuple] = []  # (container, names so far or None, name of the member being read)
        while True:
            # a value begins at the token
            value, closed = None, True
            if self.token.type in (lx.LBRACK, lx.LCBRACK):
                if self.max_depth and len(open_) >= self.max_depth:
                    self.fail("max_depth_exceeded")
                is_array = self.token.type == lx.LBRACK
                open_.append(([], None) if is_array else (Members(), set()))
                name = None
                if self.advance() is None:
                    self.fail("unterminated_array" if is_array else "unterminated_object")
                if self.token.type == (lx.RBRACK if is_array else lx.RCBRACK):
                    value = open_.pop()[0]
                    self.advance()
                else:
                    closed = False
            else:
                value = self.scalar()
            # what was read goes into what is open, as far as that ends
            while closed and open_:
                container, names = open_[-1]
                if names is None:
                    container.append(value)
                    if self.max_array_size and len(container) > self.max_array_size:
                        self.fail("max_array_size_exceeded")
                else:
                    container[-1] = (container[-1][0], value)
                end = lx.RBRACK if names is None else lx.RCBRACK
                if self.token is None:
                    self.fail("unterminated_array" if names is None else "unterminated_object")
                if self.token.type == lx.SEPARATOR:
                    if self.advance() is None:
                        self.fail("unterminated_array" if names is None else "unterminated_object")
                    if self.token.type != end or self.strict:
                        closed = False
                        break
                elif self.token.type != end:
                    self.fail("expected_separator_or_right_bracket" if names is None else "expected_separator_or_right_curly_bracket")
                value = open_.pop()[0]
                self.advance()
            if not open_:
                if self.token is not None:
                    self.fail("unexpected_character")
                return value
            if not closed and open_[-1][1] is not None:
                self.member_name(*open_[-1])

    def member_name(self, container: Members, names: set) -> None:
        """Reads a name and its colon, and leaves the member's place in container."""
        token = self.token
        if token.type == lx.STRING:
            name = self.string()
        elif not self.strict and token.type == lx.IDENTIFIER:
            name = token.data
            self.advance()
        else:
            self.fail("expected_obj_member_name")
        after, self.token = self.token, token
        if not self.allow_duplicates and name in names:
            self.fail("duplicate_obj_member")
        if self.max_object_size and len(container) >= self.max_object_size:
            self.fail("max_obj_size_exceeded")
        self.token = after
        names.add(name)
        if after is None:
            self.fail("unterminated_object")
        if after.type != lx.COLON:
            self.fail("expected_colon")
        container.append((name, None))
        if self.advance() is None:
            self.fail("unterminated_object")
