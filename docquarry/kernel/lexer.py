"""Tokens of JSON text, strict (RFC 8259) or relaxed (comments and identifiers as well)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# fixed values: names of tokens and of lexical errors
LCBRACK, RCBRACK, LBRACK, RBRACK, SEPARATOR, COLON = "LCBRACK", "RCBRACK", "LBRACK", "RBRACK", "SEPARATOR", "COLON"
NULL, TRUE, FALSE, STRING, NUMBER, IDENTIFIER, COMMENT, INVALID = "NULL", "TRUE", "FALSE", "STRING", "NUMBER", "IDENTIFIER", "COMMENT", "INVALID"

_PUNCTUATION = {"{": LCBRACK, "}": RCBRACK, "[": LBRACK, "]": RBRACK, ",": SEPARATOR, ":": COLON}
_LITERALS = {"null": NULL, "true": TRUE, "false": FALSE}

_SPACE = re.compile(r"[\t\r \n]*")
_WORD = re.compile(r"[_a-zA-Z][_a-zA-Z0-9]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_CONTENT = r'[^"\\\x00-\x1f]*(?:\\(?:["\\bfnrt/]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*'
_STRING, _STRING_PART = re.compile(f'"({_CONTENT})"'), re.compile(_CONTENT)
#: Space and a token that is right as it stands: punctuation, a string, a number that ends where its digits do, or a word.
_SOUND = re.compile(rf'[\t\r \n]*(?:([{{}}\[\],:])|"({_CONTENT})"|({_NUMBER.pattern})(?![.0-9A-Za-z_])|({_WORD.pattern}))')
_LINE_COMMENT = re.compile(r"//[^\n]*")
_BLOCK_COMMENT = re.compile(r"/\*.*?\*/", re.S)


class Token(NamedTuple):
    type: str
    row: int
    col: int
    data: str
    error: str | None
    start: int


class Lexer:
    """Splits text into tokens; rows and columns count from 0, columns in bytes of UTF-8.

    Without `places`, tokens have no row and column; place() finds them from a token's start.
    """

    def __init__(self, text: str, strict: bool = True, places: bool = True):
        self.text, self.strict, self.places = text, strict, places
        self.ascii = text.isascii()
        self.at = 0
        self.seen = self.row = self.col = 0

    def place(self, at: int) -> tuple[int, int]:
        """Row and column of a place in the text. Places that are asked for in order cost what lies between them."""
        if at < self.seen:
            self.seen = self.row = self.col = 0
        text, start = self.text, self.seen
        if breaks := text.count("\n", start, at):
            self.row += breaks
            start, self.col = text.rindex("\n", start, at) + 1, 0
        self.col += at - start if self.ascii else len(text[start:at].encode("utf-8", "surrogatepass"))
        self.seen = at
        return self.row, self.col

    def _token(self, kind: str, end: int, data: str | None = None, error: str | None = None, error_at: int | None = None) -> Token:
        start = self.at
        at = start if error_at is None else error_at
        row, col = self.place(at) if self.places else (-1, -1)
        self.at = end
        return Token(kind, row, col, self.text[start:end] if data is None else data, error, at)

    def _invalid(self, error: str, at: int) -> Token:
        return self._token(INVALID, len(self.text), "", error, at)

    def next(self) -> Token | None:
        text = self.text
        if not self.places and (sound := _SOUND.match(text, self.at)):
            which = sound.lastindex
            data = sound[which]
            kind = (None, _PUNCTUATION.get(data), STRING, NUMBER, _LITERALS.get(data, None if self.strict else IDENTIFIER))[which]
            if kind is not None:
                self.at = end = sound.end()
                return Token(kind, -1, -1, data, None, end - len(data) - 2 * (which == 2))
        self.at = _SPACE.match(text, self.at).end()
        if self.at >= len(text):
            return None
        c = text[self.at]
        if c in _PUNCTUATION:
            return self._token(_PUNCTUATION[c], self.at + 1)
        if c == '"':
            return self._string()
        if c == "-" or "0" <= c <= "9":
            return self._number()
        if word := _WORD.match(text, self.at):
            if word[0] in _LITERALS:
                return self._token(_LITERALS[word[0]], word.end())
            if not self.strict:
                return self._token(IDENTIFIER, word.end())
            return self._invalid("err_invalid", self.at)
        if c == "/" and not self.strict:
            if comment := _LINE_COMMENT.match(text, self.at) or _BLOCK_COMMENT.match(text, self.at):
                return self._token(COMMENT, comment.end())
            return self._invalid("err_eob" if text.startswith("/*", self.at) else "err_unexpected_char", self.at)
        return self._invalid("err_unexpected_char", self.at)

    def _string(self) -> Token:
        if whole := _STRING.match(self.text, self.at):
            return self._token(STRING, whole.end(), whole[1])
        end = _STRING_PART.match(self.text, self.at + 1).end()
        escape = end < len(self.text) and self.text[end] == "\\" and end + 1 < len(self.text)
        return self._invalid("err_string_escape" if escape else "err_string_unterminated", end if escape else self.at)

    def _number(self) -> Token:
        text, found = self.text, _NUMBER.match(self.text, self.at)
        if not found:
            return self._invalid("err_number_lone_minus", self.at)
        end = found.end()
        follows = text[end : end + 1]
        if follows == ".":
            return self._invalid("err_number_no_frac", self.at)
        if follows in ("e", "E"):
            return self._invalid("err_number_no_exp", self.at)
        if follows and (follows.isalnum() and follows.isascii() or follows == "_"):
            return self._invalid("err_number", self.at)
        return self._token(NUMBER, end)


def tokens(text: str, strict: bool = True) -> Iterator[Token]:
    """All tokens; an invalid one is the last."""
    lexer = Lexer(text, strict)
    while (token := lexer.next()) is not None:
        yield token
        if token.error:
            return
