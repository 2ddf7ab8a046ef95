"""JSON Patch (RFC 6902) on values.

Operations go on after one that fails, each with a result of its own, unless `atomic` asks for all or nothing. As an
extension, remove and replace take "-" for the last item of an array, unless `rfc` is set.
"""

from __future__ import annotations

import functools

from .model import Members, copied, equal
from .pointer import NOTHING, PointerError, find, index_of, parse_pointer

# fixed values: results of an operation
OK, FAIL, NOENT, INVALID = "patch_ok", "patch_fail", "patch_noent", "patch_invalid"


class _Stop(Exception):
    def __init__(self, result: str):
        self.result = result


def _field(operation: Members, name: str):
    """The only member of that name; an operation that repeats or lacks it is invalid."""
    values = [v for k, v in operation if k == name]
    if len(values) != 1:
        raise _Stop(INVALID)
    return values[0]


_tokens = functools.lru_cache(1024)(parse_pointer)  # nobody changes the lists


def _path(operation: Members, name: str) -> list[str]:
    text = _field(operation, name)
    if not isinstance(text, str):
        raise _Stop(INVALID)
    try:
        return _tokens(text)
    except PointerError:
        raise _Stop(INVALID) from None


class Patcher:
    def __init__(self, value, rfc: bool = False):
        self.value, self.rfc = value, rfc

    def _parent(self, path: list[str]):
        parent = find(self.value, path[:-1])
        if not isinstance(parent, list):
            raise _Stop(NOENT)
        return parent, path[-1]

    def _existing(self, path: list[str]):
        """The container and the place in it that path leads to."""
        parent, token = self._parent(path)
        if isinstance(parent, Members):
            at = parent.find(token)
        elif token == "-" and not self.rfc:
            at = len(parent) - 1
        else:
            index = index_of(token)
            at = index if index is not None and index < len(parent) else -1
        if at < 0:
            raise _Stop(NOENT)
        return parent, at

    def add(self, path: list[str], value) -> None:
        if not path:
            self.value = value
            return
        parent, token = self._parent(path)
        if isinstance(parent, Members):
            at = parent.find(token)
            if at < 0:
                parent.append((token, value))
            else:
                parent[at] = (token, value)
            return
        at = len(parent) if token == "-" else index_of(token)
        if at is None or at > len(parent):
            raise _Stop(NOENT)
        parent.insert(at, value)

    def remove(self, path: list[str]) -> None:
        if not path:
            self.value = None
            return
        parent, at = self._existing(path)
        if isinstance(parent, Members):
            name = parent[at][0]
            parent[:] = [m for m in parent if m[0] != name]
        else:
            del parent[at]

    def replace(self, path: list[str], value) -> None:
        if not path:
            self.value = value
            return
        parent, at = self._existing(path)
        parent[at] = (parent[at][0], value) if isinstance(parent, Members) else value

    def source(self, path: list[str]):
        value = find(self.value, path)
        if value is NOTHING:
            raise _Stop(NOENT)
        return value

    def apply(self, operation) -> str:
        try:
            if not isinstance(operation, Members):
                raise _Stop(INVALID)
            name, path = _field(operation, "op"), _path(operation, "path")
            if name == "add":
                self.add(path, copied(_field(operation, "value")))
            elif name == "remove":
                self.remove(path)
            elif name == "replace":
                self.replace(path, copied(_field(operation, "value")))
            elif name == "copy":
                self.add(path, copied(self.source(_path(operation, "from"))))
            elif name == "move":
                origin = _path(operation, "from")
                value = self.source(origin)
                if path[: len(origin)] == origin and path != origin:
                    raise _Stop(INVALID)  # a value can't move into itself
                if path != origin:
                    before = copied(self.value)
                    self.remove(origin)
                    try:
                        self.add(path, value)
                    except _Stop:
                        self.value = before
                        raise
            elif name == "test":
                found = self.source(path)
                if not equal(found, _field(operation, "value")):
                    raise _Stop(FAIL)
            else:
                raise _Stop(INVALID)
        except _Stop as stop:
            return stop.result
        return OK


def patch(value, operations, rfc: bool = False, atomic: bool = False) -> tuple[bool, list[str], object]:
    """(all operations succeeded, the result of each, the value after them). operations: an array of them, or one."""
    patcher = Patcher(copied(value), rfc)
    results = []
    for operation in [operations] if isinstance(operations, Members) or not isinstance(operations, list) else operations:
        results.append(patcher.apply(operation))
        if atomic and results[-1] != OK:
            return False, results, value
    return all(r == OK for r in results), results, patcher.value


