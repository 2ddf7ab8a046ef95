"""The parts of URIs that schemas need."""

from __future__ import annotations

import re
from urllib.parse import unquote

_PARTS = re.compile(r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)


def split(uri: str) -> tuple[str, str | None]:
    """The URI without its fragment, and the decoded fragment or None."""
    before, mark, fragment = uri.partition("#")
    return before, unquote(fragment) if mark else None


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part in (".", ".."):
            if part == ".." and len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def resolve(base: str, uri: str) -> str:
    """uri as seen from base (RFC 3986, section 5); the fragment stays."""
    scheme, authority, path, query, fragment = _PARTS.match(uri).groups()
    if scheme is not None:
        return uri
    b_scheme, b_authority, b_path, b_query, _ = _PARTS.match(base).groups()
    if authority is None:
        authority = b_authority
        if not path:
            path, query = b_path, b_query if query is None else query
        elif not path.startswith("/"):
            path = _without_dots((b_path[: b_path.rfind("/") + 1] or ("/" if b_authority is not None else "")) + path)
        else:
            path = _without_dots(path)
    out = f"{b_scheme}:" if b_scheme is not None else ""
    out += f"//{authority}" if authority is not None else ""
    out += path
    out += f"?{query}" if query is not None else ""
    return out + (f"#{fragment}" if fragment is not None else "")
