"""Plan-time compilation: literal pointers and schemas become native column expressions over VARIANT.

These paths are for clean documents (no repeated names, no numbers beyond 38 digits, no text behind the document), which
the caller vouches for by choosing them. They stay inside the JVM, so filters and code generation reach through them.
"""

from .pointers import native_get, native_text
from .schemas import NotCompilable, compiled_valid, schema_predicate

__all__ = ["NotCompilable", "compiled_valid", "native_get", "native_text", "schema_predicate"]
