"""JSON Schema 2020-12: loading on the driver, validation anywhere."""

from .engine import JsonSchema
from .loading import InvalidSchema

__all__ = ["InvalidSchema", "JsonSchema"]
