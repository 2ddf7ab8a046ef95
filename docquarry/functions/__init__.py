"""Functions over columns of JSON text."""

from . import entries
from .columns import *  # noqa: F403
from .registry import register_all

__all__ = [name for name in dir() if name.startswith(("json_", "pointer_"))] + ["entries", "register_all"]
