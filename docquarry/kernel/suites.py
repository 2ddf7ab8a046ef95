"""Test cases kept as documents, as public conformance suites lay them out: how each one comes out.

A case of patches has doc, patch, and expected (the document after it) or error (the patch must fail); one whose patch only
tests needs neither. A group of schema cases has schema and tests, each with data and valid. disabled, or a comment alone,
puts a case aside.
"""

from __future__ import annotations

from .model import Members, equal
from .patch import patch
from .schema import InvalidSchema, JsonSchema

PASSED, FAILED, DISABLED, INVALID = STATUSES = ("passed", "failed", "disabled", "invalid")


def _fields(value) -> dict:
    return value.latest() if isinstance(value, Members) else {}


def _aside(case: dict, run_disabled: bool) -> bool:
    return set(case) == {"comment"} or (case.get("disabled") is True and not run_disabled)


def patch_case(value, run_disabled: bool = False, rfc: bool = False) -> str:
    case = _fields(value)
    if _aside(case, run_disabled):
        return DISABLED
    steps = case.get("patch")
    if "doc" not in case or isinstance(steps, Members) or not isinstance(steps, list):
        return INVALID
    only_tests = all(_fields(step).get("op") == "test" for step in steps)
    if not only_tests and "expected" not in case and "error" not in case:
        return INVALID
    ok, _, after = patch(case["doc"], steps, rfc)
    if "expected" in case:
        return PASSED if ok and (only_tests or equal(after, case["expected"])) else FAILED
    return PASSED if ok != ("error" in case) else FAILED


def schema_cases(value, run_disabled: bool = False) -> list[str]:
    """The status of each test of a group, in order; of a group that is none, or has no usable schema, invalid for each, once at least."""
    group = _fields(value)
    tests = group.get("tests")
    if "schema" not in group or isinstance(tests, Members) or not isinstance(tests, list):
        return [INVALID]
    try:
        schema = JsonSchema(group["schema"])
    except InvalidSchema:
        return [INVALID] * max(1, len(tests))
    out = []
    for test in map(_fields, tests):
        if _aside(test, run_disabled):
            out.append(DISABLED)
        elif "data" not in test or not isinstance(test.get("valid"), bool):
            out.append(INVALID)
        else:
            out.append(PASSED if schema.is_valid(test["data"]) == test["valid"] else FAILED)
    return out
