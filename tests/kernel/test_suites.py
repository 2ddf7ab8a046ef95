import pytest

from docquarry.kernel.parser import parse
from docquarry.kernel.suites import patch_case, schema_cases

CASES = [
    ('{"doc":{},"patch":[{"op":"add","path":"/a","value":1}],"expected":{"a":1.0}}', "passed"),
    ('{"doc":{},"patch":[{"op":"add","path":"/a","value":1}],"expected":{}}', "failed"),
    ('{"doc":{},"patch":[{"op":"remove","path":"/a"}],"expected":{}}', "failed"),
    ('{"doc":{},"patch":[{"op":"remove","path":"/a"}],"error":"no such member"}', "passed"),
    ('{"doc":{"a":1},"patch":[{"op":"remove","path":"/a"}],"error":"none"}', "failed"),
    ('{"doc":{"a":1},"patch":[{"op":"remove","path":"/a"}]}', "invalid"),
    ('{"doc":[1],"patch":[{"op":"test","path":"/0","value":1}]}', "passed"),
    ('{"doc":[1],"patch":[{"op":"test","path":"/0","value":2}]}', "failed"),
    ('{"doc":[1],"patch":[],"expected":[2]}', "passed"),
    ('{"patch":[]}', "invalid"),
    ('{"doc":1,"patch":{"op":"test"}}', "invalid"),
    ('{"doc":1,"patch":[null],"error":"no operation"}', "passed"),
    ('{"comment":"only"}', "disabled"),
    ("[]", "invalid"),
    ("null", "invalid"),
]


@pytest.mark.parametrize("text, status", CASES)
def test_patch_cases(text, status):
    assert patch_case(parse(text)) == status


def test_disabled_cases_run_if_asked_to():
    case = parse('{"doc":1,"patch":[{"op":"test","path":"","value":2}],"disabled":true}')
    assert patch_case(case) == "disabled" and patch_case(case, run_disabled=True) == "failed"


def test_schema_cases():
    group = '{"schema":{"type":"integer"},"tests":[{"data":1,"valid":true},{"data":"1","valid":true},{"data":"1","valid":false},{"data":1},{"data":1,"valid":true,"disabled":true},3]}'
    assert schema_cases(parse(group)) == ["passed", "failed", "passed", "invalid", "disabled", "invalid"]
    assert schema_cases(parse('{"schema":{"type":1},"tests":[{},{}]}')) == ["invalid", "invalid"]
    assert schema_cases(parse('{"schema":true}')) == schema_cases(parse("[]")) == ["invalid"]
