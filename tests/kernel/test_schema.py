import pytest

from docquarry.kernel.model import Members
from docquarry.kernel.parser import parse
from docquarry.kernel.printer import to_text
from docquarry.kernel.schema import InvalidSchema, JsonSchema
from docquarry.kernel.schema.uri import resolve

TREE = '{"$id":"http://localhost:1234/strict-tree.json","$dynamicAnchor":"node","$ref":"tree","unevaluatedProperties":false,"$defs":{"t":{"$id":"tree","$dynamicAnchor":"node","type":"object","properties":{"data":true,"children":{"type":"array","items":{"$dynamicRef":"#node"}}}}}}'
# schema, valid instances, invalid instances
CASES = [
    ('{"type":"integer"}', ["1", "1.0", "1e3"], ["1.5", '"1"', "true"]),
    ('{"type":["null","object"]}', ["null", "{}"], ["[]", "0"]),
    ('{"enum":[{"a":1,"b":2},null]}', ['{"b":2,"a":1.0}', "null"], ["false", '{"a":1}']),
    ('{"const":[1]}', ["[1.0]"], ["[1,1]", "1"]),
    ('{"multipleOf":0.1}', ["0.3", "1e300", '"x"'], ["0.35", "1e-400"]),
    ('{"minimum":1,"exclusiveMaximum":2}', ["1", "1.99", '"x"'], ["0.99", "2"]),
    ('{"minLength":2,"maxLength":3}', ['"😀😀"', '"abc"'], ['"a"', '"abcd"']),
    ('{"pattern":"^\\\\d+$"}', ['"12"'], ['"12\\n"', '"x"', '"١"']),
    ('{"minItems":1,"maxItems":2,"uniqueItems":true}', ["[1]", "[1,2]"], ["[]", "[1,2,3]", "[1,1.0]"]),
    ('{"minProperties":1,"maxProperties":2}', ['{"a":1}', '{"a":1,"a":2}'], ["{}", '{"a":1,"a":2,"a":3}']),
    ('{"required":["a","b"]}', ['{"a":1,"b":null}', "[]"], ['{"a":1}']),
    ('{"dependentRequired":{"a":["b"]}}', ['{"b":1}', '{"a":1,"b":1}'], ['{"a":1}']),
    ('{"allOf":[{"minimum":1},{"maximum":2}]}', ["1.5"], ["3"]),
    ('{"anyOf":[{"type":"string"},{"minimum":2}]}', ['"a"', "2"], ["1"]),
    ('{"oneOf":[{"type":"integer"},{"minimum":2}]}', ["1", "2.5"], ["3", "1.5"]),
    ('{"not":{"type":"integer"}}', ['"a"'], ["1"]),
    ('{"if":{"type":"string"},"then":{"minLength":2},"else":{"minimum":0}}', ['"ab"', "1"], ['"a"', "-1"]),
    ('{"then":false,"else":false}', ["1"], []),
    ('{"dependentSchemas":{"a":{"maxProperties":1}}}', ['{"a":1}', '{"b":1,"c":1}'], ['{"a":1,"b":1}']),
    ('{"prefixItems":[{"type":"string"}],"items":{"type":"number"}}', ['["a",1]', "[]"], ['["a","b"]', "[1]"]),
    ('{"contains":{"const":1}}', ["[2,1]"], ["[]", "[2]"]),
    ('{"contains":{"const":1},"minContains":2,"maxContains":3}', ["[1,1,2]"], ["[1,2]", "[1,1,1,1]"]),
    ('{"contains":{"const":1},"minContains":0,"maxContains":1}', ["[]", "[2,2]", "[1]"], ["[1,1]"]),
    ('{"properties":{"a":{"type":"integer"}},"patternProperties":{"^b":{"type":"string"}},"additionalProperties":false}', ['{"a":1,"bb":"x"}'], ['{"a":"x"}', '{"b":1}', '{"c":1}']),
    ('{"propertyNames":{"maxLength":1}}', ['{"a":1}'], ['{"ab":1}']),
    ('{"$ref":"#/$defs/a~1b","$defs":{"a/b":{"type":"integer"}}}', ["1"], ['"x"']),
    ('{"$ref":"#x","$defs":{"y":{"$anchor":"x","minimum":5}},"maximum":7}', ["6"], ["4", "8"]),
    ('{"properties":{"x":{"$ref":"#"}},"additionalProperties":false}', ['{"x":{"x":{}}}'], ['{"x":{"y":{}}}']),
    ('{"$id":"http://e.org/a/b.json","$ref":"c.json","$defs":{"c":{"$id":"c.json","type":"null"}}}', ["null"], ["1"]),
    (TREE, ['{"children":[{"data":1}]}'], ['{"children":[{"daat":1}]}']),
    ('{"allOf":[{"properties":{"a":true}}],"unevaluatedProperties":false}', ['{"a":1}'], ['{"a":1,"b":1}']),
    ('{"anyOf":[{"properties":{"a":{"const":1}},"required":["a"]},{"properties":{"b":true}}],"unevaluatedProperties":false}', ['{"a":1,"b":1}'], ['{"a":2}']),
    ('{"prefixItems":[true],"contains":{"const":9},"unevaluatedItems":false}', ["[1,9]"], ["[9,1]"]),
    ('{"if":{"properties":{"a":true},"required":["a"]},"unevaluatedProperties":{"type":"string"}}', ['{"a":1,"b":"x"}'], ['{"a":1,"b":1}', '{"c":1}']),
    ("false", [], ["1", "null"]),
    ('{"format":"date","title":"x","default":1}', ['"no date"'], []),
]


@pytest.mark.parametrize(("schema", "valid", "invalid"), CASES)
def test_verdicts(schema, valid, invalid):
    loaded = JsonSchema(schema)
    for text in valid + invalid:
        value = parse(text)
        assert loaded.is_valid(value) == (text in valid), text
        assert dict(loaded.output(value))["valid"] == (text in valid), text
        assert bool(loaded.errors(value)) == (text in invalid)


@pytest.mark.parametrize(
    "schema",
    ['{"type":"foo"}', '{"enum":[]}', '{"multipleOf":0}', '{"minLength":-1}', '{"maxItems":1.5}', '{"pattern":"("}', '{"patternProperties":{"[":true}}', '{"required":[1]}', '{"allOf":[]}', '{"properties":[]}', '{"items":3}', '{"$ref":"#/nope"}', '{"$ref":"#"}', '{"allOf":[{"$ref":"#"}]}', '{"$schema":"http://json-schema.org/draft-07/schema#"}', '{"$anchor":"1a"}', '{"$defs":{"a":{"$anchor":"x"},"b":{"$anchor":"x"}}}', "3"],
)
def test_invalid_schemas(schema):
    with pytest.raises(InvalidSchema):
        JsonSchema(schema)


def test_output_unit():
    assert to_text(JsonSchema('{"type":"object","required":["a"]}').output(parse("{}"))) == '{"valid":false,"instanceLocation":"","keywordLocation":"","errors":[{"valid":false,"instanceLocation":"","keywordLocation":"/required","error":"member \\"a\\" is missing"}]}'
    unit = dict(JsonSchema('{"$ref":"#/$defs/x","$defs":{"x":{"maximum":1}}}').output(parse("2")))
    assert dict(dict(unit["errors"][0])["errors"][0])["absoluteKeywordLocation"] == "xri://root-schema#/$defs/x/maximum"
    assert JsonSchema('{"properties":{"a":{"items":{"minimum":2}}}}').errors(parse('{"a":[1,2,0]}')) == [("/a/0", "/properties/a/items/minimum", "below the minimum of 2"), ("/a/2", "/properties/a/items/minimum", "below the minimum of 2")]


def test_every_keyword_says_what_fails():
    cases = {
        "false": "1", '{"allOf":[false]}': "1", '{"anyOf":[false]}': "1", '{"oneOf":[true,true,true]}': "1", '{"oneOf":[false]}': "1", '{"not":true}': "1", '{"dependentSchemas":{"a":false}}': '{"a":1}', '{"prefixItems":[false]}': "[1]", '{"items":false}': "[1]", '{"contains":false}': "[1]",
        '{"contains":true,"maxContains":1}': "[1,2]", '{"contains":true,"minContains":3}': "[1,2]", '{"properties":{"a":false}}': '{"a":1}', '{"patternProperties":{"a":false}}': '{"a":1}', '{"additionalProperties":false}': '{"a":1}', '{"propertyNames":false}': '{"a":1}', '{"unevaluatedItems":false}': "[1]",
        '{"unevaluatedProperties":false}': '{"a":1}', '{"type":["null","string"]}': "1", '{"enum":[2]}': "1", '{"const":2}': "1", '{"multipleOf":2}': "1", '{"maximum":0}': "1", '{"exclusiveMaximum":1}': "1", '{"minimum":2}': "1", '{"exclusiveMinimum":1}': "1", '{"maxLength":0}': '"a"', '{"minLength":2}': '"a"',
        '{"pattern":"b"}': '"a"', '{"maxItems":0}': "[1]", '{"minItems":2}': "[1]", '{"uniqueItems":true}': "[1,1.0]", '{"maxProperties":0}': '{"a":1}', '{"minProperties":2}': '{"a":1}', '{"required":["b"]}': '{"a":1}', '{"dependentRequired":{"a":["b"]}}': '{"a":1}',
    }
    said = [JsonSchema(schema)._unit(parse(value), True) for schema, value in cases.items()]
    texts = [(unit.error or next(u.error for u in unit.errors)) for unit in said]
    assert all(texts) and len(set(texts)) == len(cases) and not any("{}" in t for t in texts)


def test_classes_with_doubled_operators():
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        for pattern, fits, misses in (("^[a&&b]$", "&", "c"), ("^[a||b]$", "|", "c"), ("^[+--]$", ",", "a"), ("^[[a]$", "[", "b"), ("^[a~~]$", "~", "b")):
            assert JsonSchema(f'{{"pattern":"{pattern}"}}').is_valid(fits) and not JsonSchema(f'{{"pattern":"{pattern}"}}').is_valid(misses)


def test_own_applicators():
    """A keyword with a schema of its own: at least one member's value meets it."""
    some = {"someMember": lambda x, fits: None if not isinstance(x, Members) or any(fits(v) for _, v in x) else "no member fits"}
    loaded = JsonSchema('{"someMember":{"$ref":"#/$defs/n"},"$defs":{"n":{"type":"number"}}}', applicators=some)
    assert loaded.is_valid(parse('{"a":"x","b":1}')) and not loaded.is_valid(parse('{"a":"x"}')) and loaded.errors(parse('{"a":"x"}')) == [("", "/someMember", "no member fits")]
    with pytest.raises(InvalidSchema):
        JsonSchema('{"someMember":3}', applicators=some)


def test_references():
    schema = '{"$ref":"http://e.org/x"}'
    with pytest.raises(InvalidSchema):
        JsonSchema(schema)
    assert JsonSchema(schema, ['{"$id":"http://e.org/x","type":"null"}']).is_valid(None)
    assert JsonSchema(schema, {"http://e.org/x": '{"type":"null"}'}).is_valid(None)
    asked = []
    resolved = JsonSchema(schema, resolver=lambda uri: asked.append(uri) or '{"type":"null","$ref":"y"}' if uri.endswith("x") else "true")
    assert resolved.is_valid(None) and asked == ["http://e.org/x"]
    assert not JsonSchema(schema, resolver=lambda uri: None).is_valid(None)


def test_deep_documents():
    deep = parse('{"x":' * 3000 + "{}" + "}" * 3000)
    assert JsonSchema('{"properties":{"x":{"$ref":"#"}},"additionalProperties":false}').is_valid(deep)


@pytest.mark.parametrize(("base", "ref", "out"), [("http://a/b/c", "d", "http://a/b/d"), ("http://a/b/c", "../d", "http://a/d"), ("http://a", "d", "http://a/d"), ("http://a/b?q", "#f", "http://a/b?q#f"), ("xri://root-schema", "x.json", "xri://root-schema/x.json"), ("http://a/b", "urn:x:y", "urn:x:y"), ("http://a/b", "//c/d", "http://c/d")])
def test_resolve(base, ref, out):
    assert resolve(base, ref) == out
