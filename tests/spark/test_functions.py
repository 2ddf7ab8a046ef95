from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docquarry import operators as ops
from docquarry import plans, sources, streaming
from docquarry.functions import columns as c
from docquarry.functions import entries as e
from docquarry.functions import register_all
from docquarry.kernel.pointer import PointerError
from docquarry.kernel.schema import InvalidSchema, JsonSchema
from docquarry.kernel.parser import parse

DOCS = [(1, '{"a":1,"b":[1,2.50],"a":null}'), (2, '{"b":"x","n":12345678901234567890123.5}'), (3, "[1,"), (4, None), (5, "null"), (6, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, doc string")


def column(docs, expression):
    return [r[0] for r in docs.orderBy("id").select(expression.alias("x")).collect()]


def test_null_malformed_and_json_null_stay_apart(docs):
    assert column(docs, c.json_valid("doc")) == [True, True, False, None, True, False]
    assert column(docs, c.json_get("doc", "")) == ['{"a":1,"b":[1,2.5],"a":null}', '{"b":"x","n":12345678901234567890123.5}', None, None, "null", None]
    assert column(docs, c.json_get("doc", "/a")) == ["null", None, None, None, None, None]
    assert column(docs, c.json_type("doc")) == ["object", "object", None, None, "null", None]
    assert column(docs, c.json_size("doc")) == [3, 2, None, None, None, None]
    assert column(docs, c.json_as_decimal("doc", "/n", 38, 2)) == [None, Decimal("12345678901234567890123.50"), None, None, None, None]
    assert column(docs, c.json_as_decimal("doc", "/n", 10, 2))[1] is None
    assert [x and x["code"] for x in column(docs, c.json_parse_error("doc"))] == ["ok", "ok", "unterminated_array", None, "ok", "eob"]
    assert column(docs, c.json_get_unique("doc", "a"))[0] is None
    assert column(docs, c.json_equals("doc", F.lit("null"))) == [False, False, None, None, True, None]


def test_changes_and_readings(docs):
    assert column(docs, c.json_set("doc", "/b", '"y"')) == ['{"a":1,"b":"y","a":null}', '{"b":"y","n":12345678901234567890123.5}', None, None, None, None]
    assert column(docs, c.json_set("doc", "/b/1", "[]"))[0] == '{"a":1,"b":[1,[]],"a":null}' and column(docs, c.json_set("doc", "", "0"))[4] == "0"
    assert column(docs, c.json_set_type("doc", "/b", "array")) == ['{"a":1,"b":[1,2.5],"a":null}', '{"b":[],"n":12345678901234567890123.5}', None, None, None, None]
    assert [x and tuple(x) for x in column(docs, c.json_get_or_add("doc", "n", "7"))] == [("7", '{"a":1,"b":[1,2.5],"a":null,"n":7}'), ("12345678901234567890123.5", '{"b":"x","n":12345678901234567890123.5}'), None, None, None, None]
    assert [x and (x["doc"], x["error"] and x["error"]["code"]) for x in column(docs, c.json_read("doc"))][2:] == [(None, "unterminated_array"), None, ("null", None), (None, "eob")]
    assert [x and (x["valid"], x["error"]) for x in column(docs, c.json_verdict("doc", '{"type":"object"}'))][0] == (True, None)
    assert [x and x["valid"] for x in column(docs, c.json_verdict("doc", '{"type":"object"}'))] == [True, True, False, None, False, False]
    with pytest.raises(Exception, match="finds nothing"):
        docs.select(c.json_get("doc", "/zz", on_missing="error")).collect()
    applied = column(docs, c.json_apply("doc", {"x": [c.get("/b"), c.append("3")], "y": [c.remove_key("a"), c.add("z", F.col("doc"))], "w": [c.get("/b"), c.remove_index(0)]}))
    assert [x and tuple(x) for x in applied] == [("[1,2.5,3]", '{"b":[1,2.5],"z":{"a":1,"b":[1,2.5],"a":null}}', "[2.5]"), (None, '{"b":"x","n":12345678901234567890123.5,"z":{"b":"x","n":12345678901234567890123.5}}', None), None, None, (None, None, None), None]
    assert column(docs, c.json_patch("doc", '{"op":"add","path":"/0","value":9}', ptr="/b")["doc"])[:2] == ["[9,1,2.5]", '"x"']
    assert column(docs, c.json_flat("doc", scalars=True))[4][0]["value"] == "null" and [r["pointer"] for r in column(docs, c.json_flat("doc", scalars=True))[0]] == ["/a", "/b/0", "/b/1", "/a"]


def test_pointers_with_many_numbers_are_followed(spark):
    df = spark.sql("""select parse_json('{"1":[[{"2":[[7,8]]}]]}') as v""")
    assert df.select(plans.native_get(F.col("v"), "/1/0/0/2/0/1", "int")).first()[0] == 8


def test_spread(spark):
    one = spark.range(100).coalesce(1)
    assert ops.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and ops.spread(one).count() == 100
    many = spark.range(0, 1000, 1, 64)
    assert ops.spread(many) is many


def test_mistakes_show_before_any_job(docs):
    with pytest.raises(PointerError):
        c.json_get("doc", "a")
    with pytest.raises(InvalidSchema):
        c.json_schema_valid("doc", '{"type":"thing"}')
    with pytest.raises(ValueError):
        c.json_patch("doc", "[")
    with pytest.raises(ValueError):
        c.json_default("thing")


def test_mismatch_can_fail(docs):
    with pytest.raises(Exception, match="number"):
        docs.select(c.json_as_string("doc", "/n", on_mismatch="error")).collect()


def test_entries(docs):
    en = docs.where("id = 1").select(c.json_entries("doc").alias("e"))
    run = lambda x: en.select(x.alias("x")).first()[0]
    names = lambda x: [r["name"] for r in run(x)]
    col = F.col("e")
    assert names(col) == ["a", "b", "a"] and names(e.in_order(col)) == ["a", "a", "b"] and names(e.backwards(col)) == ["a", "b", "a"]
    assert names(e.erase(col, "a")) == ["b"] and names(e.pop_front(col)) == ["b", "a"] and names(e.pop_back(col)) == ["a", "b"]
    assert names(e.insert(col, 1, e.entry("z", "0"))) == ["a", "z", "b", "a"] and names(e.erase_at(col, 1)) == ["a", "a"] and names(e.clear(col)) == []
    assert names(e.insert_all(col, 3, F.array(e.entry("z", "0")))) == ["a", "b", "a", "z"]
    assert run(e.count(col, "a")) == 2 and run(e.contains(col, "c")) is False and run(e.find(col, "a"))["value"] == "1" and run(e.find(col, "c")) is None
    assert names(e.equal_range(col, "a")) == ["a", "a"] and names(e.lower_bound(col, "b")) == ["b"] and names(e.upper_bound(col, "a")) == ["b"]
    assert run(e.front(col))["name"] == "a" and run(e.empty(col)) is False
    assert run(e.to_object(e.push_back(col, e.entry('q"', "[]")))) == '{"a":1,"b":[1,2.5],"a":null,"q\\"":[]}'


def test_sql_functions(spark):
    register_all(spark)
    one = lambda sql: spark.sql(f"select {sql}").first()[0]
    assert one("json_get('{\"a\":[1,2]}', '/a/1')") == "2"
    assert one("json_type('[]', '')") == "array"
    assert one("json_patch('{}', '[{\"op\":\"add\",\"path\":\"/a\",\"value\":1}]').doc") == '{"a":1}'
    assert one("json_schema_valid('1', '{\"type\":\"string\"}')") is False
    assert one("json_equals('{\"a\":1,\"b\":2}', '{\"b\":2.0,\"a\":1}')") is True
    assert one("json_as_decimal('{\"a\":1.25}', '/a')") == Decimal("1.25")
    assert one("json_parse_error('[').code") == "unterminated_array"
    assert one("json_relaxed('{a:1,}')") == '{"a":1}'
    assert one("json_add('{\"a\":1}', 'a', '2')") == '{"a":2}' and one("json_add('{\"a\":1}', 'a', '2', false)") == '{"a":1}'
    assert one("json_parse('{a:1,}', '{\"strict\":false}')") == '{"a":1}' and one("json_print('{\"b\":[1],\"a\":2}', '{\"pretty\":false,\"sorted\":true}')") == '{"a":2,"b":[1]}'
    assert one("json_patch('{\"a\":1}', '[{\"op\":\"remove\",\"path\":\"/a\"},{\"op\":\"remove\",\"path\":\"/b\"}]', '{\"atomic\":true}')")["doc"] == '{"a":1}'
    assert [tuple(r) for r in spark.sql("select pointer, type from json_flatten('{\"a\":[null]}')").collect()] == [("", "object"), ("/a", "array"), ("/a/0", "null")]
    assert [r["name"] for r in spark.sql("select * from json_members('{\"b\":1,\"a\":2}', true)").collect()] == ["a", "b"]
    assert spark.sql("select count(*) from json_tokens('[1,2]', true)").first()[0] == 5
    assert spark.sql("select error from json_schema_errors('1', '{\"type\":\"null\"}')").first()[0] == "expected a value of type null"


def test_every_function_has_a_sql_form(spark):
    from docquarry import functions

    register_all(spark)
    names = {n for n in functions.__all__ if n.startswith(("json_", "pointer_"))} - {"json_from", "json_apply"}
    assert {n for n in names if not spark.catalog.functionExists(n)} == set()
    one = lambda sql: spark.sql(f"select {sql}").first()[0]
    assert one("json_get_unique('{\"a\":[1],\"b\":2,\"b\":3}', 'a')") == "[1]"
    assert one("json_get_unique('{\"b\":2,\"b\":3}', 'b')") is None and one("json_get_unique('{}', 'a')") is None and one("json_get_unique('[', 'a')") is None
    assert one("pointer_escape('a/~')") == "a~1~0" and one("pointer_unescape('a~1~0')") == "a/~" and one("pointer_from_tokens(array('a/b', '~'))") == "/a~1b/~0"
    assert one("json_default('array')") == "[]" and [r["pointer"] for r in one("json_flat('[1]')")] == ["", "/0"]
    assert len(one("json_schema_failures('1', '{\"type\":\"null\"}')")) == 1


def test_operators(docs):
    rows = ops.verify(docs, "doc", '{"type":"object"}').orderBy("id").collect()
    assert [r["verdict"] and r["verdict"]["valid"] for r in rows] == [True, True, False, None, False, False]
    assert ops.view(docs, "doc", "/b", "string", pretty=False).collect()[0]["view"] == '"x"'
    assert {r["pointer"] for r in ops.flatten(docs.where("id = 1"), "doc").collect()} == {"", "/a", "/b", "/b/0", "/b/1"}
    assert [r["type"] for r in ops.tokens(docs.where("id = 3"), "doc").orderBy("ordinal").collect()] == ["LBRACK", "NUMBER", "SEPARATOR"]


def test_differences_and_folds(spark):
    a = spark.createDataFrame([(1, '{"a":1}'), (2, "[]"), (3, "0")], "k int, doc string")
    b = spark.createDataFrame([(1, '{"a":1.0}'), (2, "[1]"), (4, "0")], "k int, doc string")
    assert dict(ops.differences(a, b, ["k"], "doc").select("k", "status").collect()) == {1: "equal", 2: "changed", 3: "removed", 4: "added"}
    steps = spark.createDataFrame([(2, 2, '{"op":"add","path":"/-","value":"b"}'), (2, 1, '{"op":"add","path":"/-","value":"a"}'), (2, 3, "bad"), (9, 1, "{}")], "k int, at int, patch string")
    assert {tuple(r) for r in ops.fold_patches(a, steps, "k", "at").collect()} == {(1, '{"a":1}', 0), (2, '["a","b"]', 2), (3, "0", 0)}


NATIVE_DOCS = ['{"a":1,"0":{"x":5}}', '{"a":"x","l":[1,2,3]}', '{"a":1.5,"l":[]}', '{"a":null,"b":{"c":true}}', '{"a":-3,"l":["q"]}', "[]", "7", '"s"', "null", "{}", "[1,", '{"a":1,"a":2}']
NATIVE_SCHEMAS = [
    '{"type":"object","required":["a"]}', '{"properties":{"a":{"type":"integer"}}}', '{"properties":{"a":{"type":["number","null"],"minimum":0}}}', '{"properties":{"l":{"items":{"type":"integer"},"minItems":1}}}',
    '{"enum":[7,"s",null]}', '{"not":{"type":"object"}}', '{"oneOf":[{"type":"object"},{"required":["a"]}]}', '{"if":{"required":["l"]},"then":{"properties":{"a":{"type":"string"}}},"else":{"maxProperties":1}}',
    '{"properties":{"a":{"pattern":"^x$"},"b":{"$ref":"#/$defs/c"}},"$defs":{"c":{"dependentRequired":{"c":["d"]}}}}', '{"properties":{"a":true,"l":true},"additionalProperties":false}', '{"properties":{"a":{"multipleOf":0.5}}}', "false",
]


def test_native_schemas_agree_with_the_kernel(spark):
    t = spark.createDataFrame([(x,) for x in NATIVE_DOCS], "doc string")
    for schema in NATIVE_SCHEMAS:
        for row in t.select("doc", plans.compiled_valid("doc", schema).alias("v")).collect():
            try:
                want = JsonSchema(schema).is_valid(parse(row["doc"]))
            except ValueError:
                want = None
            assert row["v"] == want, (schema, row["doc"])
    with pytest.raises(plans.NotCompilable):
        plans.schema_predicate('{"unevaluatedProperties":false}', F.try_parse_json(F.lit("{}")))


def test_native_pointers(spark):
    t = ops.with_parsed(spark.createDataFrame([(x,) for x in NATIVE_DOCS[:3]], "doc string"), "doc")
    assert [r[0] for r in t.select(plans.native_get(F.col("_variant"), "/0/x", "bigint")).collect()] == [5, None, None]
    assert [r[0] for r in t.select(plans.native_get(F.col("_variant"), "/l/1", "bigint")).collect()] == [None, 2, None]
    assert [r[0] for r in t.select(plans.native_text(F.col("_variant"), "/a")).collect()] == ["1", '"x"', "1.5"]


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":\n1}')
    (tmp_path / "b.json").write_bytes(b'"\xff"')
    rows = {r["path"][-6:]: r for r in sources.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.json"]["doc"] == '{"a":1}' and rows["b.json"]["error"]["code"] == "invalid_utf8"
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "x.txt").write_text('{"a":1}\n[\n{a:2}\n')
    assert [r["doc"] for r in sources.read_document_lines(spark, str(lines)).collect()] == ['{"a":1}', None, None]
    assert sources.read_document_lines(spark, str(lines), "DROPMALFORMED").count() == 1
    assert sources.read_document_lines(spark, str(lines), "DROPMALFORMED", strict=False).count() == 2
    with pytest.raises(Exception, match="malformed document"):
        sources.read_document_lines(spark, str(lines), "FAILFAST").collect()
    with pytest.raises(ValueError):
        sources.read_document_lines(spark, str(lines), "OTHER")
    stream = streaming.stream_document_lines(spark, str(lines), "DROPMALFORMED")
    streaming.write_stream(stream, "doc", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1}']
