"""Queries over the star schema: documents are built from base columns, worked on, and read back, so that SQL can say what
must come out from the base columns alone. QUERIES has the Spark side, ORACLES the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from . import plans, sources, streaming
from .functions import columns as c
from .functions import entries as e

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(function):
        QUERIES[name or function.__name__] = function
        if sql is not None:
            ORACLES[name or function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, *columns) -> DataFrame:
    return ops.spread(_table(spark, sf_dir, "events").select("event_id", *columns))


def orders(spark, sf_dir) -> DataFrame:
    """key, cust, status and doc: {"id":key,"order":{"cust":..,"status":..},"items":[key,cust]}."""
    t = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))
    return ops.spread(t).withColumn("doc", F.to_json(F.struct(F.col("key").alias("id"), F.struct("cust", "status").alias("order"), F.array("key", "cust").alias("items"))))


def customers(spark, sf_dir) -> DataFrame:
    """key, nation, segment and doc: {"key":..,"name":..,"nation":..,"segment":..,"tags":[nation,nation mod 3]}."""
    t = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return ops.spread(t).withColumn("doc", F.to_json(F.struct("key", "name", "nation", "segment", F.array("nation", F.col("nation") % 3).alias("tags"))))


def forms(spark, sf_dir) -> DataFrame:
    """key, nation, name, segment and doc of customers, whose members, lengths, types and names vary from row to row."""
    t, key = customers(spark, sf_dir), F.col("key")
    name = F.when(key % 3 != 0, F.concat(F.lit(',"name":"'), "name", F.lit('"'))).otherwise("")
    nation = F.when(key % 4 == 0, F.concat(F.lit('"'), "nation", F.lit('"'))).otherwise(F.col("nation").cast("string"))
    tags = F.array_join(F.transform(F.sequence(F.lit(0), key % 4), lambda i: F.col("nation") + i), ",")
    tags = F.when(key % 4 == 0, "").otherwise(F.regexp_replace(tags, r"^[0-9]+,", ""))
    more = F.when(key % 5 == 0, F.lit(',"extra_member":null')).otherwise("")
    return t.withColumn("doc", F.concat(F.lit('{"key":'), "key", name, F.lit(',"nation":'), nation, F.lit(',"tags":['), tags, F.lit("]"), more, F.lit("}")))


_O = "(select o_orderkey as key, o_custkey as cust, o_orderstatus as status from orders)"
_C = "(select c_custkey as key, c_name as name, c_nationkey::bigint as nation, c_mktsegment as segment from customer)"

# pointers


@query("select event_id, json_extract(props, '/k')::bigint as k from events")
def pointer_get_props(spark, d):
    return _events(spark, d, "props").select("event_id", c.json_get("props", "/k").cast("bigint").alias("k"))


@query("select event_type, json_extract(props, '/k')::bigint as k, count(*) as n from events group by all")
def pointer_group_by(spark, d):
    return _events(spark, d, "event_type", "props").select("event_type", c.json_get("props", "/k").cast("bigint").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(f"select key, cust, '\"' || status || '\"' as status from {_O}")
def pointer_get_nested(spark, d):
    return orders(spark, d).select("key", c.json_get("doc", "/order/cust").cast("bigint").alias("cust"), c.json_get("doc", "/order/status").alias("status"))


@query(f"select key, cust as item from {_O}")
def pointer_array_index(spark, d):
    return orders(spark, d).select("key", c.json_get("doc", "/items/1").cast("bigint").alias("item"))


@query(f"select key, case when key % 2 = 0 then key else cust end as item from {_O}")
def pointer_column(spark, d):
    return orders(spark, d).select("key", c.json_get("doc", F.concat(F.lit("/items/"), F.col("key") % 2)).cast("bigint").alias("item"))


@query(f"select key, cust as item from {_O}")
def pointer_escaped_key(spark, d):
    doc = F.to_json(F.struct(F.col("cust").alias("a/b~c")))
    return orders(spark, d).select("key", c.json_get(doc, "/a~1b~0c").cast("bigint").alias("item"))


@query(f"select count(*) as n, sum((key % 4 = 3)::bigint)::bigint as found, sum((key % 5 = 0)::bigint)::bigint as null_texts, sum((key % 4 = 0)::bigint)::bigint as no_first from {_C}")
def pointer_missing(spark, d):
    t = forms(spark, d).select(c.json_get("doc", "/tags/2").alias("a"), c.json_get("doc", "/extra_member").alias("b"), c.json_get("doc", "/tags/0").alias("first"))
    return t.agg(F.count("*").alias("n"), F.count("a").alias("found"), F.sum((F.col("b") == "null").cast("bigint")).alias("null_texts"), F.sum(F.col("first").isNull().cast("bigint")).alias("no_first"))


@query("select n_nationkey as key, replace(replace('a/~' || n_name, '~', '~0'), '/', '~1') as token, 'a/~' || n_name as back from nation")
def pointer_tokens(spark, d):
    raw = F.concat(F.lit("a/~"), "n_name")
    return _table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), c.pointer_escape(raw).alias("token"), c.pointer_unescape(c.pointer_escape(raw)).alias("back"))


@query(f"select key, '/a~1b/~0' || key as pointer from {_O}")
def pointer_of_tokens(spark, d):
    return orders(spark, d).select("key", c.pointer_from_tokens(F.array(F.lit("a/b"), F.concat(F.lit("~"), "key"))).alias("pointer"))


@query(f"select key, cust, key as item, status from {_O}")
def pointer_native(spark, d):
    v = ops.with_parsed(orders(spark, d), "doc")
    get = lambda p, t: plans.native_get(F.col("_variant"), p, t)
    return v.select("key", get("/order/cust", "bigint").alias("cust"), get("/items/0", "bigint").alias("item"), get("/order/status", "string").alias("status"))


# types, sizes, members


@query(f"select * from (values ('/id', 'number'), ('/order', 'object'), ('/order/status', 'string'), ('/items', 'array')) t(pointer, type), (select count(*) as n from {_O})")
def type_of(spark, d):
    t = orders(spark, d)
    at = F.explode(F.array(*[F.lit(p) for p in ("/id", "/order", "/order/status", "/items")]))
    return t.select("doc", at.alias("pointer")).select("pointer", c.json_type("doc", F.col("pointer")).alias("type")).groupBy("pointer", "type").agg(F.count("*").alias("n"))


@query(f"select key, key % 4 <> 0 as is_number, key % 4 = 0 as is_string, key % 3 <> 0 as has_name, key % 5 = 0 as has_more from {_C}")
def type_tests(spark, d):
    return forms(spark, d).select("key", c.json_is_type("doc", "number", "/nation").alias("is_number"), c.json_is_type("doc", "string", "/nation").alias("is_string"), c.json_has("doc", "name").alias("has_name"), c.json_has("doc", "extra_member").alias("has_more"))


@query(f"select key, (3 + (key % 3 <> 0)::int + (key % 5 = 0)::int)::int as members, (key % 4)::int as items from {_C}")
def size_members(spark, d):
    return forms(spark, d).select("key", c.json_size("doc").alias("members"), c.json_size("doc", "/tags").alias("items"))


@query(f"select key, place, name, case name when 'cust' then cust::varchar else '\"' || status || '\"' end as value from {_O}, (values (0, 'cust'), (1, 'status')) m(place, name)")
def members_explode(spark, d):
    return ops.members(orders(spark, d), "doc", "/order").select("key", "place", "name", "value")


@query(f"select place, name, count(*) as n from {_O}, (values (0, 'id'), (1, 'items'), (2, 'order')) m(place, name) group by all")
def members_sorted(spark, d):
    return ops.members(orders(spark, d).select("doc"), "doc", sorted=True).groupBy("place", "name").agg(F.count("*").alias("n"))


@query(f"select key, 'id,order,items' as names, 'id,items,order' as in_order from {_O}")
def keys_array(spark, d):
    return orders(spark, d).select("key", F.array_join(c.json_keys_array("doc"), ",").alias("names"), F.array_join(c.json_keys_array("doc", sorted=True), ",").alias("in_order"))


@query(f"select key, place, case place when 0 then key else cust end as value from {_O}, (values (0), (1)) p(place)")
def elements_explode(spark, d):
    return ops.elements(orders(spark, d), "doc", "/items").select("key", "place", F.col("value").cast("bigint").alias("value"))


@query(f"select key, (nation + nation % 3)::double / 2 as mean from {_C}")
def array_mean(spark, d):
    return customers(spark, d).select("key", ops.mean_of_numbers("doc", "/tags").alias("mean"))


_PATHS = [("/id", "number", "key::varchar"), ("/order/cust", "number", "cust::varchar"), ("/order/status", "string", "'\"' || status || '\"'"), ("/items/0", "number", "key::varchar"), ("/items/1", "number", "cust::varchar")]


@query(" union all ".join(f"select key, '{p}' as pointer, '{t}' as type, {v} as value from {_O}" for p, t, v in _PATHS))
def flatten_paths(spark, d):
    return ops.flatten(orders(spark, d), "doc", scalars=True).select("key", "pointer", "type", "value")


@query(f"""select key, '{{"z":1,"cust":' || cust || ',"a":0}}' as added, '{{"status":"' || status || '"}}' as erased, 2 as n, true as has, 'status' as last_name,
    '{{"cust":' || cust || ',"status":"' || status || '"}}' as in_order from {_O}""")
def entries_operations(spark, d):
    t = orders(spark, d).withColumn("en", c.json_entries("doc", "/order"))
    both = e.push_back(e.push_front(e.erase(F.col("en"), "status"), e.entry("z", "1")), e.entry("a", "0"))
    return t.select(
        "key", e.to_object(both).alias("added"), e.to_object(e.erase_at(F.col("en"), 0)).alias("erased"), e.size(F.col("en")).alias("n"), e.contains(F.col("en"), "cust").alias("has"),
        e.back(F.col("en"))["name"].alias("last_name"), e.to_object(e.in_order(e.backwards(F.col("en")))).alias("in_order"),
    )


@query(f"""select key, (1 + (key = cust)::int)::int as n, key::varchar as first, cust::varchar || ',' || cust::varchar as of_b, 'b,b,c' as from_b, 'c' as behind_b, 'a,x,y,b,b,c' as inserted, case when key % 2 = 0 then 'x' else 'a' end as front from {_O}""")
def entries_lookup(spark, d):
    """Entries whose names repeat: counting, finding, ranges, insertion of one and of many, and exchange."""
    text = lambda x: F.col(x).cast("string")
    many = F.array(e.entry("a", text("key")), e.entry("b", text("cust")), e.entry("b", text("cust")), e.entry("c", "0"))
    same = F.array(e.entry("k", "0"), e.entry(F.when(F.col("key") == F.col("cust"), "k").otherwise("l"), "1"))
    names = lambda x: F.array_join(F.transform(x, lambda m: m["name"]), ",")
    two = F.array(e.entry("x", "1"), e.entry("y", "2"))
    left, right = e.swap(many, two)
    return orders(spark, d).select(
        "key", e.count(same, "k").alias("n"), e.find(many, "a")["value"].alias("first"), F.array_join(F.transform(e.equal_range(many, "b"), lambda m: m["value"]), ",").alias("of_b"), names(e.lower_bound(many, "b")).alias("from_b"),
        names(e.upper_bound(many, "b")).alias("behind_b"), names(e.insert(e.insert_all(many, 1, F.slice(two, 2, 1)), 1, e.entry("x", "1"))).alias("inserted"), e.front(F.when(F.col("key") % 2 == 0, left).otherwise(right))["name"].alias("front"),
    )


@query(f"select key, status as s, cust::double as x, (key % 2 = 0) as b, null::varchar as wrong from {_O}")
def typed_access(spark, d):
    doc = F.to_json(F.struct("status", "cust", (F.col("key") % 2 == 0).alias("even")))
    return orders(spark, d).select("key", c.json_as_string(doc, "/status").alias("s"), c.json_as_double(doc, "/cust").alias("x"), c.json_as_boolean(doc, "/even").alias("b"), c.json_as_string(doc, "/cust").alias("wrong"))


@query(f"select key, (cust / 4)::decimal(12, 2) as amount from {_O}")
def typed_decimal(spark, d):
    text = F.concat(F.lit('{"amount":'), (F.col("cust").cast("decimal(12,2)") / 4).cast("decimal(12,2)").cast("string"), F.lit("}"))
    return orders(spark, d).select("key", c.json_as_decimal(text, "/amount", 12, 2).alias("amount"))


# parsing


@query("select event_id, event_id % 3 <> 0 as valid from events")
def valid_strict(spark, d):
    text = F.concat("props", F.when(F.col("event_id") % 3 == 0, ",").otherwise(""))
    return _events(spark, d, "props").select("event_id", c.json_valid(text).alias("valid"))


@query(f"""select key, '{{"id":' || key || ',"text":"ab","list":[1,' || cust || ']}}' as doc from {_O}""")
def relaxed_to_strict(spark, d):
    text = F.concat(F.lit("/* c */ { id : "), "key", F.lit(', "text": "a" "b", list: [1, '), "cust", F.lit(",], } // end"))
    return orders(spark, d).select("key", c.json_parse(text, strict=False).alias("doc"))




@query(f"select key, cust as last, null::varchar as only, false as once, 2 as size from {_O}")
def duplicate_members(spark, d):
    text = F.concat(F.lit('{"a":'), "key", F.lit(',"a":'), "cust", F.lit("}"))
    return orders(spark, d).select("key", c.json_get(text, "/a").cast("bigint").alias("last"), c.json_get_unique(text, "a").alias("only"), c.json_valid(text, allow_duplicates=False).alias("once"), c.json_size(text).alias("size"))


@query(f"select key, key % 4 <= 2 as deep, key % 5 <= 2 as long, key % 6 <= 2 as wide from {_O}")
def parser_limits(spark, d):
    deep = F.concat(F.repeat(F.lit("["), (F.col("key") % 4 + 1).cast("int")), F.repeat(F.lit("]"), (F.col("key") % 4 + 1).cast("int")))
    long = F.concat(F.lit("[0"), F.repeat(F.lit(",0"), (F.col("key") % 5).cast("int")), F.lit("]"))
    wide = F.concat(F.lit('{"a":0'), F.repeat(F.lit(',"a":0'), (F.col("key") % 6).cast("int")), F.lit("}"))
    return orders(spark, d).select("key", c.json_valid(deep, max_depth=3).alias("deep"), c.json_valid(long, max_array_size=3).alias("long"), c.json_valid(wide, max_object_size=3).alias("wide"))


#: Kind to (the text as Spark makes it of props, code, row and column in SQL over props).
_ERRORS = [
    (lambda p: p, "ok", "0", "0"),
    (lambda p: F.replace(p, F.lit(":"), F.lit(" ")), "expected_colon", "0", "instr(props, ':') + case when substr(props, instr(props, ':') + 1, 1) = ' ' then 1 else 0 end"),
    (lambda p: F.expr("left(props, length(props) - 1)"), "unterminated_object", "0", "length(props) - 1"),
    (lambda p: F.concat(p, p), "unexpected_character", "0", "length(props)"),
    (lambda p: F.concat(F.lit("["), p, F.lit("\n "), p, F.lit("]")), "expected_separator_or_right_bracket", "1", "1"),
    (lambda p: F.concat(F.lit("["), p, F.lit(",]")), "misplaced_right_bracket", "0", "length(props) + 2"),
    (lambda p: F.replace(p, F.lit('"k"'), F.lit("k")), "invalid_token", "0", "1"),
]
_TEXTS = lambda: F.element_at(F.array(*[make(F.col("props")) for make, *_ in _ERRORS]), (F.col("event_id") % len(_ERRORS) + 1).cast("int"))


@query("select event_id, " + ", ".join(f"(case event_id % {len(_ERRORS)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + f" end)::{kind} as {name}" for name, kind, values in (("code", "varchar", [f"'{x[1]}'" for x in _ERRORS]), ('"row"', "int", [x[2] for x in _ERRORS]), ('"col"', "int", [x[3] for x in _ERRORS]))) + " from events")
def parse_error_code(spark, d):
    return _events(spark, d, "props").withColumn("e", c.json_parse_error(_TEXTS())).select("event_id", "e.code", "e.row", "e.col")


#: A text for each further code, and where its error is.
_CODES = [
    ("", "eob", 0, 0), ('["\\ud800"]', "invalid_utf8", 0, 1), ('"abc', "unterminated_string", 0, 0), ('["\\x"]', "invalid_escape_code", 0, 2), ("[1,\n01]", "invalid_number", 1, 0), ("[1e99999999999999999999]", "number_out_of_range", 0, 1), ("[nul]", "invalid_token", 0, 1), ("}", "misplaced_right_curly_bracket", 0, 0),
    ("[]]", "unexpected_character", 0, 2), ("[,]", "misplaced_separator", 0, 1), ("[:]", "misplaced_colon", 0, 1), ('{"a":1 2}', "expected_separator_or_right_curly_bracket", 0, 7), ("{1:2}", "expected_obj_member_name", 0, 1), ("[1", "unterminated_array", 0, 2), ("[1 $]", "unexpected_character", 0, 3),
]
_LIMITS = [("[[1]]", "max_depth_exceeded", 0, 1), ("[1,2,3]", "max_array_size_exceeded", 0, 6), ('{"a":1,"b":2,"c":3}', "max_obj_size_exceeded", 0, 13), ('{"a":1,"a":2}', "duplicate_obj_member", 0, 7)]


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _code_rows(rows, n) -> str:
    return "select event_id, code, r as \"row\", k as col from events join (values " + ", ".join(f"({i}, '{code}', {r}, {k})" for i, (_, code, r, k) in enumerate(rows)) + f") t(i, code, r, k) on event_id % {n} = i"


@query(_code_rows(_CODES, len(_CODES)))
def parse_error_further_codes(spark, d):
    text = F.element_at(F.array(*[F.lit(t) for t, *_ in _CODES]), (F.col("event_id") % len(_CODES) + 1).cast("int"))
    return _events(spark, d).withColumn("e", c.json_parse_error(text)).select("event_id", "e.code", "e.row", "e.col")


@query(_code_rows(_LIMITS, len(_LIMITS)))
def parse_error_limits(spark, d):
    text = F.element_at(F.array(*[F.lit(t) for t, *_ in _LIMITS]), (F.col("event_id") % len(_LIMITS) + 1).cast("int"))
    return _events(spark, d).withColumn("e", c.json_parse_error(text, max_depth=1, max_array_size=2, max_object_size=2, allow_duplicates=False)).select("event_id", "e.code", "e.row", "e.col")


@query("select event_type, case when event_id % 4 = 0 then 'unterminated_object' else 'ok' end as code, count(*) as n from events group by all")
def parse_error_counts(spark, d):
    t = _events(spark, d, "event_type", "props").select("event_type", F.when(F.col("event_id") % 4 == 0, F.lit("{")).otherwise(F.col("props")).alias("doc"))
    return ops.error_counts(t, "doc", "event_type")


@query("select event_id, case when event_id % 2 = 0 then 'Ok.' else 'Unexpected character at line 1, column ' || length(props) end as message from events")
def parse_error_message(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("props", F.lit("]")))
    return _events(spark, d, "props").select("event_id", c.json_parse_error(text)["message"].alias("message"))


@query("select event_id, 5::bigint as n, (instr(props, ':') - 1)::int as colon_col, props->>'k' as number, (length(props) - 1)::int as end_col from events")
def token_rows(spark, d):
    rows = ops.tokens(_events(spark, d, "props"), "props")
    of = lambda kind, column: F.max(F.when(F.col("type") == kind, F.col(column)))
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), of("COLON", "col").alias("colon_col"), of("NUMBER", "data").alias("number"), of("RCBRACK", "col").alias("end_col"))


_TOKEN_ERRORS = [("01x", "err_number"), ("-", "err_number_lone_minus"), ("1.", "err_number_no_frac"), ("1e", "err_number_no_exp"), ('"\\q"', "err_string_escape"), ('"abc', "err_string_unterminated"), ("#", "err_unexpected_char"), ("/* open", "err_eob")]


@query("select event_id, error, length(props)::int + case when error = 'err_string_escape' then 1 else 0 end as col from events join (values " + ", ".join(f"({i}, '{e}')" for i, (_, e) in enumerate(_TOKEN_ERRORS)) + f") t(i, error) on event_id % {len(_TOKEN_ERRORS)} = i")
def token_errors(spark, d):
    bad = F.element_at(F.array(*[F.lit(t) for t, _ in _TOKEN_ERRORS]), (F.col("event_id") % len(_TOKEN_ERRORS) + 1).cast("int"))
    rows = ops.tokens(_events(spark, d, "props").select("event_id", F.concat("props", bad).alias("doc")), "doc", strict=False)
    return rows.where("error is not null").select("event_id", "error", "col")


# texts


@query(f"""select key, '{{"id":' || key || ',"order":{{"cust":' || cust || ',"status":"' || status || '"}},"items":[' || key || ',' || cust || ']}}' as doc from {_O}""")
def print_compact(spark, d):
    text = F.replace(F.replace("doc", F.lit(","), F.lit(" , ")), F.lit(":"), F.lit("\t:\n"))
    return orders(spark, d).select("key", c.json_compact(text).alias("doc"))


_NL = "chr(10)"


@query(f"""select key, '{{' || {_NL} || '    "id": ' || key || ',' || {_NL} || '    "order": {{' || {_NL} || '        "cust": ' || cust || ',' || {_NL} || '        "status": "' || status || '"' || {_NL} || '    }},' || {_NL}
    || '    "items": [' || {_NL} || '        ' || key || ',' || {_NL} || '        ' || cust || {_NL} || '    ]' || {_NL} || '}}' as doc from {_O}""")
def print_pretty(spark, d):
    return orders(spark, d).select("key", c.json_print("doc").alias("doc"))


@query(f"""select key, '{{' || {_NL} || chr(9) || '"id": ' || key || ',' || {_NL} || chr(9) || '"items": [' || key || ', ' || cust || ']' || {_NL} || '}}' as doc from {_O}""")
def print_array_lines(spark, d):
    doc = F.to_json(F.struct(F.col("key").alias("id"), F.array("key", "cust").alias("items")))
    return orders(spark, d).select("key", c.json_print(doc, tabs=True, compact_array=True).alias("doc"))


@query(f"""select key, '{{"id":' || key || ',"items":[' || key || ',' || cust || '],"order":{{"cust":' || cust || ',"status":"' || status || '"}}}}' as doc from {_O}""")
def print_sorted(spark, d):
    return orders(spark, d).select("key", c.json_print("doc", pretty=False, sorted=True).alias("doc"))


@query("""select page_id, '"' || replace(url, '/', '\\/') || '"' as doc from pages""")
def print_escape_slash(spark, d):
    return ops.spread(_table(spark, d, "pages").select("page_id", "url")).select("page_id", c.json_print(c.json_from("url"), pretty=False, escape_slash=True).alias("doc"))


@query(f"""select key, '{{id:' || key || ',"a b":' || cust || ',"True":1}}' as doc from {_O}""")
def print_relaxed(spark, d):
    text = F.concat(F.lit('{"id":'), "key", F.lit(',"a b":'), "cust", F.lit(',"True":1}'))
    return orders(spark, d).select("key", c.json_print(text, pretty=False, relaxed=True).alias("doc"))


@query(f"select key, key::varchar as plain, (cust * 1000)::varchar as scaled, case when key % 997 = 0 then '0' else '0.' || rtrim(lpad((key % 997)::varchar, 3, '0'), '0') end as fraction from {_O}")
def number_canonical(spark, d):
    num = lambda *parts: c.json_canonical(F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]))
    return orders(spark, d).select("key", num(F.col("key"), ".000").alias("plain"), num(F.col("cust"), "E+3").alias("scaled"), num("0.", F.lpad((F.col("key") % 997).cast("string"), 3, "0"), "00").alias("fraction"))


@query("select doc_id, substr(to_json(text)::varchar, 2, length(to_json(text)::varchar) - 2) as escaped from documents")
def escape_text(spark, d):
    return ops.spread(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", c.json_escape("text").alias("escaped"))


@query("select doc_id, text from documents")
def unescape_roundtrip(spark, d):
    return ops.spread(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", c.json_unescape(c.json_escape("text", slash=True)).alias("text"))


_C0 = "chr(27)"


@query(f"""select key, '{{' || {_C0} || '[36m"n"' || {_C0} || '[0m:' || {_C0} || '[33m' || cust || {_C0} || '[0m,' || {_C0} || '[36m"s"' || {_C0} || '[0m:' || {_C0} || '[32m"' || status || '"' || {_C0} || '[0m}}' as doc from {_O}""")
def print_color(spark, d):
    text = F.concat(F.lit('{"n":'), "cust", F.lit(',"s":"'), "status", F.lit('"}'))
    return orders(spark, d).select("key", c.json_print(text, pretty=False, color=True).alias("doc"))


@query(f"""select key, '"' || status || chr(233) || chr(8364) || chr(128512) || key || '"' as doc, case when key % 2 = 0 then 'ok' else 'invalid_utf8' end as code from {_O}""")
def unicode_escapes(spark, d):
    """Escapes of characters inside and outside the basic plane, and halves of surrogate pairs."""
    text = F.concat(F.lit('"'), "status", F.lit("\\u00e9\\u20AC\\ud83d\\uDE00"), "key", F.lit('"'))
    half = F.concat(F.lit('"'), "key", F.when(F.col("key") % 2 == 0, F.lit("\\ud83d\\ude00")).otherwise(F.lit("\\ud83d")), F.lit('"'))
    return orders(spark, d).select("key", c.json_compact(text).alias("doc"), c.json_parse_error(half)["code"].alias("code"))


# equality and order


@query(f"select key, key % 3 <> 0 as same, key = cust as other from {_O}")
def equals_any_order(spark, d):
    items = F.when(F.col("key") % 3 == 0, F.col("cust") + 1).otherwise(F.col("cust"))
    again = F.concat(F.lit('{"items":['), "key", F.lit(".0,"), items, F.lit('],"id":'), "key", F.lit(',"order":{"status":"'), "status", F.lit('","cust":'), "cust", F.lit("}}"))
    turned = F.concat(F.lit('{"a":['), "cust", F.lit(","), "key", F.lit("]}"))
    return orders(spark, d).select("key", c.json_equals("doc", again).alias("same"), c.json_equals(F.concat(F.lit('{"a":['), "key", F.lit(","), "cust", F.lit("]}")), turned).alias("other"))


@query("select count(distinct (nation, segment)) as n from " + _C)
def distinct_canonical(spark, d):
    one, two = F.to_json(F.struct("nation", "segment")), F.to_json(F.struct("segment", "nation"))
    doc = F.when(F.col("key") % 2 == 0, one).otherwise(two)
    return customers(spark, d).select(c.json_canonical(doc).alias("k")).agg(F.countDistinct("k").alias("n"))


@query(f"select a.nation, count(*) as n from (select distinct nation, segment from {_C}) a join {_C} b using (nation, segment) group by all")
def join_on_canonical(spark, d):
    t = customers(spark, d)
    a = t.select("nation", c.json_canonical(F.to_json(F.struct("nation", "segment"))).alias("k")).distinct()
    b = t.select(c.json_canonical(F.to_json(F.struct("segment", "nation"))).alias("k"))
    return a.join(b, "k").groupBy("nation").agg(F.count("*").alias("n"))


@query(f"select key, case when key < cust then -1 when key > cust then 1 else 0 end as numbers, -1 as types from {_O}")
def compare_documents(spark, d):
    as_text = lambda x: F.col(x).cast("string")
    return orders(spark, d).select("key", c.json_compare(as_text("key"), as_text("cust")).alias("numbers"), c.json_compare(as_text("key"), F.lit('"a"')).alias("types"))


@query(f"select key, case when key % 2 = 0 and key < cust then -1 when key % 2 = 0 and key > cust then 1 when key % 2 = 0 then 0 else -1 end as objects from {_C.replace('c_nationkey::bigint as nation', 'c_nationkey::bigint as nation, c_nationkey::bigint as cust')}")
def compare_objects(spark, d):
    """Members count by name: with one name the value decides, else the name."""
    one = F.concat(F.lit('{"z":1,"a":'), "key", F.lit("}"))
    other = F.concat(F.when(F.col("key") % 2 == 0, F.lit('{"a":')).otherwise(F.lit('{"b":')), "nation", F.lit(',"z":1}'))
    return customers(spark, d).select("key", c.json_compare(one, other).alias("objects"))


@query(f"select key, '[' || array_to_string(list_sort([key, cust, 7]), ',') || ',\"x\"]' as sorted, '[' || key || ',' || cust || ',1]' as joined from {_O}")
def array_sort_concat(spark, d):
    items = F.concat(F.lit('["x",'), "key", F.lit(","), "cust", F.lit(",7]"))
    return orders(spark, d).select("key", c.json_array_sort(items).alias("sorted"), c.json_concat(c.json_get("doc", "/items"), F.lit("[1]")).alias("joined"))


@query("select key, case when key % 3 = 0 then 'changed' when key % 3 = 1 then 'equal' else 'removed' end as status from " + _C + " union all select -key, 'added' from " + _C + " where nation = 3")
def document_differences(spark, d):
    t = customers(spark, d).select("key", "doc")
    right = t.where("key % 3 <> 2").withColumn("doc", F.when(F.col("key") % 3 == 0, F.lit("{}")).otherwise(c.json_print("doc", sorted=True)))
    extra = customers(spark, d).where("nation = 3").select((-F.col("key")).alias("key"), "doc")
    return ops.differences(t, right.union(extra), ["key"], "doc").select("key", "status")


# changes


@query(f"""select key, '{{"cust":' || cust || ',"status":"X"}}' as added, '{{"cust":' || cust || ',"status":"' || status || '","n":' || key || '}}' as appended, '{{"status":"' || status || '"}}' as removed,
    '[' || key || ',' || cust || ',9]' as pushed, '[' || cust || ']' as shorter from {_O}""")
def document_changes(spark, d):
    order, items = c.get("/order"), c.get("/items")
    changes = {"added": [order, c.add("status", '"X"')], "appended": [order, c.add("n", F.col("key").cast("string")), c.add("cust", "0", overwrite=False)], "removed": [order, c.remove_key("cust")], "pushed": [items, c.append("9")], "shorter": [items, c.remove_index(0)]}
    return orders(spark, d).withColumn("c", c.json_apply("doc", changes)).select("key", "c.*")


@query(f"""select key, '{{"cust":' || cust || ',"status":"X"}}' as added, '[' || key || ',' || cust || ',9]' as pushed, '{{"status":"' || status || '"}}' as removed, '[' || cust || ']' as shorter from {_O}""")
def single_changes(spark, d):
    order, items = c.json_get("doc", "/order"), c.json_get("doc", "/items")
    return orders(spark, d).select("key", c.json_add(order, "status", '"X"').alias("added"), c.json_append(items, "9").alias("pushed"), c.json_remove_key(order, "cust").alias("removed"), c.json_remove_index(items, 0).alias("shorter"))


@query(f"""select key, '{{"cust":"' || key || '","status":"' || status || '"}}' as changed, '{{"cust":' || cust || ',"status":' || case when status = 'O' then '"O"' else '[]' end || '}}' as retyped, '[' || key || ',' || cust || ']' as replaced from {_O}""")
def typed_setters(spark, d):
    order = c.json_get("doc", "/order")
    retyped = F.when(F.col("status") == "O", c.json_set_type(order, "/status", "string")).otherwise(c.json_set_type(order, "/status", "array"))
    return orders(spark, d).select("key", c.json_set(order, "/cust", F.concat(F.lit('"'), "key", F.lit('"'))).alias("changed"), retyped.alias("retyped"), c.json_set(order, "", c.json_get("doc", "/items")).alias("replaced"))


@query(f"select key, case when key % 3 <> 0 then '\"' || name || '\"' else 'null' end as value, key % 3 = 0 as created from {_C}")
def get_or_create(spark, d):
    t = forms(spark, d).withColumn("g", c.json_get_or_add("doc", "name"))
    return t.select("key", "g.value", (F.endswith("g.doc", F.lit(',"name":null}'))).alias("created"))


@query(f"select key, '\"' || status || '\"' as text, cust::varchar as number, 'null' as nothing, '{{}}' as empty from {_O}")
def construct_values(spark, d):
    return orders(spark, d).select("key", c.json_from("status").alias("text"), c.json_from("cust").alias("number"), c.json_from(F.lit(None).cast("string")).alias("nothing"), c.json_default("object").alias("empty"))


def _patched(operations: str):
    return lambda spark, d: orders(spark, d).withColumn("p", c.json_patch(c.json_get("doc", "/order"), operations)).select("key", F.array_join("p.results", ",").alias("results"), F.col("p.doc").alias("doc"))


_PATCHES = {
    "add": ('[{"op":"add","path":"/n","value":1},{"op":"add","path":"/n","value":[2]},{"op":"add","path":"/n/-","value":3},{"op":"add","path":"/n/0","value":0}]', "patch_ok,patch_ok,patch_ok,patch_ok", """'{"cust":' || cust || ',"status":"' || status || '","n":[0,2,3]}'"""),
    "remove": ('{"op":"remove","path":"/cust"}', "patch_ok", """'{"status":"' || status || '"}'"""),
    "replace": ('[{"op":"replace","path":"/status","value":null},{"op":"replace","path":"/x","value":1}]', "patch_ok,patch_noent", """'{"cust":' || cust || ',"status":null}'"""),
    "move": ('[{"op":"move","from":"/cust","path":"/c~1d"}]', "patch_ok", """'{"status":"' || status || '","c/d":' || cust || '}'"""),
    "copy": ('[{"op":"copy","from":"/cust","path":"/again"}]', "patch_ok", """'{"cust":' || cust || ',"status":"' || status || '","again":' || cust || '}'"""),
    "test": ('[{"op":"test","path":"/status","value":"O"},{"op":"test","path":"/no","value":1}]', None, """'{"cust":' || cust || ',"status":"' || status || '"}'"""),
    "partial_failure": ('[{"op":"add","path":"/a","value":1},{"op":"remove","path":"/zz"},{"op":"jump","path":"/a"},{"op":"add","path":"/b","value":2}]', "patch_ok,patch_noent,patch_invalid,patch_ok", """'{"cust":' || cust || ',"status":"' || status || '","a":1,"b":2}'"""),
}
for _name, (_operations, _results, _doc) in _PATCHES.items():
    _said = f"'{_results}'" if _results else "case when status = 'O' then 'patch_ok' else 'patch_fail' end || ',patch_noent'"
    query(f"select key, {_said} as results, {_doc} as doc from {_O}", f"patch_{_name}")(_patched(_operations))


@query(f"""select key, case when key % 2 = 0 then '{{"cust":' || cust || '}}' else '{{"cust":' || cust || ',"status":"' || status || '"}}' end as doc, key % 2 = 0 as ok from {_O}""")
def patch_column_atomic(spark, d):
    steps = F.concat(F.lit('[{"op":"remove","path":"/status"}'), F.when(F.col("key") % 2 == 0, "").otherwise(',{"op":"remove","path":"/no"}'), F.lit("]"))
    t = orders(spark, d).withColumn("p", c.json_patch(c.json_get("doc", "/order"), steps, atomic=True))
    return t.select("key", "p.doc", "p.ok")


@query(f"""select key, '{{"cust":0,"status":"' || status || '"}}' as doc, 'patch_ok' as results from {_O}""")
def patch_at_pointer(spark, d):
    t = orders(spark, d).withColumn("p", c.json_patch("doc", '{"op":"replace","path":"/cust","value":0}', ptr="/order"))
    return t.select("key", "p.doc", F.array_join("p.results", ",").alias("results"))


@query(f"""select c.key, '{{"orders":[' || coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') || ']}}' as doc, count(o_orderkey)::int as applied from {_C} c left join orders on o_custkey = c.key group by c.key""")
def patch_fold(spark, d):
    docs = customers(spark, d).select("key", F.lit('{"orders":[]}').alias("doc"))
    steps = orders(spark, d).select(F.col("cust").alias("key"), F.col("key").alias("seq"), F.concat(F.lit('{"op":"add","path":"/orders/-","value":'), "key", F.lit("}")).alias("patch"))
    return ops.fold_patches(docs, steps, "key", "seq")


# suites of cases: six for each order or customer, whose outcome depends on its columns
@query(
    f"""select key, u.place::int as place, case u.place when 0 then case when cust % 2 = 0 then 'passed' else 'failed' end when 1 then case when status = 'O' then 'failed' else 'passed' end
    when 2 then 'disabled' when 3 then 'invalid' when 4 then 'disabled' else case when cust % 5 = 0 then 'passed' else 'failed' end end as status
    from {_O}, (select unnest([0, 1, 2, 3, 4, 5]) as place) u"""
)
def patch_suite(spark, d):
    text = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    suite = text(
        *['[{"doc":{"c":', F.col("cust"), '},"patch":[{"op":"add","path":"/even","value":true}],"expected":{"even":', F.when(F.col("cust") % 2 == 0, "true").otherwise("false"), ',"c":', F.col("cust"), "}},"],
        *['{"doc":"', F.col("status"), '","patch":[{"op":"test","path":"","value":"O"}],"error":"another status"},'],
        '{"doc":{},"patch":[],"disabled":true},{"doc":{},"patch":[{"op":"remove","path":"/a"}]},{"comment":"what follows"},',
        *['{"doc":[', F.col("cust") % 5, '],"patch":[{"op":"test","path":"/0","value":0}]}]'],
    )
    return ops.patch_suite(orders(spark, d).withColumn("suite", suite), "suite").select("key", "place", "status")


@query(
    f"""select key, u.place::int as place, u.test::int as test, case when u.place = 1 then 'invalid' when u.test = 2 then 'disabled' when (nation >= 10) = (u.test = 0) then 'passed' else 'failed' end as status
    from {_C}, (values (0, 0), (0, 1), (0, 2), (1, 0)) u(place, test)"""
)
def schema_suite(spark, d):
    n = F.col("nation").cast("string")
    tests = F.concat(F.lit('[{"data":'), n, F.lit(',"valid":true},{"data":'), n, F.lit(',"valid":false},{"data":0,"valid":true,"disabled":true}]'))
    suite = F.concat(F.lit('[{"schema":{"minimum":10},"tests":'), tests, F.lit('},{"schema":{"minimum":"x"},"tests":[{"data":1,"valid":true}]}]'))
    return ops.schema_suite(customers(spark, d).withColumn("suite", suite), "suite").select("key", "place", "test", "status")


# schemas: keyword to (schema, SQL predicate over the base columns of customers)

SCHEMAS = {
    "type": ('{"properties":{"nation":{"type":"integer"},"extra_member":{"type":["null","string"]}}}', "key % 4 <> 0"),
    "type_fails": ('{"properties":{"nation":{"type":"string"}}}', "key % 4 = 0"),
    "enum": ('{"properties":{"segment":{"enum":["BUILDING","MACHINERY"]}}}', "segment in ('BUILDING', 'MACHINERY')"),
    "const": ('{"properties":{"nation":{"const":3.0}}}', "nation = 3"),
    "multiple_of": ('{"properties":{"key":{"multipleOf":2.5}}}', "key % 5 = 0"),
    "maximum": ('{"properties":{"nation":{"maximum":10}}}', "nation <= 10"),
    "exclusive_maximum": ('{"properties":{"nation":{"exclusiveMaximum":10}}}', "nation < 10"),
    "minimum": ('{"properties":{"nation":{"minimum":10}}}', "nation >= 10"),
    "exclusive_minimum": ('{"properties":{"nation":{"exclusiveMinimum":10}}}', "nation > 10"),
    "max_length": ('{"properties":{"segment":{"maxLength":8}}}', "length(segment) <= 8"),
    "min_length": ('{"properties":{"segment":{"minLength":9}}}', "length(segment) >= 9"),
    "pattern": ('{"properties":{"segment":{"pattern":"^[A-M].*G$"}}}', "regexp_matches(segment, '^[A-M].*G$')"),
    "max_items": ('{"properties":{"tags":{"maxItems":1}}}', "key % 4 <= 1"),
    "min_items": ('{"properties":{"tags":{"minItems":2}}}', "key % 4 >= 2"),
    "unique_items": ('{"properties":{"tags":{"uniqueItems":true}}}', "nation <> nation % 3"),
    "contains": ('{"properties":{"tags":{"contains":{"const":1}}}}', "nation = 1 or nation % 3 = 1"),
    "max_contains": ('{"properties":{"tags":{"contains":{"minimum":1},"maxContains":1}}}', "(nation >= 1)::int + (nation % 3 >= 1)::int = 1"),
    "min_contains": ('{"properties":{"tags":{"contains":{"minimum":1},"minContains":2}}}', "(nation >= 1)::int + (nation % 3 >= 1)::int = 2"),
    "max_properties": ('{"maxProperties":4}', "3 + (key % 3 <> 0)::int + (key % 5 = 0)::int <= 4"),
    "min_properties": ('{"minProperties":4}', "3 + (key % 3 <> 0)::int + (key % 5 = 0)::int >= 4"),
    "required": ('{"required":["key","name"]}', "key % 3 <> 0"),
    "dependent_required": ('{"dependentRequired":{"name":["extra_member"]}}', "key % 3 = 0 or key % 5 = 0"),
    "dependent_schemas": ('{"dependentSchemas":{"key":{"properties":{"nation":{"minimum":5}}}}}', "nation >= 5"),
    "all_of": ('{"allOf":[{"properties":{"nation":{"minimum":5}}},{"properties":{"nation":{"maximum":15}}}]}', "nation between 5 and 15"),
    "any_of": ('{"anyOf":[{"properties":{"nation":{"maximum":5}}},{"properties":{"nation":{"minimum":15}}}]}', "nation <= 5 or nation >= 15"),
    "one_of": ('{"oneOf":[{"properties":{"nation":{"maximum":15}}},{"properties":{"nation":{"minimum":5}}}]}', "nation < 5 or nation > 15"),
    "not": ('{"not":{"properties":{"segment":{"const":"BUILDING"}}}}', "segment <> 'BUILDING'"),
    "if_then_else": ('{"if":{"properties":{"nation":{"minimum":12}}},"then":{"properties":{"key":{"multipleOf":2}}},"else":{"properties":{"key":{"multipleOf":3}}}}', "case when nation >= 12 then key % 2 = 0 else key % 3 = 0 end"),
    "prefix_items": ('{"properties":{"tags":{"prefixItems":[{"minimum":4},{"const":1}]}}}', "nation >= 4 and nation % 3 = 1"),
    "items": ('{"properties":{"tags":{"items":{"minimum":1}}}}', "nation >= 1 and nation % 3 >= 1"),
    "items_after_prefix": ('{"properties":{"tags":{"prefixItems":[true],"items":{"minimum":1}}}}', "nation % 3 >= 1"),
    "pattern_properties": ('{"patternProperties":{"^na":{"minLength":1,"maximum":9}}}', "nation <= 9"),
    "additional_properties": ('{"properties":{"key":true,"nation":true},"patternProperties":{"^na":true},"additionalProperties":{"maxItems":1}}', "key % 4 <= 1"),
    "property_names": ('{"propertyNames":{"maxLength":7}}', "key % 5 <> 0"),
    "ref": ('{"properties":{"nation":{"$ref":"#/$defs/small"},"tags":{"items":{"$ref":"#low"}}},"$defs":{"small":{"maximum":20},"l":{"$anchor":"low","minimum":1}}}', "nation <= 20 and nation >= 1 and nation % 3 >= 1"),
    "dynamic_ref": ('{"$id":"https://example.com/root","$ref":"list","$defs":{"item":{"$dynamicAnchor":"item","minimum":2},"list":{"$id":"list","properties":{"tags":{"items":{"$dynamicRef":"#item"}}},"$defs":{"any":{"$dynamicAnchor":"item"}}}}}', "nation >= 2 and nation % 3 >= 2"),
    "unevaluated_properties": ('{"allOf":[{"properties":{"key":true,"name":true,"tags":true}}],"anyOf":[{"properties":{"nation":{"minimum":10},"segment":true},"required":["nation"]}],"unevaluatedProperties":false}', "nation >= 10"),
    "unevaluated_items": ('{"properties":{"tags":{"allOf":[{"prefixItems":[true]}],"contains":{"const":1},"unevaluatedItems":false,"minContains":0}}}', "nation % 3 = 1"),
}
#: Schemas about presence, lengths, types and names are held against documents in which these vary.
VARIED = {"type", "type_fails", "max_items", "min_items", "max_properties", "min_properties", "required", "dependent_required", "additional_properties", "property_names"}
for _name, (_schema, _predicate) in SCHEMAS.items():
    _docs = forms if _name in VARIED else customers
    query(f"select key, ({_predicate}) as valid from {_C}", f"schema_{_name}")(lambda spark, d, s=_schema, docs=_docs: docs(spark, d).select("key", c.json_schema_valid("doc", s).alias("valid")))


def _resolved(uri):
    return '{"minimum":5}' if uri == "https://example.com/least" else None


@query(f"select key, nation between 5 and 20 and segment <> 'BUILDING' and nation % 3 <= 1 as valid from {_C}")
def schema_references(spark, d):
    """Schemas named by alias and by $id, and one that a resolver gives while the schema is loaded."""
    schema = '{"properties":{"nation":{"allOf":[{"$ref":"https://example.com/least"},{"$ref":"most"}]},"segment":{"$ref":"https://example.com/segments#/$defs/own"},"tags":{"items":{"$ref":"https://example.com/segments#low"},"prefixItems":[true]}}}'
    most, segments = '{"maximum":20}', '{"$id":"https://example.com/segments","$defs":{"own":{"not":{"const":"BUILDING"}},"l":{"$anchor":"low","maximum":1}}}'
    return customers(spark, d).select("key", c.json_schema_valid("doc", schema, references={"most": most, "https://example.com/segments": segments}, resolver=_resolved).alias("valid"))


@query(f"select key, case when nation % 3 = 0 then null when nation % 3 = 1 then '/properties/a' else '' end as pointer, case when nation % 3 = 0 then null else 'https://example.com/' || nation end as base_uri from {_C}")
def schema_unusable(spark, d):
    """Schemas in a column: sound ones, with a limit that is no number, and of another dialect."""
    name = F.concat(F.lit('{"$id":"https://example.com/'), "nation", F.lit('",'))
    wrong = F.when(F.col("nation") % 3 == 0, F.lit('"properties":{"a":{"maximum":3}}}')).when(F.col("nation") % 3 == 1, F.lit('"properties":{"a":{"maximum":"3"}}}')).otherwise(F.lit('"minLength":-1}'))
    t = customers(spark, d).withColumn("e", c.json_schema_error(F.concat(name, wrong)))
    return t.select("key", "e.pointer", "e.base_uri")


def _some_member(value, fits):
    return None if not isinstance(value, c.Members) or any(fits(v) for _, v in value) else "no member fits"


@query(f"select key, nation >= 20 as valid from {_C}")
def schema_own_applicator(spark, d):
    schema = '{"someMember":{"type":"integer","minimum":20,"maximum":24}}'
    one = F.concat(F.lit('{"a":"x","nation":'), "nation", F.lit("}"))
    return customers(spark, d).select("key", c.json_schema_valid(one, schema, applicators={"someMember": _some_member}).alias("valid"))


def _even(value, wanted):
    return None if not wanted or not isinstance(value, c.Decimal) or value % 2 == 0 else "Number is odd."


@query(f"select key, nation % 2 = 0 as valid from {_C}")
def schema_own_keyword(spark, d):
    return customers(spark, d).select("key", c.json_schema_valid("doc", '{"properties":{"nation":{"even":true}}}', keywords={"even": _even}).alias("valid"))


_FAILING = '{"required":["key"],"properties":{"nation":{"maximum":10},"segment":{"const":"BUILDING"}}}'


@query(f"""select key, '/nation' as instance_location, '/properties/nation/maximum' as keyword_location, 'above the maximum of 10' as error from {_C} where nation > 10
    union all select key, '/segment', '/properties/segment/const', 'the value differs from the constant' from {_C} where segment <> 'BUILDING'""")
def schema_error_rows(spark, d):
    return ops.schema_errors(customers(spark, d).select("key", "doc"), "doc", _FAILING).select("key", "instance_location", "keyword_location", "error")


@query(f"""select key, nation > 10 as failed, case when nation > 10 then '{{"valid":false,"instanceLocation":"","keywordLocation":"","errors":[{{"valid":false,"instanceLocation":"","keywordLocation":"/properties","error":"a member does not meet its schema","errors":[{{"valid":false,"instanceLocation":"/nation","keywordLocation":"/properties/nation","errors":[{{"valid":false,"instanceLocation":"/nation","keywordLocation":"/properties/nation/maximum","error":"above the maximum of 10"}}]}}]}}]}}'
    else '{{"valid":true,"instanceLocation":"","keywordLocation":"","annotations":[{{"valid":true,"instanceLocation":"","keywordLocation":"/properties","annotation":["nation"],"annotations":[{{"valid":true,"instanceLocation":"/nation","keywordLocation":"/properties/nation","annotations":[{{"valid":true,"instanceLocation":"/nation","keywordLocation":"/properties/nation/maximum"}}]}}]}}]}}' end as output from {_C}""")
def schema_output_unit(spark, d):
    t = customers(spark, d).withColumn("v", c.json_schema_validate("doc", '{"properties":{"nation":{"maximum":10}}}', full=True))
    return t.select("key", (~F.col("v.valid")).alias("failed"), "v.output")


#: Schemas of SCHEMAS that native expressions can hold.
NATIVE = [n for n in SCHEMAS if n not in ("unique_items", "contains", "max_contains", "min_contains", "prefix_items", "items_after_prefix", "pattern_properties", "additional_properties", "property_names", "dynamic_ref", "unevaluated_properties", "unevaluated_items")]


@query("select name, (select count(*) from customer) as n, 0::bigint as different from (values " + ", ".join(f"('{n}')" for n in NATIVE) + ") t(name)")
def compiled_vs_kernel(spark, d):
    parts = []
    for docs, names in ((customers, [n for n in NATIVE if n not in VARIED]), (forms, [n for n in NATIVE if n in VARIED])):
        t = docs(spark, d).withColumn("v", F.try_parse_json("doc"))
        sides = [F.struct(F.lit(n).alias("name"), plans.schema_predicate(SCHEMAS[n][0], F.col("v")).alias("a"), c.json_schema_valid("doc", SCHEMAS[n][0]).alias("b")) for n in names]
        parts.append(t.select(F.explode(F.array(*sides)).alias("s")))
    rows = parts[0].union(parts[1])
    return rows.groupBy("s.name").agg(F.count("*").alias("n"), F.sum((F.col("s.a") != F.col("s.b")).cast("bigint")).alias("different"))


@query(f"select key, (nation <= 20 and segment in ('BUILDING', 'MACHINERY')) as valid from {_C}")
def schema_compiled(spark, d):
    schema = '{"type":"object","required":["nation"],"properties":{"nation":{"type":"integer","maximum":20},"segment":{"enum":["BUILDING","MACHINERY"]}}}'
    return customers(spark, d).select("key", plans.compiled_valid("doc", schema).alias("valid"))


# files, lines and streams


@query("select event_type, count(*) as n, sum((event_id % 7 <> 0)::bigint)::bigint as n_valid, bool_and(event_id % 7 <> 0) as all_valid from events group by all")
def verify_rollup(spark, d):
    t = _events(spark, d, "event_type", "props").select("event_type", F.concat("props", F.when(F.col("event_id") % 7 == 0, "]").otherwise("")).alias("doc"))
    return ops.verdict_by(ops.verify(t, "doc", '{"required":["k"]}'), "verdict", "event_type")


@query(f"select key, cust::varchar as view from {_O} where key % 2 = 0")
def view_of_type(spark, d):
    doc = F.when(F.col("key") % 2 == 0, F.col("doc")).otherwise(F.lit('{"order":{"cust":"none"}}'))
    return ops.view(orders(spark, d).withColumn("doc", doc), "doc", "/order/cust", "number").select("key", "view")


def _files(spark) -> str:
    """A new folder for files that a query writes and reads again: in the folder that driver and executors share, if one is set."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/docquarry-files/{uuid.uuid4().hex}"


#: Files that one task writes.
FILES = 1000


def _lines(spark, d) -> DataFrame:
    t = _table(spark, d, "events")
    return t.select(F.concat(F.lit('{"id":'), "event_id", F.lit(',"type":"'), "event_type", F.lit('"'), F.when(F.col("event_id") % 5 == 0, "").otherwise("}")).alias("value"))


@query("select event_id as id, '\"' || event_type || '\"' as type from events where event_id % 5 <> 0")
def lines_batch(spark, d):
    path = _files(spark)
    _lines(spark, d).write.text(path)
    docs = sources.read_document_lines(spark, path, "DROPMALFORMED")
    return docs.select(c.json_get("doc", "/id").cast("bigint").alias("id"), c.json_get("doc", "/type").alias("type"))


@query("select event_id % 5 <> 0 as valid, count(*) as n from events group by all")
def lines_stream(spark, d):
    path = _files(spark)
    _lines(spark, d).write.text(f"{path}/in")
    docs = streaming.stream_document_lines(spark, f"{path}/in").where("error is null")
    streaming.write_stream(docs, "doc", f"{path}/out", f"{path}/state").awaitTermination()
    out = spark.read.text(f"{path}/out").select(F.lit(True).alias("valid"))
    bad = sources.read_document_lines(spark, f"{path}/in").where("error is not null").select(F.lit(False).alias("valid"))
    return out.union(bad).groupBy("valid").agg(F.count("*").alias("n"))


@query("select s_suppkey as key, '{\"name\":\"' || s_name || '\",\"balance\":' || s_nationkey || '}' as doc from supplier")
def files_round_trip(spark, d):
    path = _files(spark)
    t = ops.spread(_table(spark, d, "supplier"), FILES).select(F.concat(F.lit('{\n "key": '), "s_suppkey", F.lit(',\n "name": "'), "s_name", F.lit('",\n "balance": '), "s_nationkey", F.lit("\n}")).alias("value"))
    # each task moves its own files into place; the folder is this query's alone
    t.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    docs = sources.read_documents(spark, path).select("doc")
    return docs.select(c.json_get("doc", "/key").cast("bigint").alias("key"), c.json_remove_key("doc", "key").alias("doc"))
