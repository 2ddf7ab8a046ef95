"""What keeps tasks and memory bounded when tables grow, shown on small ones."""

import os

from pyspark.sql import functions as F

from docquarry import operators as ops
from docquarry import queries, sources
from docquarry.functions import columns as c
from docquarry.kernel.parser import parse
from docquarry.kernel.schema import JsonSchema, engine


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_spread_deals_out_splits_of_one_row_group(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and most_rows(df) == 20_000
        dealt = ops.spread(df, 500)
        assert most_rows(dealt) <= 1000 and dealt.agg(F.count("*"), F.sum("id")).first()[:] == (20_000, 199_990_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert ops.spread(spark.range(0)).count() == 0


def test_spread_holds_no_split_in_memory(spark, tmp_path):
    """Rows are dealt out by number, without a sort of the split; more parts than Spark writes row by row come in two steps."""
    path = str(tmp_path / "t.parquet")
    texts = spark.range(20_000).select(F.col("id").alias("_number"), (F.col("id") % 7).cast("string").alias("_PART"))
    texts.coalesce(1).write.parquet(path)
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    few, many = ops.spread(df, 2_000), ops.spread(df, 20)
    for dealt, steps in ((few, 1), (many, 2)):
        assert "RoundRobin" not in plan(dealt) and plan(dealt).count("Exchange") == steps and dealt.columns == df.columns
        n = dealt.rdd.getNumPartitions()
        assert most_rows(dealt) == -(-20_000 // n) and (n > ops.DIRECT_PARTS) == (steps == 2)
        assert dealt.exceptAll(df).count() == 0 and dealt.count() == 20_000
    assert most_rows(ops.spread(spark.range(0, cores - 1, 1, max(1, cores - 1)))) <= 1  # a row for each core


def test_spread_leaves_rows_without_fixed_order_to_spark(spark):
    """The numbers of rows that come out of a shuffle could change when a task is run again."""
    for df in (spark.range(20_000).repartition(1), spark.range(20_000).groupBy("id").count().coalesce(1)):
        dealt = ops.spread(df, 500)
        assert "RoundRobin" in plan(dealt) and most_rows(dealt) <= 1000 and dealt.select("id").distinct().count() == 20_000


def test_files_are_written_by_many_tasks(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_files", lambda spark: f"file://{tmp_path}/files")
    rows = queries.QUERIES["files_round_trip"](spark, small).collect()
    n = spark.read.parquet(f"{small}/supplier.parquet").count()
    files = [f for f in os.listdir(tmp_path / "files") if f.startswith("part-")]
    assert len(rows) == len(files) == n and len({f.split("-")[1] for f in files}) > 1


def column(df, expression):
    return [r[0] for r in df.select(expression.alias("x")).collect()]


def test_functions_around_one_another_read_once(spark):
    """They say what they would say to the texts between them, numbers in their printed form among others."""
    df = spark.createDataFrame([('{"a":{"x":1.50,"y":-0,"x":[1e3]},"b":[7]}',), ('{"a":[2.50,-0]}',), ("{",), (None,)], "doc string").coalesce(1)
    inner = lambda: F.coalesce(c.json_get("doc", "/a"), F.lit(None).cast("string"))  # noqa: E731  # no text of ours
    for outer in (
        lambda x: c.json_get(x, "/x"), lambda x: c.json_get(x, "/0"), lambda x: c.json_set(x, "/x", "1"), lambda x: c.json_set(x, "/1", F.lit("[]")), lambda x: c.json_set_type(x, "/x", "array"), lambda x: c.json_remove_key(x, "x"),
        lambda x: c.json_remove_index(x, 1), lambda x: c.json_append(x, F.lit("0.0")), lambda x: c.json_add(x, "x", "5"), lambda x: c.json_add(x, "x", F.lit("5"), overwrite=False), lambda x: c.json_patch(x, '{"op":"test","path":"/y","value":0}')["doc"],
        lambda x: c.json_as_double(x, "/1").cast("string"), lambda x: c.json_print(x), lambda x: c.json_get(x, "/x", max_depth=1),
    ):
        assert column(df, outer(c.json_get("doc", "/a"))) == column(df, outer(inner()))
    assert column(df, c.json_set("doc", "/a", c.json_get("doc", "/b"))) == ['{"a":[7],"b":[7]}', None, None, None]

    around = df.select(c.json_set_type(c.json_set(c.json_get("doc", "/a"), "/x", "1"), "/y", "string"), c.json_set("doc", "/a", c.json_get("doc", "/b")))
    assert plan(around).count("ArrowEvalPython") == 1


def test_a_batch_is_read_once_for_all_functions_on_it(monkeypatch):
    import pyarrow as pa

    read = []
    monkeypatch.setattr(c, "parse", lambda text, **options: read.append(text) or parse(text, **options))
    texts = pa.array(['{"a":1}', None, "[", "null"])
    for _ in range(3):
        assert list(c._values(texts, {})) == [[("a", 1)], c.pointer.NOTHING, c.pointer.NOTHING, None]
    assert len(read) == 3
    assert list(c._values(texts, {"max_depth": 1})) == list(c._values(pa.array(texts.to_pylist()), {"max_depth": 1})) and len(read) == 9
    monkeypatch.setattr(c, "SHARED_BYTES", 0)
    assert not isinstance(c._values(pa.array(["1"]), {}), list)  # a batch of much text is read as it is used


def test_changes_leave_the_value_they_are_given():
    value = parse('{"a":[1,{"b":2}],"a":[1,{"b":2}]}')
    assert c.compact(c._replaced(value, ["a", "1", "b"], None)) == '{"a":[1,{"b":2}],"a":[1,{"b":null}]}'
    assert c._with_member(value, "a", None, True) != value and c._with_member(value, "z", None, True) != value
    assert c.compact(value) == '{"a":[1,{"b":2}],"a":[1,{"b":2}]}'


def test_suites_print_and_judge_cases_from_one_reading(spark):
    df = spark.createDataFrame([('[{"doc":1.0,"patch":[],"expected":1},{"comment":"x"}]', "old"), ("{}", "old"), (None, "old")], "suite string, status string")
    out = ops.patch_suite(df, "suite")
    assert out.columns == ["suite", "status", "place", "case"]
    assert sorted((r["place"], r["case"], r["status"]) for r in out.collect()) == [(0, '{"doc":1,"patch":[],"expected":1}', "passed"), (1, '{"comment":"x"}', "disabled")]
    assert plan(out).count("ArrowEvalPython") == 1 and "elements(" in plan(out)
    assert plan(out.select("place", "status")).count("ArrowEvalPython") == 1 and "elements(" not in plan(out.select("place", "status"))


def test_verdicts_are_those_of_the_output():
    """Without the output no unit is built, and the verdict is the same."""
    docs = [parse(x) for x in ('{"n":1,"t":[1,2]}', '{"n":12,"t":[]}', '{"n":"x"}', "[1]", "null", '{"t":[{"t":[3]}]}')]
    schemas = [s for s, _ in queries.SCHEMAS.values()] + ['{"properties":{"t":{"items":{"$ref":"#"}},"n":{"maximum":5}}}', '{"not":{"required":["n"]},"unevaluatedProperties":false}', "{}", "false"]
    built = []
    was, engine._Unit.__init__ = engine._Unit.__init__, lambda self, *place: built.append(place) or was(self, *place)
    try:
        schemas = [JsonSchema(s) for s in schemas]
        verdicts = [[s.is_valid(d) for d in docs] for s in schemas]
        assert not built
        assert verdicts == [[not s.errors(d) for d in docs] for s in schemas] and built
    finally:
        engine._Unit.__init__ = was


def test_lines_are_read_once_though_filters_follow(spark):
    lines = sources.parsed_lines(spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "value string").coalesce(1))
    out = lines.where("error is null").select(c.json_print("doc", pretty=False, once=True).alias("value")).where("value is not null")
    assert [r[0] for r in out.collect()] == ['{"a":1}']
    assert plan(out).count("ArrowEvalPython") == 2
    assert plan(ops.view(lines, "doc", "/a", "number").select("view")).count("ArrowEvalPython") == 2
