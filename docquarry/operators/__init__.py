"""DataFrame operators: what the command line tools of a JSON library do to a file, done to a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.tables import JsonTokens
from ..kernel import patch as kernel_patch


def view(df: DataFrame, doc: str, pointer: str = "", type: str | None = None, out: str = "view", **style) -> DataFrame:
    """df with the printed value that pointer finds; with type, only where the value is of that type."""
    if type is None:
        return df.withColumn(out, c.json_print(doc, ptr=pointer, **style))
    return df.withColumn(out, c.json_print(doc, ptr=pointer, of_type=type, once=True, **style)).where(F.col(out).isNotNull())


def spread(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """df dealt out in parts of about `rows` rows at most, at least one for each core, if it comes in fewer or larger ones. A file
    with one row group would otherwise keep a single core busy, however dear the functions on its rows are, and its splits
    are no measure: all but one are empty. So the parts are counted first, which reads none of the columns."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    parts, total, most = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if parts >= cores and most <= rows:
        return df
    # whole rounds of all cores, so that none waits for a last round
    return _dealt(df, cores * max(1, -(-total // (rows * cores))))


#: To at most so many parts Spark writes a shuffle row by row, a file for each part; for more it gathers a split in memory first.
DIRECT_PARTS = 200


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """df in so many parts of equal counts, in memory that does not grow with a split. Rows go to parts by their numbers: without
    these Spark sorts each split before it deals it out. More than DIRECT_PARTS are dealt out in two steps, each task of the second
    one with a share of all rows only."""
    if not _repeatable(df):
        return df.repartition(parts)
    number, part = (name + "_" * max(map(len, df.columns), default=0) for name in ("_number", "_part"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in the split, from 0
    df = df.withColumn(number, place + F.spark_partition_id())  # small splits don't all begin with the same part
    for n in [DIRECT_PARTS, parts] if parts > DIRECT_PARTS else [parts]:
        df = df.withColumn(part, (F.col(number) % n).cast("int")).repartitionById(n, part)
    return df.drop(number, part)


def _repeatable(df: DataFrame) -> bool:
    """Whether a task that is run again gets its rows in the same order, as from files: only then may numbers decide."""
    run = df._jdf.queryExecution()
    return run.executedPlan().nodeName() != "AdaptiveSparkPlan" and run.toRdd().outputDeterministicLevel().toString() == "DETERMINATE"


def verify(df: DataFrame, doc: str, schema=None, references=(), out: str = "verdict", **options) -> DataFrame:
    """df with struct(valid, error): the syntax of each document, and its fit to a schema if there is one."""
    return df.withColumn(out, c.json_verdict(doc, schema, references, **options))


def verdict_by(df: DataFrame, verdict: str, *keys: str) -> DataFrame:
    """For each group: n, n_valid and all_valid."""
    valid = F.coalesce(F.col(f"{verdict}.valid"), F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(valid.cast("long")).alias("n_valid"), F.bool_and(valid).alias("all_valid"))


def error_counts(df: DataFrame, doc: str, *keys: str, **options) -> DataFrame:
    """keys, code and n: how many documents have each parse error, or none (ok)."""
    return df.where(F.col(doc).isNotNull()).groupBy(*keys, c.json_parse_error(doc, **options)["code"].alias("code")).agg(F.count("*").alias("n"))


def members(df: DataFrame, doc: str, pointer: str = "", sorted: bool = False) -> DataFrame:
    """A row for each member: the columns of df, with place, name and value."""
    entries = F.posexplode(c.json_entries(doc, pointer, sorted))
    return df.select("*", entries.alias("place", "_entry")).select(*df.columns, "place", "_entry.name", "_entry.value")


def elements(df: DataFrame, doc: str, pointer: str = "") -> DataFrame:
    """A row for each item of an array: the columns of df, with place and value."""
    return df.select("*", F.posexplode(c.json_elements(doc, pointer)).alias("place", "value"))


def flatten(df: DataFrame, doc: str, scalars: bool = False) -> DataFrame:
    """A row for the document and each value inside it, or for its scalars alone: the columns of df, with pointer, type and value."""
    return df.select("*", F.explode(c.json_flat(doc, scalars)).alias("_at")).select(*df.columns, "_at.pointer", "_at.type", "_at.value")


def tokens(df: DataFrame, doc: str, strict: bool = True) -> DataFrame:
    """A row for each token: the columns of df, with ordinal, type, row, col, data and error."""
    return df.lateralJoin(JsonTokens(F.col(doc).outer(), F.lit(strict)))


def schema_errors(df: DataFrame, doc: str, schema, references=()) -> DataFrame:
    """A row for each failure: the columns of df, with instance_location, keyword_location and error."""
    failures = F.explode(c.json_schema_failures(doc, schema, references))
    return df.select("*", failures.alias("_f")).select(*df.columns, "_f.*")


def patch_suite(df: DataFrame, suite: str, run_disabled: bool = False, rfc: bool = False) -> DataFrame:
    """A row for each test case of a suite (an array of them): the columns of df, with place (from 0), case and status."""
    # side by side: one reading does for both, and cases that nobody asks for are not printed
    both = df.withColumns({"_cases": c.json_elements(suite), "_statuses": c.json_patch_cases(suite, run_disabled, rfc, once=True)})
    rows = both.select("*", F.posexplode("_statuses").alias("place", "_status")).select("*", F.get("_cases", "place").alias("case"))
    return rows.withColumn("status", F.col("_status")).drop("_cases", "_statuses", "_status")


def schema_suite(df: DataFrame, suite: str, run_disabled: bool = False) -> DataFrame:
    """A row for each test of a suite (an array of groups): the columns of df, with place of the group, test (both from 0) and status."""
    groups = df.select("*", F.posexplode(c.json_elements(suite)).alias("place", "_group"))
    return groups.select(*df.columns, "place", F.posexplode(c.json_schema_cases("_group", run_disabled)).alias("test", "status"))


def differences(left: DataFrame, right: DataFrame, key: list[str], doc: str) -> DataFrame:
    """key, left, right and status (equal, changed, added, removed) of the documents of two tables."""
    a = left.select(*key, F.col(doc).alias("left"), c.json_canonical(doc).alias("_a"))
    b = right.select(*key, F.col(doc).alias("right"), c.json_canonical(doc).alias("_b"))
    a, b = a.withColumn("_in_a", F.lit(True)), b.withColumn("_in_b", F.lit(True))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "equal").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, "left", "right", status.alias("status"))


def fold_patches(documents: DataFrame, patches: DataFrame, key: str, order: str, doc: str = "doc", operations: str = "patch") -> DataFrame:
    """key, doc and applied: each document after all its patches, in order. Patches of unknown keys are left out.

    The patches of one key are applied in one task, one after the other, as each depends on the one before.
    """
    from pyspark.sql import types as T

    steps = patches.select(F.col(key), F.struct(F.col(order).alias("o"), F.col(operations).alias("p")).alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("_steps"))
    joined = documents.select(key, doc).join(steps, key, "left")

    def folded(text, steps):
        value = c._parsed(text, {})
        if value is c.pointer.NOTHING:
            return None
        applied = 0
        for step in steps or ():
            operations = c._parsed(step["p"], {})
            if operations is not c.pointer.NOTHING:
                ok, _, value = kernel_patch.patch(value, operations)
                applied += ok
        return {"doc": c.compact(value), "applied": applied}

    kind = T.StructType([T.StructField("doc", T.StringType()), T.StructField("applied", T.IntegerType())])
    return joined.select(key, c.kernel_udf(folded, kind)(F.col(doc), F.col("_steps")).alias("_out")).select(key, F.col("_out.doc").alias(doc), F.coalesce("_out.applied", F.lit(0)).alias("applied"))


def with_parsed(df: DataFrame, doc: str, out: str = "_variant") -> DataFrame:
    """df with the document as VARIANT, parsed once for all native paths that use it."""
    return df.withColumn(out, F.try_parse_json(doc))


def mean_of_numbers(doc: str, pointer: str = "") -> Column:
    """The mean of the numbers in an array, other items left out; NULL without any."""

    def mean(value):
        numbers = [float(x) for x in value if isinstance(x, c.Decimal)] if isinstance(value, list) else []
        return sum(numbers) / len(numbers) if numbers else c.pointer.NOTHING

    return c._at(doc, pointer, mean, c.DOUBLE)
