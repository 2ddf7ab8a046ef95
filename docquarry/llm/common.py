"""What the corpus operators share: the shared scratch folder, Arrow text access, and table reading."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docquarry-")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session may go without that setting: there all run on one machine.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_scratch()
    return f"{base.rstrip('/')}/docquarry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes what written() made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        assert "/docquarry/" in folder.toString()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: A key with more rows than this may be joined by broadcast, and so many of the most frequent keys at most.
HOT_ROWS, HOT_KEYS = 65_536, 10_000


def spread_join(rows: DataFrame, one: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with `one` on key, where `one` has at most one row for each key; the rows of no key meet in one task.

    Of keys with more than HOT_ROWS rows, the HOT_KEYS most frequent ones are joined by broadcast, which is as large as that
    and no larger; any other key has less than 1/HOT_KEYS of all rows, or few. how: left or inner. rows is read three times.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_rows")).where((F.col("_rows") > HOT_ROWS) & F.col(key).isNotNull()).orderBy(F.desc("_rows"), key).limit(HOT_KEYS).select(key).collect()
    if not hot:
        return rows.join(one, key, how)
    keys = rows.sparkSession.createDataFrame(hot, rows.select(key).schema).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(keys), key, "left")
    some, others = marked.where("_hot").drop("_hot"), marked.where("_hot is null").drop("_hot")
    return some.join(F.broadcast(one.join(F.broadcast(keys.drop("_hot")), key, "left_semi")), key, how).unionByName(others.join(one, key, how))


#: Copies of a row that are dealt out together.
COPIES = 4096


def numbered_copies(rows: DataFrame, copies: str, out: str) -> DataFrame:
    """rows, each as often as `copies` says, numbered from 0 in `out`. Rows with many copies are dealt out to many tasks."""
    few, many = rows.where(F.col(copies) <= COPIES), rows.where(F.col(copies) > COPIES)
    few = few.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    many = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_from")
    many = many.withColumn(out, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, copies) - 1))).drop("_from")
    return few.where(F.col(copies) > 0).unionByName(many)


def slices(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of an Arrow string column; a null has no bytes."""
    n = len(column)
    nulls = np.asarray(column.is_null())
    _, offsets, data = column.buffers()
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    offsets = np.frombuffer(offsets, wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], nulls


def texts(column) -> list[bytes | None]:
    """The UTF-8 bytes of each value."""
    data, offsets, nulls = slices(column)
    raw = data.tobytes()
    return [None if null else raw[a:b] for a, b, null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), nulls.tolist(), strict=True)]


def pieces(batch, most_bytes: int = 2 << 20):
    """Parts of an Arrow batch of about most_bytes of text each, so that work arrays stay small; a row is never cut."""
    import pyarrow as pa

    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            _, offsets, _ = slices(column)
            size += np.diff(offsets)
    start, ends = 0, np.cumsum(size + 64)
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end


#: Bytes of an Arrow batch, about: what a task holds of its input at once, beside a single row however long.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(rows: DataFrame, function, kind) -> DataFrame:
    """rows.mapInArrow in a session whose Arrow batches have about BATCH_BYTES at most: a smaller setting stays as it is."""
    conf = rows.sparkSession.conf
    if int(rows.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows.mapInArrow(function, kind)


#: Characters that training holds of a sampled text at most, and the stretches they come from where the text has more.
HELD_CHARS, STRETCHES = 1 << 16, 16


def held(text: Column, seed: int) -> Column:
    """A text as training holds it: whole, or of more than HELD_CHARS characters so many, as STRETCHES stretches of one length
    from end to end of the text, each at a hashed place of its own part. So a sample of rows is bounded in bytes too."""
    each, length, turn = HELD_CHARS // STRETCHES, F.length(text).cast("long"), F.xxhash64(text, F.lit(seed))
    stretches = []
    for i in range(STRETCHES):
        first, end = F.floor(length * i / STRETCHES), F.floor(length * (i + 1) / STRETCHES)
        at = first + F.pmod(F.xxhash64(turn, F.lit(i)), F.greatest(end - first - each + 1, F.lit(1)))
        stretches.append(F.substring(text, (at + 1).cast("int"), F.lit(each)))
    return F.when(length > HELD_CHARS, F.concat(*stretches)).otherwise(text)


def fitted(rows: DataFrame, fit):
    """What fit(list of row dicts) returns, made in one task over a bounded sample of rows: its arrays stay off the driver until done."""
    import pickle

    def run(batches):
        import pyarrow as pa

        made = fit([row for batch in batches for row in batch.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    # Spark may run no task at all over no rows
    made = rows.repartition(1).mapInArrow(run, "made binary").first()
    return fit([]) if made is None else pickle.loads(made["made"])


def sampled(rows: DataFrame, key: str, size: int, seed: int, count: int | None = None) -> DataFrame:
    """At most `size` of rows, the first by a hash of key (column `turn`): all of them, if there are no more.

    Rows whose hash is far from the first ones are left out before they are put in order, so that what a task or the
    last step gets does not grow with the input. count: how many rows there are at most, if that is known more cheaply.
    """
    rows = rows.withColumn("turn", F.xxhash64(key, F.lit(seed)))
    count = rows.count() if count is None else count
    # so many are expected below the bound that fewer than wanted are out of the question
    enough = 2 * size + 40
    if count > enough:
        rows = rows.where(F.col("turn") < F.lit(-(1 << 63) + (1 << 64) * enough // count))
    return rows.orderBy("turn", *rows.drop("turn").columns).limit(size)
