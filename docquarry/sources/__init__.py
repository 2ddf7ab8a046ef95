"""Documents in and out of files: whole files, and a document on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def read_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, raw, doc and error of each file: doc is its compact text, or NULL with an error. Files that aren't UTF-8 are errors too."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), "content")

    def read(content):
        try:
            return {"doc": c.compact(c.parse(content, **options)), "error": None}
        except c.ParseError as e:
            return {"doc": None, "error": {"code": e.code, "row": e.row, "col": e.col, "message": e.message}}

    kind = c.T.StructType([c.T.StructField("doc", c.STRING), c.T.StructField("error", c.ERROR)])
    return files.withColumn("_read", c.kernel_udf(read, kind)(F.col("content"))).select("path", F.col("content").cast("string").alias("raw"), "_read.doc", "_read.error")


def parsed_lines(lines: DataFrame, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """line, doc and error of each line (column value). DROPMALFORMED leaves malformed lines out; FAILFAST fails on the first."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    out = lines.select(F.col("value").alias("line"), c.json_read("value", once=True, **options).alias("_read")).select("line", "_read.doc", "_read.error")
    if mode == "DROPMALFORMED":
        return out.where("error is null")
    if mode == "FAILFAST":
        failed = F.raise_error(F.concat(F.lit("malformed document: "), F.col("error.message"))).cast("string")
        return out.withColumn("doc", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("doc")))
    return out


def read_document_lines(spark: SparkSession, path: str, mode: str = "PERMISSIVE", **options) -> DataFrame:
    return parsed_lines(spark.read.text(path), mode, **options)


def write_documents(df: DataFrame, doc: str, path: str, **style) -> None:
    """A text file of documents, one on each line unless the style is pretty."""
    df.select(c.json_print(doc, **({"pretty": False, "once": True} | style)).alias("value")).where("value is not null").write.text(path)
