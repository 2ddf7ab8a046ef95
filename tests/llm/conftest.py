import pytest
from corpus_fixtures import DOCUMENTS, corpus


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(documents):
    """Documents with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["row", "rep", "value", "score", "shard", "slot", "epoch", "n_tokens", "bucket", "place", "words", "spans", "items", "n_words", "print", "sketch", "component", "budget", "domain", "kept", "copies", "size", "rank"]
    return documents.withColumns({n: F.lit(1) for n in names})
