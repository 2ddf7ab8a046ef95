"""Each stage of the pipeline against a brute-force version on its own input, and the whole."""

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from docquarry.llm import decontaminate, quality
from docquarry.llm.common import table, written
from docquarry.llm.sql import ORACLES


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = [table(spark, small, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], small)))
    return docs


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicate removal", "benchmark decontamination", "source mixing", "sharding"]
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns and dict(docs.dtypes) == dict(stages[0].dtypes)
    assert stages[-1].columns == [*stages[0].columns, "shard", "grown_shard"]


def test_quality_stage(spark, small, stages):
    labels = table(spark, small, "labels").where("quality is not null")
    kept = stages[1].select("doc_id").distinct()
    counts = {(r["quality"], r["kept"]): r["count"] for r in labels.join(kept.withColumn("kept", F.lit(True)), "doc_id", "left").groupBy("quality", "kept").count().collect()}
    good, bad = counts.get((1, True), 0), counts.get((0, None), 0)
    assert good / (good + counts.get((1, None), 0)) > 0.95 and bad / (bad + counts.get((0, True), 0)) > 0.7
    assert stages[1].exceptAll(stages[0]).count() == 0


def test_near_duplicate_stage(stages):
    c = duckdb.connect()
    documents = stages[1].toArrow()
    c.register("documents", documents)
    want = {r[0] for r in c.execute(f"select doc_id from ({ORACLES['op8_minhash_near_dedup']}) where kept").fetchall()}
    assert Counter(r["doc_id"] for r in stages[2].select("doc_id").collect()) == Counter(want)
    assert stages[2].exceptAll(stages[1]).count() == 0


def test_decontamination_stage(spark, small, stages):
    before = {r["doc_id"]: r for r in decontaminate.report(stages[2], table(spark, small, "benchmark")).collect()}
    after = {r["doc_id"]: r for r in decontaminate.report(stages[3], table(spark, small, "benchmark")).collect()}
    assert set(after) == {i for i, r in before.items() if not r["contaminated"]}
    assert all(r["n_words"] == before[i]["n_words"] - before[i]["n_hit"] for i, r in after.items())
    clean = [i for i, r in before.items() if not r["n_hit"]]
    texts = dict(stages[2].select("doc_id", "text").collect())
    assert all(texts[i] == t for i, t in stages[3].select("doc_id", "text").collect() if i in set(clean))


def test_mixing_stage(stages):
    rows = [tuple(r) for r in stages[3].select("doc_id", "text", "lang", "source").collect()]
    from test_mixing import brute

    assert sorted(r["doc_id"] for r in stages[4].collect()) == sorted(r[0] for r in brute(rows, (3, 5), 1))


def test_sharding_stage(stages):
    from test_sharding import jump

    assert stages[5].drop("shard", "grown_shard").exceptAll(stages[4]).count() == 0 and stages[5].count() == stages[4].count()
    assert all((r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 40), jump(r["doc_id"], 41)) for r in stages[5].select("doc_id", "shard", "grown_shard").collect())


def test_run(spark, small, stages):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, small).select("doc_id").collect()) == sorted(r["doc_id"] for r in stages[-1].select("doc_id").collect())


def test_stages_take_odd_rows(spark, documents, nothing, small):
    labels = table(spark, small, "labels")
    assert quality.accepted(documents, labels).columns == documents.columns
    for docs in (documents, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, small))
        assert set(documents.columns) <= set(docs.columns)
