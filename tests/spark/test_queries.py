"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from docquarry.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(small):
    c = duckdb.connect()
    for file in os.listdir(small):
        c.execute(f"create view {file.removesuffix('.parquet')} as select * from '{small}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, tables, name):
    got = QUERIES[name](spark, small).toArrow()
    tables.register("arrow_rows", got)
    tables.execute(f"create or replace table want as {ORACLES[name]}")
    tables.execute("create or replace table got as select * from arrow_rows")
    kinds = [sorted((row[0], row[1]) for row in tables.execute(f"describe {t}").fetchall()) for t in ("want", "got")]
    assert kinds[0] == kinds[1]
    columns = ", ".join(f'"{k}"' for k, _ in kinds[0])
    for a, b in (("want", "got"), ("got", "want")):
        assert tables.execute(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall() == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_canonical_numbers_of_all_orders(spark, small):
    """Zeros of an integer stay, those of a fraction go."""
    rows = {r["key"]: r for r in QUERIES["number_canonical"](spark, small).collect()}
    assert set(rows) == {r[0] for r in spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey").collect()}
    assert rows[10]["plain"] == "10" and rows[10]["fraction"] == "0.01" and rows[120]["fraction"] == "0.12" and rows[997]["fraction"] == "0"


def test_tokens_are_those_of_each_text(spark, tmp_path):
    props = [(1, '{"k": 1}'), (2, '{"k" : [10, 20]}'), (3, '{"a": true}')]
    spark.createDataFrame(props, "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: (r["n"], r["colon_col"], r["number"], r["end_col"]) for r in QUERIES["token_rows"](spark, str(tmp_path)).collect()}
    assert got == {1: (5, 4, "1", 7), 2: (9, 5, "20", 15), 3: (5, 4, None, 10)}


@pytest.mark.parametrize("name", [n for n in sorted(ORACLES) if n.startswith(("schema_", "type_", "size_", "equals_", "pointer_missing"))])
def test_no_constant_would_do(small, tables, name):
    """The SQL of queries that judge rows gives more than one answer, so a function that returns a constant fails."""
    if name == "schema_error_rows":
        return
    rows = tables.execute(ORACLES[name]).fetchall()
    assert len({row[1:] for row in rows}) > 1 or len(rows) == 1
