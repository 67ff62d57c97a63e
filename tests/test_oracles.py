"""Every catalog query against its SQL form in an independent engine, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from laudospark.plans.catalog import QUERIES
from laudospark.plans.oracle import ORACLES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["exam_type", "exam_month", "reports"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["result_struct", "result_struct_full"])
def test_stored_documents_are_read_once(spark, name):
    """Before, the document was read again for each of nine fields."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(patient_") == 1 and "get_json_object(document" not in plan
