"""The registered corpus queries against their DuckDB SQL on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as E
from feedloom.llm.oracle import SQL
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, res.fetchall())


@pytest.mark.parametrize("name", ["op3_license_scan", "op7_quality_rules"])
def test_native_plans_hold_no_python(spark, name):
    text = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))
