"""Every registered query of the engine against its SQL, at the smallest size."""

import duckdb
import pandas as pd
import pytest
from eventloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame, columns):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE:
        assert len(got)
        return
    want = sql.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_plans_stay_native(spark):
    """Relational queries run no Python."""
    for name in ("filter_exact_and", "group_by_month", "registration_status", "greedy_clusters", "host_run_budget", "normalize_name", "bigram_similarity"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_traversal_of_more_chains(spark, sql):
    """One run, however many chains there are: without a budget, and with one."""
    larger = SF.replace("sf0.001", "sf0.01")
    for name in ("traverse_chains", "traverse_run"):
        got = catalogue.QUERIES[name](spark, larger).toPandas()
        want = duckdb.sql(catalogue.ORACLE[name].replace("FROM orders", f"FROM '{larger}/orders.parquet'")).df()
        assert want["chains"][0] == 15000
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
