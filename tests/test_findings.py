"""Queries against their SQL over small tables made for what reviewers found."""

import datetime

import duckdb
import pandas as pd
import pytest
from eventloom.plans import catalogue


def whole(frame):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives the rows of its SQL over tables of rows (name=(schema, rows))."""

    def run(query, **tables):
        con = duckdb.connect()
        for name, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        got, want = catalogue.QUERIES[query](spark, str(tmp_path)).toPandas(), con.sql(catalogue.ORACLE[query]).df()
        assert len(want) and whole(got) == whole(want)

    return run


def test_pages_of_one_address(same):
    """Each page finds its own file, also where others have its address, it has none, or its file is empty."""
    rows = [(k, u, "" if k % 2 else None) for k, u in enumerate(["http://a.example/x", "http://a.example/x", "http://a.example/x", None, None, "http://b.example/", None, "http://a.example/x"])]
    same("page_lookup", pages=("page_id bigint, url string, html string", rows))


def test_index_above_its_range(same):
    """A value above 500 is out of range, also where its whole part isn't."""
    rows = [(k, 7, v) for k, v in enumerate([0.0, 499.99, 500.0, 500.01, 500.99, 501.0, 560.2, None, 0.5, 500.5, 500.0])]
    same("weather_documents", events=("event_id bigint, user_id bigint, value double", rows))


ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def orders(*keyed):
    """Orders of (key, day)."""
    return ORDERS, [(k, k % 5, "O", 1.0, datetime.datetime.fromisoformat(day), "5-LOW") for k, day in keyed]


#: Of each kind of page, events of days that a page once named for the day it is wrong about, and of other days.
DAYS = [(k, day) for at, day in enumerate(["2000-01-01", "1999-12-31", "2000-02-29", "1998-03-04"]) for k in range(14 * at, 14 * at + 14)]


def test_wrong_days_of_chains(same):
    """A page of another day than its event's is another's, whatever the event's day is."""
    same("enrich_chains", orders=orders(*DAYS))


def test_wrong_days_of_counted_chains(same):
    same("enrich_counts", orders=orders(*DAYS))


def test_wrong_days_of_collected_events(same):
    same("collect_events", orders=orders(*DAYS))


def above_join(spark, query, path):
    """What a query's plan does with pairs, after its last join."""
    plan = catalogue.QUERIES[query](spark, path)._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Join ")]


def test_names_are_taken_apart_before_they_are_paired(spark):
    """Not for each pair: neither in the plan nor by generated code, which puts off what may be put off."""
    sf = "/root/testdata/sf0.001"
    assert "regexp" not in above_join(spark, "identity_names", sf)
    plan = catalogue.QUERIES["identity_names"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("monotonically_increasing_id") >= 2


def test_bigrams_beyond_the_masked_ones(spark, same):
    """More bigrams than bits, short and equal names; pairs compare numbers, not lists of texts."""
    names = [("".join(chr(0xAC00 + 97 * k + i * i) for i in range(40)), "x" * (k % 3)) for k in range(20)] + [("ab", ""), ("a", "b"), ("aab", "b")]
    same("bigram_similarity", part=("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", [(k, n, "B", t, 1) for k, (n, t) in enumerate(names + names[:9])]))
    assert "bit_count" in above_join(spark, "bigram_similarity", "/root/testdata/sf0.001")


def test_logos_are_chosen_where_pages_lie(spark):
    """No shuffle, and no table of all pages that the driver holds."""
    plan = catalogue.QUERIES["logo_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_pages_become_arrow_step_by_step(monkeypatch):
    """Parsed pages aren't held as Python objects for a whole batch, and are the same in all steps."""
    import pyarrow as pa
    from eventloom.functions import html, markup, steps

    held, most = [], []

    def make(source):
        held.append(source)
        return markup.page_of(source)

    arrow = pa.array
    monkeypatch.setattr(steps.pa, "array", lambda x, kind: (most.append(len(held)), held.clear(), arrow(x, kind))[-1])
    sources = [None if k % 7 == 0 else f"<p id='{k}'>{'x' * k} <a href='/{k}'>é</a>" for k in range(3000)]
    got = steps.in_steps(arrow(sources), make, markup.PAGE)
    assert got.to_pylist() == [markup.page_of(x) for x in sources] and sum(most) == 3000 and max(most) < 3000 and len(most) > 3
    assert steps.in_steps(arrow([], pa.string()), html.facts_of, html.FACTS_TYPE).to_pylist() == []
