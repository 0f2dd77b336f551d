"""Every document query gives the rows of its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from folioflow.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages conversations benchmark labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(queries.SQL[name])
    assert columns == sorted(want.columns)
    assert norm(map(tuple, got.select(*columns).collect())) == norm(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() == 200


def test_the_decorations_reach_every_rule(spark):
    reasons = {r.reason for r in queries.QUERIES["noise_filter"](spark, DATA).select("reason").distinct().collect()}
    assert reasons == {None, "short", "digits", "number_row", "imprint", "social", "page_number", "running_head"}
    flags = {r.reason for r in queries.QUERIES["hallucination_flags"](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert flags == {None, "marker", "section", "length"}
    assert queries.QUERIES["annotate_terms"](spark, DATA).filter("n_changes > 0").count() == 40
