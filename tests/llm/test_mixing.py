"""op3 against DuckDB's answer to its SQL, and the rules of the mix on awkward tables."""

from __future__ import annotations

import random

import duckdb
import pytest

from folioflow.llm import mixing


def rows_of(kind):
    rng = random.Random(kind)
    sources = ["a", "ä", "B", None, "", "c"]
    weights = [1, 1, 40, 3, 1, 2]
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50])), rng.choices(sources, weights)[0]) for i in range(300)]
    docs += [(5, docs[5][1], docs[5][2])] * 3 + [(None, "x y", "a"), (None, None, None), (7, "\x0b\n", "B")]
    return {1: docs, 2: [(i, "one two", "only") for i in range(9)], 3: [(1, "", "a"), (2, None, "b")], 4: []}[kind]


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_equals_the_sql(spark, tmp_path, kind):
    frame = spark.createDataFrame([(*r, 9, 1.0) for r in rows_of(kind)], "doc_id long, text string, source string, size int, target double")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in mixing.op3_mix_sources(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.sql(mixing.OP3_SQL).fetchall(), key=str)
    total = sum(r[1] for r in got)
    assert sum(r[4] for r in got) <= total and all(r[4] <= 3 * r[1] for r in got)
    largest = max([r[1] for r in got], default=0)
    for target in {r[3] for r in got}:
        taken = sum(r[4] for r in got if r[3] == target)
        n = len({r[2] for r in got if r[3] == target})
        assert abs(taken - n * target) <= 4 * largest * n or kind == 1 and taken > 0


def test_the_mix_is_in_order_of_finish(spark):
    docs = spark.createDataFrame([(i, "s" + str(i % 3), 1 + i % 5) for i in range(200)], "doc_id long, source string, n long")
    mixed = mixing.mix(docs, "n").collect()
    assert [r.mix_finish for r in mixed] == sorted(r.mix_finish for r in mixed)
    assert mixed == mixing.mix(docs, "n").collect()
