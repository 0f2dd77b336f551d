"""op7 against sorting all scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import topk


def plain(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize(("cells", "scores"), [(1 << 19, 1 << 19), (640, 400)])
def test_equals_all_scores(spark, tmp_path, monkeypatch, cells, scores):
    monkeypatch.setattr(topk, "BLOCK_CELLS", cells)
    monkeypatch.setattr(topk, "QUERY_CELLS", cells // 4)
    monkeypatch.setattr(topk, "SCORES", scores)
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(10)]) for i in range(-40, 300)]
    rows += [(400 + i, [0.5] * 10) for i in range(50)] + [(20, rows[60][1]), (21, rows[61][1]), (None, [1.0] * 10)]
    rows += [(500, None), (520, [None] * 10), (540, [float("nan")] * 10), (560, [float("inf")] * 10), (580, [1.0, 2.0]), (600, []), (620, [1e6] * 10)]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in topk.op7_topk(spark, str(tmp_path)).collect()) == plain(stored, 20)


def test_few_or_no_candidates(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(topk.quantise(one), F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(topk.quantise(one.limit(0)), F.col("id") % 20 == 0).count() == 0


def test_scores_beyond_64_bits(spark):
    rng = random.Random(4)
    big = (1 << 63) - 1
    q, c = (np.array([[rng.choice([0, 1, -5, big, -big - 1, 1 << 40, -(1 << 33)]) for _ in range(6)] for _ in range(n)]) for n in (9, 30))
    want = [[max(-big, min(big, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for b in c] for a in q]
    assert topk.accumulate(q, c).tolist() == want
    rows = [(20, [1e300, 0.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    got = topk.top_k(topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("id") == 20).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, big), (3, 0), (2, -big)]
