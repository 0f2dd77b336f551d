"""op4 by held-out accuracy, and its defined cases."""

from __future__ import annotations

import random
import zlib

import numpy as np

from folioflow.llm import classifier as c


def corpus(n):
    rng = random.Random(12)
    words = ["the", "of", "lorem", "étude", "Haus", "casa", "ipsum", "dolor"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(30, 200))
        bad = i % 4 == 0
        if bad:
            w = [x + rng.choice(["###", "!!"]) for x in w] if i % 8 else [x for x in w[:10] for _ in range(9)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_rows(spark, tmp_path):
    docs, labels = corpus(400)
    extra = [(900, None), (901, ""), (902, "x"), (None, "the of"), (3, docs[3][1]), (903, "word " * 300000)]
    frame = spark.createDataFrame([(*d, "en", "src", 0.5) for d in docs + extra], "doc_id long, text string, lang string, source string, score double")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = c.op4_quality(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(extra)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) and len(held) > 50


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in c.classify(docs, c.fit(docs, none)).collect()] == [0.5, 0.5]
    assert c.classify(docs.limit(0), c.fit(docs.limit(0), none)).count() == 0


def test_the_sample_is_bounded(spark):
    docs, labels = corpus(120)
    model = c.fit(spark.createDataFrame(docs * 3, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 40)
    assert len(model.labels) == 40 and model.vectors.shape[0] == 40


def test_counts_do_not_depend_on_chunks(monkeypatch):
    text = ("Some text, 12 words!! " * 500).encode()
    want = c.counts(text)
    monkeypatch.setattr(c, "CHUNK", 97)
    assert (c.counts(text) == want).all()


def test_votes_equal_a_plain_vote(spark):
    docs, labels = corpus(160)
    frame = spark.createDataFrame(docs + [(900, ""), (901, None)], "doc_id long, text string")
    model = c.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(model.labels) > c.NEIGHBOURS
    got = {r.doc_id: r.score for r in c.classify(frame, model).collect()}
    for i, text in docs[::7]:
        tf = c.counts(text.encode())[None].astype(np.float64)
        x = np.log1p(tf[0]) * model.idf
        x[: c.GRAMS] /= np.sqrt((x[: c.GRAMS] ** 2).sum())
        x[c.GRAMS : -2] /= np.sqrt((x[c.GRAMS : -2] ** 2).sum())
        x[-2:] = tf[0, -2:] / np.sqrt((tf[0, -2:] ** 2).sum())
        v = x @ model.projection.astype(np.float64)
        near = sorted(((float(v @ y / np.sqrt(v @ v)), float(q)) for y, q in zip(model.vectors.astype(np.float64), model.labels, strict=True)), reverse=True)[: c.NEIGHBOURS]
        weights = [max(s, 0) ** c.POWER for s, _ in near]
        assert abs(got[i] - sum(w * q for w, (_, q) in zip(weights, near, strict=True)) / sum(weights)) < 0.02
    assert got[900] == got[901] == model.mean
