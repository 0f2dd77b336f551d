"""The pipeline's stages, each on its own input, against plain versions, and the whole run."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from folioflow.llm import classifier, pieces
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_simhash import plain_components, plain_print


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["the", "of", "étude", "Haus", "casa", "dolor", "sit", "amet", "elit", "nunc", "ante"]
    docs, labels = [], []
    for i in range(160):
        kind = rng.random()
        lines = ["".join(rng.choice([w, w + ","]) + " " for w in rng.choices(words, k=rng.randint(8, 40))) for _ in range(rng.randint(1, 5))]
        if kind < 0.2:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        elif kind < 0.3 and docs:
            lines = rng.choice(docs)[1].split("\n")
        docs.append((i, "\n".join(lines), "en", rng.choice(["a", "b", None]), 0))
        labels.append((i, int(kind >= 0.2), 0))
    docs += [(200, None, None, "a", None), (201, "", "en", "b", 0), (None, "the of étude Haus\ncasa", "en", "a", 22)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def stages(spark, sf_dir, n, folder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:n]):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{n}-{k}")
        docs = spark.read.parquet(f"{folder}/{n}-{k}")
    return docs


def test_each_stage_on_its_own_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = sorted(map(str, (tuple(r)[:5] for r in classifier.classify(docs, model).collect() if r.score >= classifier.THRESHOLD)))
    one = stages(spark, sf_dir, 1, tmp_path)
    assert one.columns == columns and sorted(str(tuple(r)) for r in one.collect()) == want and 100 < len(want) < 163

    rows = [(r.doc_id, r.text) for r in one.collect()]
    left = {k: v for k, v in plain_lines(rows).items() if v == dict(rows)[k] or v.split()}
    two = pipeline.line_dedup(spark, one, sf_dir)
    assert two.columns == columns and {r.doc_id: r.text for r in two.collect()} == left
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in two.collect())

    two.write.parquet(f"{tmp_path}/two")
    two = spark.read.parquet(f"{tmp_path}/two")
    keyed = [(10**9 if r.doc_id is None else r.doc_id, plain_print(r.text)) for r in two.collect()]
    least = set(plain_components(keyed, lambda a, b: (a ^ b).bit_count() <= 2))
    three = pipeline.near_dedup(spark, two, sf_dir)
    assert three.columns == columns and {10**9 if r.doc_id is None else r.doc_id for r in three.collect()} == least

    three.write.parquet(f"{tmp_path}/three")
    three = spark.read.parquet(f"{tmp_path}/three")
    four = pipeline.mix(spark, three, sf_dir)
    assert four.columns == columns
    times = Counter(r.doc_id for r in four.collect())
    size = {r.doc_id: len((r.text or "").split()) for r in three.collect()}
    assert max(times.values()) <= 3 and sum(size[i] * n for i, n in times.items()) <= sum(size.values())

    five = pipeline.encode(spark, four, sf_dir).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in three.collect()}
    assert len(five) == four.count() and all(r.piece_ids == (library.encode(texts[r.doc_id]) if texts[r.doc_id] else []) and r.round_trip for r in five)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_finds_copies_with_changed_words(spark, tmp_path):
    rng = random.Random(5)
    docs = []
    for _ in range(30):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 4)):
            docs.append((len(docs), rng.choice([" ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = "changed"
    docs += [(None, docs[0][1]), (500, None), (501, ""), (502, " \n")]
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/d")
    keyed = [(10**9 if i is None else i, (plain_print(t), shingles(t))) for i, t in docs]
    close = lambda a, b: (a[0] ^ b[0]).bit_count() <= 2
    alike = lambda a, b: close(a, b) or 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1]) > 0
    want = set(plain_components(keyed, alike))
    got = [10**9 if r.doc_id is None else r.doc_id for r in pipeline.near_dedup(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()]
    assert sorted(got) == sorted(want) and len(want) < len(set(plain_components(keyed, close))) - 5


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    whole = pipeline.run(spark, sf_dir)
    assert whole.agg(F.sum("n_pieces")).first()[0] > 1000
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
