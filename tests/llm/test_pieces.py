"""op8 against the sentencepiece library, and the Viterbi fold against all segmentations."""

from __future__ import annotations

import math
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from folioflow.llm import pieces as p

TEXTS = [
    "Hello  wörld\n漢字 a\xa0b 12345 \t x", "  lead", "", None, "trail   ", "ﬁ Å ①", "a<s>b</s>c<unk><0x41>", "▁x", "aaaaaaa" * 30, " " * 90, "x" * 3000,
    "THE!! quick### brown*** | fox&&& 4111 1111", "é" * 100 + "😀" * 70, "\x00\x1f\r\n", "word " * 200,
]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    letters = "abcdefgh etaoin  ▁é漢.!#\n"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(0, 150))) for _ in range(80)]
    model = sentencepiece.SentencePieceProcessor(model_file=p.MODEL)
    return texts, [model.encode(t) if t else [] for t in texts]


@pytest.mark.parametrize("frequent", [0, 60])
def test_equals_the_library(spark, made, frequent):
    texts, want = made
    v = p.Vocabulary()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, word int")
    encoded = p.encode(docs, v, frequent=frequent) if frequent else docs.withColumn("piece_ids", p.encoder(type("S", (), {"value": {}, "id": -1})(), v)(F.col("text")))
    rows = {r.doc_id: r for r in p.decode(encoded, v).collect()}
    for i, t in enumerate(texts):
        assert rows[i].piece_ids == want[i], repr(t)[:80]
        assert rows[i].decoded == (t or "").replace("▁", " ")


def test_the_lattice_alone_equals_the_library(spark, made):
    texts, want = made
    v = p.Vocabulary()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t and len(t) < 200], "doc_id long, text string")
    words = docs.select("doc_id", F.posexplode(p.words_of(F.col("text"))).alias("pos", "word"))
    ids = p.fold_merges(p.lattice(words.select("word").distinct(), p.piece_table(spark, v), v.longest), v.bytes)
    rows = words.join(ids, "word").groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    for r in rows.collect():
        assert r.ids == want[r.doc_id], texts[r.doc_id]


def test_viterbi_equals_all_segmentations(spark):
    rng = random.Random(8)
    table = {c: -rng.uniform(3, 6) for c in "abc"} | {"".join(rng.choices("abc", k=k)): -rng.uniform(1, 9) for k in (2, 2, 3, 3, 4, 4)}
    ids = {w: 300 + i for i, w in enumerate(table)}
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 8))) for _ in range(40)]

    def best(w):
        if not w:
            return 0.0, []
        ways = [(best(w[k:]), k) for k in range(1, len(w) + 1) if w[:k] in table or k == 1]
        return max(((s + table.get(w[:k], -50.0), ([ids[w[:k]]] if w[:k] in table else [ord(w[0])]) + rest) for (s, rest), k in ways), key=lambda x: x[0])

    pieces = spark.createDataFrame([(w, ids[w], s) for w, s in table.items()], "piece string, id int, score double")
    got = p.fold_viterbi(p.lattice(spark.createDataFrame([(w,) for w in set(words)], "word string"), pieces, 4), list(range(256)), -50.0)
    score = {i: s for s, i in ((table[w], ids[w]) for w in table)}
    for r in got.collect():
        assert math.isclose(sum(score.get(i, -50.0) for i in r.ids), best(r.word)[0]), r.word


def test_empty_table(spark):
    v = p.Vocabulary()
    assert p.decode(p.encode(spark.createDataFrame([], "doc_id long, text string"), v), v).count() == 0


def test_the_query(spark, made, tmp_path):
    texts, want = made
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] * 2, "doc_id long, text string, piece_ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = p.op8_pieces(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(texts) and all(r.round_trip and r.n_pieces == len(want[r.doc_id]) and r.n_chars == len(texts[r.doc_id] or "") for r in rows)
    hashed = spark.createDataFrame([(i, w) for i, w in enumerate(want)], "i long, w array<int>").select("i", F.lower(F.hex(F.xxhash64("w"))).alias("h"))
    assert {r.doc_id: r.pieces_xxh64 for r in rows} == {r.i: r.h for r in hashed.collect()}
