"""op2 against containment over all windows in plain Python."""

from __future__ import annotations

import random
import time

from folioflow.llm import licenses as lic


def plain(text):
    w, found = lic._words(text or ""), set()
    for name, t in lic.TEMPLATES.items():
        tw = lic._words(t)
        shingles, n = set(zip(tw, tw[1:])), len(tw)
        step = max(1, n // 8)
        for b in range(0, max(1, len(w)), step):
            part = w[max(b - step, 0) : b + n + step]
            if len(shingles & set(zip(part, part[1:]))) >= lic.CONTAINED * len(shingles):
                found.add(name)
    return sorted(found)


def test_equals_all_windows(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "license", "All rights", "Überall rights reserved é"]
    for t in lic.TEMPLATES.values():
        for edits in (0, 0, 1, 3):
            w = t.split()
            for _ in range(min(edits, len(w) // 6)):
                w[rng.randrange(len(w))] = "changed"
            filler = rng.choices(["the", "license", "of", "software", "word", "reserved"], k=rng.randint(0, 40))
            texts.append(" ".join(filler + [x.upper() if rng.random() < 0.3 else x for x in w] + filler[::-1]))
    docs = [(i, t, 1) for i, t in enumerate(texts)] + [(0, None, 1), (7, texts[7], 1)]
    spark.createDataFrame(docs, "doc_id long, text string, licenses int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_licenses, r.licenses) for r in lic.op2_licenses(spark, str(tmp_path)).collect())
    assert got == sorted((i, len(plain(t)), ",".join(plain(t))) for i, t, _ in docs)


def test_anchors_cannot_be_missed():
    for t in lic.TEMPLATES.values():
        w = lic._words(t)
        pairs, chosen = set(zip(w, w[1:])), lic.anchors(w)
        assert sum(not chosen & set(p) for p in pairs) < lic.CONTAINED * len(pairs)


def test_empty_table(spark):
    assert lic.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_over_several_segments(spark):
    rng = random.Random(5)
    filler = lambda n: rng.choices(["the", "license", "of", "software", "word", "reserved"], k=n)
    rows = []
    for k, t in enumerate(lic.TEMPLATES.values()):
        before = (lic.SEGMENT - 4, lic.SEGMENT + rng.randint(0, 9), 2 * lic.SEGMENT - 30 + k)[k % 3]
        rows.append((len(rows), " ".join([*filler(before), *t.split(), *filler(100)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [x.name for x in r.licenses] for r in lic.find_licenses(docs).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_long_texts_take_linear_time(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "licensed software reserved word " * n)], "doc_id long, text string")
        begin = time.perf_counter()
        assert lic.find_licenses(docs).collect()[0].licenses == []
        return time.perf_counter() - begin

    seconds(50)
    assert seconds(1200) < 6 * seconds(300) + 4


def test_columns_of_any_name_and_type_are_carried(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 5, {"a": 1}, 2), (2, None, 6, None, 3)], "doc_id long, text string, licenses int, name map<string,int>, start int")
    got = {r.doc_id: ([x.name for x in r.licenses], r.name, r.start) for r in lic.find_licenses(docs).collect()}
    assert got == {1: (["mit-notice"], {"a": 1}, 2), 2: ([], None, 3)}
