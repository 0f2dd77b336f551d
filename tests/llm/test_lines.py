"""op9 against all pairs of lines in plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm import lines
from folioflow.llm.common import WORD


def plain(docs):
    rows = []
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            w = re.findall(WORD, line)
            if w:
                rows.append(((i is None, i or 0, p), frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), i, p))
    rows.sort(key=lambda r: r[0])
    gone = set()
    for k, (_, a, i, p) in enumerate(rows):
        if any(9 * len(a & b) >= 4 * (len(a) + len(b)) for _, b, j, o in rows[:k] if (i, p) != (j, o)):
            gone.add((i, p))
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def test_equals_all_pairs(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"wé{k}" for k in range(30)]
    base = [rng.choices(vocabulary, k=rng.randint(1, 60)) for _ in range(25)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text.append(rng.choice([" ", "  ", "\t"]).join(w))
            if rng.random() < 0.2:
                text.append(rng.choice(["", " ", "All rights reserved."]))
        docs.append((i * 3 - 50, "\n".join(text)))
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (None, "\n".join(" ".join(b) for b in base[:4])), (1003, "x " * 4000)]
    frame = spark.createDataFrame([(i, t, "e", 5) for i, t in docs], "doc_id long, text string, n_lines string, hash int")
    out = lines.dedup_lines(frame).collect()
    want = plain(docs)
    assert {r.doc_id: r.text for r in out} == want and len(out) == len(docs)
    assert all(r.hash == 5 for r in out)
    assert sum(r.n_removed for r in out) > 50


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f\nq"), (1, "a b c d e f\nq"), (2, "q\nz z")]
    out = sorted(tuple(r) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, "a b c d e f\nq", 2, 0), (1, "a b c d e f\nq", 2, 0), (2, "z z", 2, 1)]
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_common_line_speaks_once(spark, monkeypatch):
    monkeypatch.setattr(lines, "COMMON", 4)
    rows = [(i, f"one two three four five six\nown line number {i} of this text") for i in range(40)] + [(99, "one two three four five six seven")]
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == plain(rows)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generators_make_their_arrays_once(spark, monkeypatch):
    monkeypatch.setattr(lines, "cut", lambda df: df)
    docs = spark.createDataFrame([(1, 5, "a b\nc")], "doc_id long, hash long, text string")
    made = plan(lines._postings(docs, lines._repeated(docs), lines.rarity(docs)))
    assert made.count("array_distinct(") == 1  # a filter on the prefix's size made the tokens again


def test_long_and_repetitive_lines_equal_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choices(vocabulary, k=n) for n in (5, 6, 9, 14, 30, 90, 200, 400)] + [rng.choices(vocabulary[:3], k=120), vocabulary[:4] * 40]
    docs = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(w) // 25)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1, 2])] = rng.choices(vocabulary, k=rng.choice([0, 1, 1, 3]))
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w = w[at:] + w[:at]
        docs.append((i, " ".join(w)))
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == plain(docs)
    assert 20 < sum(t == "" for t in out.values()) < 110


def test_words_are_found_without_a_pattern_and_sets_without_rarity(spark):
    text = "a b\tc\x0bd\x0ce\rf  g a b\tc d e \nq"
    one = spark.createDataFrame([(text,), ("x y x y x y x y",), ("z",)], "line string").withColumn("words", lines.words(F.col("line")))
    sets = one.withColumn("tokens", F.size(lines.plain_tokens(F.col("line"))))
    rows = sets.collect()
    assert [r.words for r in rows] == [re.findall(WORD, r.line) for r in rows]
    assert [r.tokens for r in rows] == [len({tuple(r.words[k : k + 5]) for k in range(max(1, len(r.words) - 4))}) for r in rows]
    made = plan(sets)
    assert "RLIKE" not in made and "least(" not in made


@pytest.mark.parametrize("size", [5, 6, 7, 8, 12, 40])
def test_the_first_token_has_the_rarest_word(spark, size):
    common = [f"c{k}" for k in range(size)]
    texts = [" ".join(common)] * 50
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    classes = lines.rarity(docs)
    with_rare = [" ".join([*common[:p], f"rare{p}", *common[p + 1 :]]) for p in range(size)]
    first = lambda line: F.get(lines.tokens(line, classes), 0)
    made = spark.createDataFrame([(t,) for t in with_rare + texts[:1]], "line string").select(F.shiftright(first(F.col("line")), 56).alias("c")).collect()
    assert all(r.c < made[-1].c for r in made[:-1])
