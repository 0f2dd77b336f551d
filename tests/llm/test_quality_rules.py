"""op10 against a plain Python version, the hashes included."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import xxhash

from folioflow.llm import quality_rules as q


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def bucket(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return signed(seed) % q.BUCKETS


def grams(text):
    w = re.findall(q.WORD, text or "")
    return [bucket(x) for x in w], [bucket(*p) + q.BUCKETS for p in zip(w, w[1:])]


def plain(docs, labels):
    seen = {}
    for i, quality, toxic in labels:
        if i is not None:
            a, b = seen.get(i, (9, 0))
            seen[i] = (min(a, 9 if quality is None else quality), max(b, toxic or 0))
    trusted = {i for i, (a, b) in seen.items() if a == 1 and b == 0}
    raw, target = Counter(), Counter()
    for i, t in docs:
        one, two = grams(t)
        raw.update(one + two)
        if i in trusted:
            target.update(one + two)
    llr = {}
    for high in (False, True):
        part = [k for k in raw if (k >= q.BUCKETS) == high]
        r, t = sum(raw[k] for k in part), sum(target[k] for k in part)
        llr |= {k: math.log((target[k] + q.PRIOR) / (t * (raw[k] / r) + q.PRIOR)) for k in part}
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall(q.WORD, t)
        lines = [x for x in t.split("\n") if re.search(q.WORD, x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(8)}
        one, two = grams(t)
        score = sum(round(v, 6) for v in (llr[k] for k in one + two)) / len(one + two) if one else 0.0
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, score))
    return sorted(out, key=str)


def test_equals_a_plain_version(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(40)] + ["the", "of", "###", "a|b", "<x>"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(80)]
    texts += [None, "", " \n\t", "one", "\n".join(["a line"] * 4 + ["  "] * 3), "x y " * 300, " ".join(texts[:3]) * 2, "\x0bq\x0c" * 30, "a b c d e f g h"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5])]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(60)] + [(1, 0, None), (None, 1, 0), (2, 1, 0), (5, None, 0)]
    d = spark.createDataFrame([(*r, "clash", 1.5) for r in docs], "doc_id long, text string, n_words string, llr double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = q.judge(d, q.cut(q.ratios(d, lab))).collect()
    got = sorted([tuple(r)[:8] for r in rows], key=str)
    want = plain(docs, labels)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(abs(a[7] - b[7]) < 2e-6 for a, b in zip(got, want))
    assert {r.kept for r in rows if r.base_failed} == {False}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.judge(d, q.ratios(d, lab)).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert q.judge(one, q.ratios(one, lab)).first().llr == 0.0
