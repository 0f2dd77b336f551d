"""op5 against a plain Python version with all pairs and a union-find."""

from __future__ import annotations

import random
import re

import xxhash

from folioflow.llm import graph, simhash
from folioflow.llm.common import WORD


def plain_print(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def plain_components(pairs, linked):
    up = list(range(len(pairs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if linked(pairs[i][1], pairs[j][1]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(pairs))]


def texts_with_copies():
    rng = random.Random(11)
    words = [f"Wört{i}" for i in range(60)] + ["ÀB", "the", "THE"]
    out = [None, "", " \n", "one", "One two", "\x0bone\ttwo\x0c", "a b c", "A B C"]
    for _ in range(40):
        w = rng.choices(words, k=rng.randint(5, 400))
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append("  ".join(w))
    return out + out[10:14]


def test_equals_all_pairs(spark, tmp_path):
    texts = texts_with_copies()
    docs = [(100 - i if i % 2 else i + 1000, t) for i, t in enumerate(texts)] + [(1000, texts[0])]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in simhash.op5_simhash(spark, str(tmp_path)).collect())
    pairs = [(i, plain_print(t)) for i, t in docs]
    comp = plain_components(pairs, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == sorted((i, f"{f:016x}", c) for (i, f), c in zip(pairs, comp))
    kept = simhash.deduplicate(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(comp)) and len(kept[0]) == 3


def test_links_chains_of_prints(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    where = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    mine = [where.get(s, s) for s in signed]
    want = plain_components(list(enumerate(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_long_text_in_blocks(spark, monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    want = plain_print(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint_of(text.encode()) == want


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.deduplicate(empty).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert len({r.root for r in graph.components(path).collect()}) == 1
