"""op1 against a plain Python version on awkward and random texts."""

from __future__ import annotations

import hashlib
import random
import re
import time

from folioflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 10 <= len(d) <= 15


def base(text):
    spans = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def test_base_spans_equal_a_plain_version(spark, tmp_path):
    rng = random.Random(5)
    texts = [
        None, "", "1.2.3.4@x.com 1.2.3.4", "a@b.c_d@e.f", "é漢😀 me.x@mail.example.com, 😀", "255.255.255.256 0.0.0.0 01.002.0255.3 1.2.3.4.5",
        "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111", "+1 (743) 555-3824 +44 20 7946 0958 +1", "a@b..c @x.y x@y", "9" * 3000, "a" * 30000,
        "x@" + "a." * 4000 + "b", "1 " * 5000, "+1" + " " * 4000, " ".join(f"u{i}@h.io" for i in range(500)),
    ]
    alphabet = "01 2.@a+-()bé9😀4"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op1_pii(spark, str(tmp_path)).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:80]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in PATTERNS]


def test_checksums_and_context_decide_the_added_kinds(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 x", "GB83 WEST 1234 5698 7654 32", "my ssn is 123-45-6789", "code 123-45-6789", 'token = "' + "0af1" * 10 + '"', "0af1" * 10, "call 555-123-4567"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    found = {r.doc_id: [s["kind"] for s in r.pii] for r in pii.find_pii(docs).collect()}
    assert found == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["secret"], 5: [], 6: ["local_phone"]}
    assert pii.redact(pii.find_pii(docs)).filter("doc_id = 2").first().text == "my ssn is [SSN]"


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_account_number_ends_where_its_country_says(spark):
    numbers = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO9386011117947"]
    texts = [f"IBAN {n}{after}" for n in numbers for after in ("", " BIC COBADEFFXXX", " 2024", ", BIC")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.text for s in r.pii if s.kind == "iban"] for r in pii.find_pii(docs).collect()}
    assert got == {i: [numbers[i // 4]] for i in range(len(texts))}


def test_a_text_of_many_matches_takes_linear_time(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "a.b@cd.ef, " * n)], "doc_id long, text string")
    began = time.perf_counter()
    row = pii.find_pii(docs).selectExpr("size(pii)", f"pii[{n - 1}].start", "pii[0].score").first()
    assert (row[0], row[1]) == (n, 11 * (n - 1)) and time.perf_counter() - began < 60
