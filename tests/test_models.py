"""Operators against plain Python models on random input, and the rules that were decided on purpose."""

from __future__ import annotations

import functools
import http.server
import json
import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import ANNOTATIONS, CONTEXT_LABEL, ENGLISH_FORMS, MARKERS
from folioflow.functions.pytext import count_words, places, split_lines, strip
from folioflow.operators import blocks, chunks, cleanup, code, guards, images, metrics, terms
from folioflow.plans import backends, jobs, queries, translate
from folioflow.sources import state
from folioflow.streaming import chunk_stream


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


ODD = ["", " ", "a", "a\n", "\n\na\r\nb\x85c\u2028d\x1ce\x0bf\n", "\xa0x\u3000y\x1f", "\t a  b \x0c", "é\u2003è", "\r\r\n\n"]


def test_text_functions_equal_python(spark):
    rng = random.Random(1)
    values = ODD + ["".join(rng.choices("ab \n\r\x85\xa0\x1c\u2028\t.", k=rng.randint(0, 20))) for _ in range(300)]
    assert column(spark, values, strip) == [v.strip() for v in values]
    assert column(spark, values, count_words) == [len(v.split()) for v in values]
    assert column(spark, values, split_lines) == [v.splitlines() for v in values]


def test_chunks_equal_a_loop(spark):
    rng = random.Random(2)
    books = [[(rng.choice(blocks.KINDS), rng.randint(0, 30)) for _ in range(rng.randint(0, 40))] for _ in range(80)]
    books += [[("image", 0)] * 3, [("heading1", 99)], [("heading2", 99), ("image", 0), ("paragraph", 1)], [("paragraph", 500)]]

    def loop(book):
        out, chunk, held, words = [], 0, 0, 0
        for kind, n in book:
            if kind == "heading1" and held:
                chunk, held, words = chunk + 1, 0, 0
            out.append(chunk)
            held, words = held + 1, words + n
            if words >= 50 and kind not in ("heading1", "heading2", "image"):
                chunk, held, words = chunk + 1, 0, 0
        return out

    got = column(spark, [[{"kind": k, "words": w} for k, w in b] for b in books], lambda x: chunks.chunk_ids(x, 50), "array<struct<kind:string,words:int>>")
    assert got == [loop(b) for b in books]


def clean(text):
    text = re.sub(r"[一-鿿぀-ゟ゠-ヿ]+[^\n]*", "", text)
    text = re.sub(r"\[Продовження[^\]]*\][^\n]*", "", re.sub(r"\(Продовження тексту[^)]*\)[^\n]*", "", text))
    text = re.sub(r"([а-яіїєґА-ЯІЇЄҐA-Za-z0-9.,!?:;)\"'])\s*```", r"\1", text)
    rows = text.splitlines()
    at = lambda i: rows[i].strip() if 0 <= i < len(rows) else ""
    rows = [x for i, x in enumerate(rows) if x.strip() != "```" or re.search(r"[{};=>()]", at(i - 1) + at(i + 1))]
    if sum(x.strip().startswith("```") and len(x.strip()) <= 20 for x in rows) % 2:
        rows.append("```")
    spam = [i for i, x in enumerate(rows) if len(re.findall(r"#\w+", x)) >= 3]
    text, out, seen = "\n".join(rows[: spam[0]] if spam else rows), [], {}
    for s in re.split(r"(?<=[.!?])\s+", text):
        seen[s.strip()[:60]] = seen.get(s.strip()[:60], 0) + 1
        if seen[s.strip()[:60]] == 3:
            break
        out.append(s)
    keep = [x for x in " ".join(out).splitlines() if not x.strip() or re.search(r"[а-яіїєґА-ЯІЇЄҐA-Za-z0-9\s\-#*`_.,!?:()\[\]\"]", x)]
    return "\n".join(keep).strip()


def test_cleanup_equals_a_loop(spark):
    rng = random.Random(3)
    bits = ["Rep. ", "word ", "漢字 x", "\n", "\n", "```", "\n```\n", "x = {1};", "#a #b", " #в", "★", "—", "(Продовження тексту x) y", "[Продовження", "] z", "слово! ", "é\xa0", "\r\n", "\u2028", '"', "Rep. "]
    values = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)] + ODD + ["Довге речення. " * 4 + "Кінець."]
    assert column(spark, values, cleanup.strip_noise) == [clean(v) for v in values]


def test_code_goes_out_and_comes_back(spark):
    rng = random.Random(4)
    bits = ["text ", "```py\n", "```\n", "```", "x\\d $1 \\n\n", "«CODE", "\n", "é"]
    values = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(300)] + ["a ```\n%d\n``` " * 12]
    back, out = column(spark, values, lambda t: code.put_back(code.take_out(t), code.code_blocks(t))), column(spark, values, code.take_out)
    wrapped = [bool(re.search("[`\"']«CODE_BLOCK_|»[`\"']", o)) for o in out]  # such signs are taken for a model's wrapping
    assert [b for b, w in zip(back, wrapped) if not w] == [v for v, w in zip(values, wrapped) if not w] and sum(wrapped) < 150
    found = column(spark, values, code.code_blocks)
    assert found == [re.findall(r"```\w*\n[\s\S]*?```", v) for v in values] and sum(map(len, found)) > 50
    rows = spark.createDataFrame([("`\"«CODE_BLOCK_1»\"` CODE_BLOCK_10 «CODE_BLOCK_0» CODE_BLOCK_1", [f"<{i}\\1$>" for i in range(11)])], "t string, b array<string>")
    assert rows.select(code.put_back(F.col("t"), F.col("b"))).first()[0] == "<1\\1$> <10\\1$> <0\\1$> <1\\1$>"
    assert column(spark, ["«CODE_BLOCK_0» \n«CODE_BLOCK_12»", "«CODE_BLOCK_0» a"], code.has_prose) == [False, True]


def test_images_equal_a_loop(spark):
    rng = random.Random(5)

    def loop(text, imgs):
        paras = text.split("\n\n")
        worded = [i for i, p in enumerate(paras) if p.strip()]
        if not imgs:
            return text
        if not worded:
            return text + "\n\n" + "\n\n".join(md for _, md in imgs)
        n, m, put = len(worded), len(imgs), {}
        for i, (frac, md) in enumerate(imgs):
            put.setdefault(worded[min(int(frac * n), n - 1) if m <= n else int(i * n / m)], []).append(md)
        return "\n\n".join(x for i, p in enumerate(paras) for x in [p, *put.get(i, [])])

    cases = [("\n\n".join(rng.choices(["p", " ", "", "q\nr"], k=rng.randint(1, 6))), [(rng.choice([0.0, 0.25, 1 / 3, 0.5, 1.0]), f"![{k}]") for k in range(rng.randint(0, 8))]) for _ in range(300)]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(cases)], "i int, t string, x array<struct<frac:double,md:string>>")
    got = {r.i: r.y for r in rows.select("i", images.interleave(F.col("t"), F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [loop(t, x) for t, x in cases]


def test_annotations_equal_a_sequential_pass(spark):
    rng = random.Random(6)

    def loop(text):
        log = []
        for ua, en in sorted(ANNOTATIONS.items(), key=lambda t: -len(t[0])):
            spans = [m.span() for m in re.finditer(r"```.*?```", text, re.S)]
            for m in re.finditer(rf"(?<!\w)({re.escape(ua)})(?!\w)(?!\s*\([^)]*\))", text, re.I):
                if not any(a <= m.start() < b for a, b in spans):
                    log.append(f"  «{m[1]}» → «{m[1]} ({en})»")
                    text = text[: m.end(1)] + f" ({en})" + text[m.end(1) :]
                    break
        return text, log

    bits = ["зв'язаність", "доцентрова зв'язаність", "Сага", "сага", "САГА", " ", " ", " (x)", "```", "мікросервіси", "абстракція", "-", ", ", "фітнес-функція", "їсага", "технічний борг", "\n"]
    values = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(250)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").withColumn("a", terms.annotations(F.col("t")))
    got = {r.i: (r.y, r.c) for r in rows.select("i", terms.annotate(F.col("t"), F.col("a")).alias("y"), terms.change_log(F.col("a")).alias("c")).collect()}
    assert [got[i] for i in range(len(values))] == [loop(v) for v in values]
    once = spark.createDataFrame([("сага (saga) і сага",)], "t string")
    assert once.select(F.size(terms.annotations(F.col("t"))), F.size(terms.annotations(F.col("t"), idempotent=True))).first() == (1, 0)


def test_english_forms(spark):
    texts = ["ДОКЕР, докером", "мікросервісна архітектура і мікросервіси", "подієво-керована архітектура", "Гіт хаб, скрам", "plain"]
    assert column(spark, texts, terms.force_english) == ["Docker, докером", "microservices architecture і microservices", "event-driven architecture", "GitHub, Scrum", "plain"]


def test_guards(spark):
    cases = [("a b", "c " * 5, None), ("a b", "c " * 6, "length"), ("", "c d", None), ("a", "[Продовження тексту", "marker"), ("a", "Класифікація ", "section"), ("a", "Висновки", None), ("a", "Висновки\n", "section")]
    rows = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(cases)], "i int, s string, r string").select("i", guards.added_reason(F.col("s"), F.col("r")).alias("y"))
    assert [r.y for r in sorted(rows.collect())] == [c[2] for c in cases]


def test_job_rules(spark):
    rows = spark.createDataFrame([(True, 5, 5), (False, 5, 5), (False, 0, 0), (False, 1, 200)], "alive boolean, done long, total long")
    got = rows.select(metrics.status(F.col("alive"), F.col("done"), F.col("total")), metrics.percent(F.col("done"), F.col("total"))).collect()
    assert [tuple(r) for r in got] == [("running", 100), ("done", 100), ("idle", 0), ("idle", 1)]
    states = column(spark, ['{"chunks": {"0": "a", "7": "b"}, "last_chunk": 7}', "{", None], state.parse_checkpoint)
    assert [(s.last_chunk, dict(s.chunks)) for s in states] == [(7, {"0": "a", "7": "b"}), (-1, {}), (-1, {})]


def raw_book(spark, n=60):
    def block(i):
        image = i % 9 == 4
        spans = [] if image else [(f"Line {i}, some words here.", 20.0 if i % 11 == 0 else 11.0, "Serif", 0)]
        return ("b", 1 + i // 5, i, int(image), (0.0, float(i), 100.0, float(i) + 80.0), spans)

    schema = "book_id string, page_num int, block_no int, block_type int, bbox struct<x0:double,y0:double,x1:double,y1:double>, spans array<struct<text:string,size:double,font:string,flags:int>>"
    return spark.createDataFrame([block(i) for i in range(n)], schema)


def test_a_run_resumes_and_ends_in_the_same_book(spark, tmp_path):
    raw = raw_book(spark)
    whole = jobs.run(raw, f"{tmp_path}/whole", max_words=20)
    n = whole.count()
    part = f"{tmp_path}/part"
    whole.filter(F.col("chunk_id") < n // 2).write.parquet(part)
    again = jobs.run(raw, part, max_words=20)
    assert again.count() == n and sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    book = jobs.books(again, raw, spark.createDataFrame([("b", "T")], "book_id string, title string")).first().markdown
    assert book.startswith("# T\n\n> Переклад: сторінки 1–12 з 12\n\n---\n\n# Line 0, some words here.") and book.count("![Рисунок") == 7
    jobs.clear(spark, part)
    assert not jobs._exists(spark, part)
    held = translate.pending(whole.select("book_id", "chunk_id"), whole.filter("chunk_id IN (0, 3)").select("book_id", "chunk_id"))
    assert held.count() == n - 4


def test_code_stays_out_of_the_backend(spark):
    chunks_ = spark.createDataFrame([("b", 0, "Докер:\nx\n```py\nдокер = {1}\n```"), ("b", 1, "```\nonly\n```"), ("b", 2, " ")], "book_id string, chunk_id int, text string")
    got = {r.chunk_id: r.translated for r in translate.transform_chunks(chunks_).collect()}
    assert got == {0: "Docker:\nx\n```py\nдокер = {1}\n```", 1: "```\nonly\n```", 2: " "}
    faithful = {r.chunk_id: r.translated for r in translate.transform_chunks(chunks_, faithful=True).collect()}
    assert faithful[0].endswith("Docker = {1}\n```")


def test_context_runs_in_order_and_resumes(spark):
    rows = spark.createDataFrame([("a", i, f"t{i}") for i in range(5)] + [("b", 0, "x")], "book_id string, chunk_id int, text string")
    answer = lambda text, previous: f"{text}<{previous[-4:]}"
    whole = {(r.book_id, r.chunk_id): r.answer for r in translate.transform_in_order(rows, answer).collect()}
    assert whole["a", 2] == "t2<<t0<" and len(whole) == 6
    stored = spark.createDataFrame([("a", i, whole["a", i]) for i in range(2)], "book_id string, chunk_id int, translated string")
    rest = {(r.book_id, r.chunk_id): r.answer for r in translate.transform_in_order(rows, answer, stored).collect()}
    assert rest == {k: v for k, v in whole.items() if k not in (("a", 0), ("a", 1))}


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.reply({"models": [{"name": "some-model:8b"}]})

        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            self.reply({"response": prompt.split("\n")[-3].upper()})

        def log_message(self, *args):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_the_server_backend(spark, server):
    assert backends.server_ready("some-model", server) and not backends.server_ready("other", server) and not backends.server_ready("x", "http://127.0.0.1:1")
    rows = spark.createDataFrame([("b", 0, "hello there"), ("b", 1, "")], "book_id string, chunk_id int, text string")
    got = {r.chunk_id: (r.translated, r.flag) for r in translate.transform_chunks(rows, backends.http("some-model", server)).collect()}
    assert got == {0: ("HELLO THERE", None), 1: ("", None)}


def test_flagged_answers_are_asked_for_again_and_a_failed_second_pass_keeps_the_first(spark):
    marker = MARKERS[0]
    asked = []

    def varying(rows, prompt, text, out):
        asked.append(prompt)
        first = F.when(F.col(text).contains("bad"), F.concat(F.col(text), F.lit(" " + marker))).otherwise(F.upper(text))
        return rows.withColumn(out, F.when(F.col(prompt).isNotNull(), first if len(asked) == 1 else F.lower(text)))

    varying.varies = True

    def failing(rows, prompt, text, out):
        return rows.withColumn(out, F.when(F.col(text) != "GOOD", F.concat(F.lit("fixed "), F.col(text))))

    rows = spark.createDataFrame([("b", 0, "Good"), ("b", 1, "Some bad"), ("b", 2, " ")], "book_id string, chunk_id int, text string")
    got = {r.chunk_id: (r.translated, r.flag) for r in translate.transform_chunks(rows, varying, failing).collect()}
    assert len(asked) == 2 and got == {0: ("GOOD", None), 1: ("fixed some bad", None), 2: (" ", None)}


def test_whole_books_in_order(spark, tmp_path):
    def echo(rows, prompt, text, out):  # what stood before, from the prompt's context
        before = F.regexp_extract(prompt, rf"(?s){re.escape(CONTEXT_LABEL)}\n(.*?)\n\n", 1)
        return rows.withColumn(out, F.concat(F.col(text), F.lit(" after "), F.length(before).cast("string")))

    rows = [(b, k, f"{b} text {k}" if k != 2 else "```\nx\n```") for b in "pqr" for k in range({"p": 4, "q": 1, "r": 3}[b])]
    frame = spark.createDataFrame(rows, "book_id string, chunk_id int, text string").withColumn("images", F.expr("array(named_struct('frac', 1.0D, 'md', '![i](i.png)'))"))
    store = f"{tmp_path}/store"
    want, before = {}, {}
    for b, k, text in rows:
        want[b, k] = before[b] = f"{text} after {len(before.get(b, ''))}" if k != 2 else text
    part = translate.translate_in_order(frame.filter("chunk_id < 2"), store, echo)
    assert {(r.book_id, r.chunk_id): r.answer for r in part.collect()} == {k: v for k, v in want.items() if k[1] < 2}
    whole = translate.translate_in_order(frame, store, echo).collect()
    assert {(r.book_id, r.chunk_id): r.answer for r in whole} == want and len(whole) == len(rows)
    assert all(r.translated.endswith("![i](i.png)") for r in whole)
    assert translate.translate_in_order(frame.limit(0), f"{tmp_path}/none").count() == 0


def test_long_books_and_texts_take_linear_time(spark):
    n = 200_000
    blocks_ = spark.range(n).select(F.lit(1).alias("book_id"), F.col("id").cast("int").alias("ord"), F.lit("paragraph").alias("kind"), F.lit("some five words stand here").alias("text"))
    began = time.perf_counter()
    rows = chunks.chunk_blocks(blocks_, 10).agg(F.max("chunk_id"), F.count("*"), F.countDistinct("chunk_id")).first()
    assert tuple(rows) == (n // 2 - 1, n, n // 2)
    text = spark.range(1).select(F.lit("ab 12, " * 100_000).alias("t"))
    found = text.select(places(F.col("t"), F.lit("[0-9]+")).alias("p")).selectExpr("size(p)", "p[99999].s", "p[99999].t").first()
    assert tuple(found) == (100_000, 7 * 99_999 + 3, "12")
    streamed = chunk_stream.chunk_documents(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a b\n" * 100_000).alias("text")), 4)
    assert tuple(streamed.agg(F.count("*"), F.sum("n_words"), F.sum("n_blocks")).first()) == (50_001, 200_000, 100_001)
    assert time.perf_counter() - began < 60


def test_files(spark, tmp_path):
    book = tmp_path / "book.md"
    book.write_text("Перша сага тут.", encoding="utf-8")
    assert jobs.annotate_file(str(book), spark, preview=True) == ["  «сага» → «сага (saga)»"] and not (tmp_path / "book.md.bak").exists()
    jobs.annotate_file(str(book), spark)
    assert book.read_text(encoding="utf-8") == "Перша сага (saga) тут."
    assert state.read_markdown(spark, str(book)).first().text == "Перша сага (saga) тут."
    (tmp_path / "r.json").write_text(json.dumps({"k1": {"title": "T", "from_page": 2, "pid": None}}))
    row = state.read_registry(spark, str(tmp_path / "r.json")).first()
    assert (row.book_id, row.title, row.from_page, row.pid) == ("k1", "T", 2, None)
    with pytest.raises(Exception, match="[Mm]alformed|MALFORMED"):
        (tmp_path / "bad.json").write_text("{")
        state.read_registry(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError):
        jobs.export(str(book), "doc")
    assert re.fullmatch("[0-9a-f]{10}", spark.range(1).select(state.book_id()).first()[0])


def test_books_are_written_and_measured(spark, tmp_path):
    folder = f"{tmp_path}/out"
    texts = {"a": "# A\n\ntext\n", "b": "", "c": "no newline"}
    state.write_books(spark.createDataFrame([*texts.items()], "book_id string, markdown string"), folder)
    state.write_books(spark.createDataFrame([("b", "second"), ("d", None)], "book_id string, markdown string"), folder)  # the others stay
    want = texts | {"b": "second", "d": ""}
    assert {r.book_id: r.markdown for r in state.read_books(spark, folder).collect()} == want
    (tmp_path / "out" / "book_id=a" / "images").mkdir()
    for k in range(2):
        (tmp_path / "out" / "book_id=a" / "images" / f"p{k}.png").write_bytes(b"x" * 5000)
    got = {r.book_id: (r.size_kb, r.n_png) for r in metrics.output_sizes(state.book_files(spark, folder)).collect()}
    assert got == {k: (round((len(t) + 1) / 1024, 1), 2 if k == "a" else 0) for k, t in want.items()}


def test_a_finished_job(spark, tmp_path):
    store = spark.createDataFrame([("k", 0, "Перша сага тут."), ("k", 1, "Далі.")], "book_id string, chunk_id int, translated string")
    raw = spark.createDataFrame([("k", 3), ("k", 9)], "book_id string, page_num int")
    titles = spark.createDataFrame([("k", "T")], "book_id string, title string")
    sizes = jobs.finish(store, raw, titles, f"{tmp_path}/out", glossary=True).collect()
    assert [(r.book_id, r.n_png) for r in sizes] == [("k", 0)]
    assert state.read_books(spark, f"{tmp_path}/out").first().markdown == jobs.books(store, raw, titles).first().markdown
    note = spark.read.text(f"{tmp_path}/out_glossary", wholetext=True).first().value
    assert note.rstrip("\n") == terms.glossary_note(terms.glossary(spark)).first().note


def test_uploads(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for name in ("one_book (1).pdf", "two.pdf", "note.txt"):
        (land / name).write_bytes(b"%PDF")
    stream = state.landed_files(spark, str(land)).select("path", "length").writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    assert stream.awaitTermination(120)
    files = spark.table("landed")
    two = next(r.path for r in files.collect() if r.path.endswith("two.pdf"))
    rows = {r.title: r for r in state.uploads(files, spark.createDataFrame([(two, "Second", 7)], "path string, title string, from_page int")).collect()}
    assert {t: r.from_page for t, r in rows.items()} == {"one book": 1, "Second": 7} and rows["Second"].pdf_path == two
    for r in rows.values():
        assert re.fullmatch("[0-9a-f]{10}", r.book_id) and r.url_prefix == f"/data/books/{r.book_id}/output" and r.pid is None


def test_eta(spark):
    timed = spark.createDataFrame([("a", 0, 900.0), ("a", 4, 90.0), ("b", 9, 60.0)], "book_id string, chunk_id int, seconds double")
    totals = spark.createDataFrame([("a", 10), ("b", 10), ("c", 3)], "book_id string, total int")
    assert {(r.book_id, r.remaining, r.eta_minutes) for r in metrics.eta(timed, totals).collect()} == {("a", 5, 7), ("b", 0, 0), ("c", 3, None)}


def test_words_are_counted_once_and_without_a_pattern(spark):
    assert "regexp" not in str(count_words(F.col("x"))._jc).lower()
    assert column(spark, [None, "a b\x1cc \U0001f600"], count_words) == [None, 4]
    rows = spark.createDataFrame([("a b", "a b")], "s string, r string").select(guards.added_reason(F.col("s"), F.col("r")).alias("y"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2  # each text's words once


def test_forms_run_only_on_texts_that_may_have_them(spark):
    rng = random.Random(11)
    whole = functools.reduce(lambda t, f: F.regexp_replace(t, terms.java(f[0]), f[1]), ENGLISH_FORMS, F.col("x"))
    bits = ["докер", "ДОКЕР", "\u1c81\u1c82кер", "г-рпц", "ГРПЦ", "гіт хаб", "Гітлаб", "мікросервісна архітектура", "архітектори програмного забезпечення", "розробка на основі тестування", "Граф QL", "скрам", "слово", " ", "\n", "-"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(300)]
    assert column(spark, texts, terms.force_english) == column(spark, texts, lambda _: whole)
    plan = spark.createDataFrame([("a",)], "x string").select(terms.force_english(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(terms.needed(f) in plan.lower() for f, _ in ENGLISH_FORMS) and plan.lower().count("contains(") == len(ENGLISH_FORMS)


def test_chunk_blocks_shuffles_no_text(spark):
    plan = queries.QUERIES["chunk_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join")].split("\n")[-2]
    assert "n_chars" in joined and "text" not in joined
