"""op6 on pages whose main text is known by construction."""

from __future__ import annotations

import json
import random
import time

from folioflow.llm import html_main as h


def page(rng, n):
    blocks = [" ".join(rng.choices(["alpha", "beta & co", "gämma", "x<y", "delta"], k=rng.randint(1, 9))) for _ in range(n)]
    code = [b.replace("&", "&amp;").replace("<", "&lt;") for b in blocks]
    side = "".join(f"<li><a href='/{i}'>menu {rng.random()}</a></li>" for i in range(rng.randint(1, 5)))
    body = f"<h1>{code[0]}</h1>" + "".join(f"<p><b>{c}</b></p>" if i % 2 else f"<p>  {c} \n" for i, c in enumerate(code[1:]))
    notice = "<div class='cookie-notice'>We use cookies</div>" if n % 2 else ""
    text = (
        f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p><article>';</script><style>p{{}}</style></head><body><header>Site</header><nav><ul>{side}</ul></nav>"
        f"<!-- c --><div class=ad>Buy {rng.random()}</div>{notice}<article>{body}<form><input name=q>Mail</form></article><section id='comments'><p>First!</p></section><footer>&copy; me</footer>"
    )
    return text, "\n".join(" ".join(b.split()) for b in blocks)


def test_known_pages(spark, tmp_path):
    rng = random.Random(1)
    made = [page(rng, rng.randint(1, 30)) for _ in range(60)]
    rows = [(i, f"https://{'hot' if i % 3 else 'h' + str(i % 4)}.example.com/{i}", p, "x") for i, (p, _) in enumerate(made)]
    rows += [(100, None, made[0][0], "x"), (101, "no url", None, None), (102, "http://a.b/", "", "x"), (103, "http://a.b/", "<article><p>cut &amp", "x"), (103, "http://a.b/", "<article><p>cut &amp", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, main_text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in h.op6_html(spark, str(tmp_path)).collect()), key=str)
    want = [(i, u, made[i][1] if i < 60 else {100: made[0][1], 103: "cut &"}.get(i, "")) for i, u, _, _ in rows]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)


def test_constant_slots_go_where_there_is_no_article():
    pages = [f"<body><p>Subscribe now</p><div><p>story {i} of the day</p><p>more {i}</p></div><p>All rights</p>" for i in range(5)]
    wrapper = h.infer(pages)
    assert h.extract(pages[2], wrapper) == "story 2 of the day\nmore 2"
    assert h.extract("<body><p>new</p>", wrapper) == "new"


def test_folding_and_alignment():
    keys = [k for k, _ in h.tokens("<ul>" + "<li><a>x</a></li>" * 40 + "</ul>")]
    assert [k for k, _ in h.fold(keys)] == ["<ul>", "<li>", "<a>", "T", "</a>", "</li>", "</ul>"]
    assert h.extract("<article>" + "<p>a<br>b" * 3000 + "</article>", h.infer(["<article><p>q</article>"])).count("\n") == 2999


def test_empty_table(spark):
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def layouts_without_article():
    rows = []
    for k in range(12):
        for i in range(5):
            head = f"<div class=top{k % 4}>notice {k}</div>"
            body = f"<h{k % 3 + 1}>title {k} {i}</h{k % 3 + 1}>" + f"<div><p>story {k} {i}</p><blockquote>quote {k} {i}</blockquote></div>"
            foot = f"<hr><dl><dt>legal {k}</dt></dl>" if k > 5 else f"<ul><li>legal {k}</li></ul>"
            want = [f"title {k} {i}", f"story {k} {i}", f"quote {k} {i}"]
            rows.append((len(rows), "http://one.example.com/", f"<body>{head}{body}{foot}</body>", "\n".join(want)))
    return rows


def test_every_layout_of_a_host_is_learned(spark):
    rows = layouts_without_article()
    pages = spark.createDataFrame([r[:3] for r in rows] * 2, "page_id long, url string, html string").repartition(7)
    got = {(r.page_id, r.main_text) for r in h.main_text(pages).collect()}
    assert got == {(r[0], r[3]) for r in rows}
    assert h.layouts(pages).count() == len({tuple(k for k, _, _ in h.shape(r[2])) for r in rows}) == 12


def test_layouts_in_rounds_and_copies(spark):
    rows = layouts_without_article()
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for fan in (2, 3, 64):
        wrapper = h.wrappers(pages, fan=fan).first()["__wrapper"]
        assert {t for x in json.loads(wrapper) for t in x[3]} >= {h.text_hash(f"{w} {k}") for w in ("notice", "legal") for k in range(12)}
    copies = spark.createDataFrame([(i, None, "<p>the same page</p>") for i in range(9)], "page_id long, url string, html string")
    assert {r.main_text for r in h.main_text(copies).collect()} == {"the same page"}


def test_class_words_are_a_hint_on_articles():
    assert h.extract('<article class="post related-topic"><p>real story</p></article>', None) == "real story"
    assert h.extract('<article><p>story</p></article><article class="related"><p>teaser</p></article>', None) == "story"
    assert h.extract('<article><p>story</p><article class="comment"><p>First!</p></article></article>', None) == "story"


def test_matches_ascend_and_are_equal():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        found = h.matches(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert h.matches(list("abcde"), list("xabde")) == [(0, 1), (1, 2), (3, 3), (4, 4)]


def test_long_and_deep_pages_take_linear_time():
    rng = random.Random(3)
    tags = ["<p>", "<h2>", "<hr>", "<b>", "<i>", "</b>", "</i>", "<li>", "<dd>"]

    def made(n):
        return [f"<body><p>same notice</p>{''.join(rng.choice(tags) + (f'w{rng.random()}' if rng.random() < 0.5 else '') for _ in range(n))}" for _ in range(4)]

    def seconds(pages):
        begin = time.perf_counter()
        h.extract(pages[3], h.infer(pages[:3]))
        return time.perf_counter() - begin

    seconds(made(2000))
    assert seconds(made(32000)) < 24 * seconds(made(4000))  # eight times the length
    assert h.extract("<div>" * 200000 + "<p>deep" + "</span>" * 1000, None) == "deep"
