"""The queries of the document operators and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import (
    ANSWER_LABEL, CHUNK_SEPARATOR, CONTEXT_LABEL, ENGLISH_FORMS, FAKE_SECTIONS, FIX_LABELS, GLOSSARY, GLOSSARY_HEAD, GLOSSARY_TITLE, IMAGE_WORD, KEEP_ENGLISH, MARKERS,
    SOURCE_LABEL, SYSTEM_PROMPT, TERM_FIX_PROMPT,
)
from folioflow.functions.pytext import SPACES, WORD, WS, count_words, split_lines, strip
from folioflow.operators import assemble, blocks, chunks, cleanup, code, guards, images, metrics, prompts, terms
from folioflow.plans import backends, translate
from folioflow.sources import fixtures, state
from folioflow.sources.fixtures import DIRTY_DOCS, DIRTY_LINES, table
from folioflow.sources.shared import shared_folder
from folioflow.streaming import chunk_stream

BUDGET = 60
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def q(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'" if "\n" not in text else "(" + " || chr(10) || ".join(q(p) for p in text.split("\n")) + ")"


# ---- SQL that several queries share
LINES = """l AS (SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))"


RAW = f"""{LINES},
m AS (SELECT *, pos * 7 + doc_id * 3 AS m FROM l),
raw AS (SELECT doc_id AS book_id, pos AS block_no, m, line, CASE WHEN m % 17 = 3 THEN 1 ELSE 0 END AS block_type,
   CAST((m % 2) * 300 AS DOUBLE) AS x0, CAST((m * 37) % 700 AS DOUBLE) AS y0, (m % 2) * 300 + 30 + (m * 11) % 200 AS x1, (m * 37) % 700 + 20 + (m * 13) % 200 AS y1,
   {s_strip('line')} <> '' AS has, pos % 3 = 0 AS more, 10 + m % 9 AS size FROM m),
runs AS (SELECT *, CAST(CASE WHEN more THEN size + 1 ELSE size END AS DOUBLE) AS max_size_all,
   CAST(CASE WHEN NOT has THEN size + 1 WHEN more THEN size + 1 ELSE size END AS DOUBLE) AS max_size,
   more OR (has AND m % 5 = 0) AS bold, (NOT has OR m % 4 = 0) AS italic, has AND m % 13 = 0 AS mono,
   regexp_replace({s_strip("CASE WHEN NOT more THEN line WHEN has THEN line || '   and more ' ELSE '  and more ' END")}, '{WS}+', ' ', 'g') AS text
   FROM raw WHERE block_type = 1 OR has OR more),
c AS (SELECT *, CASE WHEN block_type = 1 THEN 'image' WHEN mono THEN 'code' WHEN max_size >= 18 THEN 'heading1'
   WHEN max_size >= 14 OR (bold AND max_size >= 12) THEN 'heading2' WHEN italic AND length(text) < 200 THEN 'caption' ELSE 'paragraph' END AS kind FROM runs)"""

PLAIN = f"""{LINES},
m AS (SELECT *, pos * 7 + doc_id * 3 AS m, 10 + (pos * 7 + doc_id * 3) % 9 AS size FROM l),
b AS (SELECT doc_id AS book_id, pos AS ord, pos + 1 AS page_num, CASE WHEN m % 17 = 3 THEN 'image' WHEN m % 13 = 0 THEN 'code' WHEN size >= 18 THEN 'heading1'
   WHEN size >= 14 OR (m % 5 = 0 AND size >= 12) THEN 'heading2' WHEN m % 4 = 0 AND length(line) < 200 THEN 'caption' ELSE 'paragraph' END AS kind,
   CASE WHEN m % 17 = 3 THEN chr(10) || '![' || pos || ']' || chr(10) ELSE line END AS text FROM m),
w AS (SELECT *, CASE WHEN kind = 'image' THEN 0 ELSE {s_words('text')} END AS n_words FROM b)"""

FOLD = f"""{PLAIN},
r AS (SELECT book_id, ord, kind, text, n_words, 0 AS chunk_id,
        CASE WHEN n_words >= {BUDGET} AND kind NOT IN ('heading1', 'heading2', 'image') THEN 1 ELSE 0 END AS next_chunk,
        CASE WHEN n_words >= {BUDGET} AND kind NOT IN ('heading1', 'heading2', 'image') THEN 0 ELSE 1 END AS n,
        CASE WHEN n_words >= {BUDGET} AND kind NOT IN ('heading1', 'heading2', 'image') THEN 0 ELSE n_words END AS words
      FROM w WHERE ord = 0
      UNION ALL
      SELECT book_id, ord, kind, text, n_words, chunk_id, chunk_id + f, CASE WHEN f = 1 THEN 0 ELSE n0 + 1 END, CASE WHEN f = 1 THEN 0 ELSE w0 END
      FROM (SELECT *, CASE WHEN w0 >= {BUDGET} AND kind NOT IN ('heading1', 'heading2', 'image') THEN 1 ELSE 0 END AS f
            FROM (SELECT w.*, r.next_chunk + CASE WHEN w.kind = 'heading1' AND r.n > 0 THEN 1 ELSE 0 END AS chunk_id,
                    CASE WHEN w.kind = 'heading1' AND r.n > 0 THEN 0 ELSE r.n END AS n0, CASE WHEN w.kind = 'heading1' AND r.n > 0 THEN 0 ELSE r.words END + w.n_words AS w0
                  FROM r JOIN w ON w.book_id = r.book_id AND w.ord = r.ord + 1)))"""

MARKDOWN = "CASE kind WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'heading1' THEN '# ' || text WHEN 'heading2' THEN '## ' || text WHEN 'caption' THEN '*' || text || '*' ELSE text END"
DIRTY = "d AS (SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN {q(a)} || text || {q(b)}" for i, (a, b) in enumerate(DIRTY_DOCS)) + " END AS text FROM documents)"


# ---- sources and blocks
@query("span_fold", f"WITH {RAW} SELECT book_id, block_no, max_size, bold, italic, mono, length(text) AS n_chars, md5(text) AS text_md5 FROM runs WHERE block_type = 0")
def span_fold(spark, d):
    raw = fixtures.raw_blocks(spark, d).filter("block_type = 0").withColumn("run", blocks.text_spans(F.col("spans"))).filter(F.size("run") > 0)
    f = raw.withColumn("f", blocks.fold_spans(F.col("run")))
    return f.select("book_id", "block_no", "f.max_size", "f.bold", "f.italic", "f.mono", F.length("f.text").cast("long").alias("n_chars"), F.md5("f.text").alias("text_md5"))


@query("classify_blocks", f"WITH {RAW} SELECT book_id, page_num, block_no, kind FROM (SELECT *, CAST(1 + block_no AS INTEGER) AS page_num FROM c)")
def classify_blocks(spark, d):
    return blocks.classify(fixtures.raw_blocks(spark, d)).select("book_id", "page_num", "block_no", "kind")


REASON = f"""CASE WHEN length(t) < 3 THEN 'short' WHEN regexp_matches(t, '^\\p{{Nd}}+$') THEN 'digits' WHEN regexp_matches(t, '^[\\p{{Nd}}{SPACES}]{{10,}}$') THEN 'number_row'
  WHEN regexp_matches(t, 'ISBN|US \\$|CAN \\$') AND length(t) < 80 THEN 'imprint' WHEN regexp_matches(t, 'Twitter:|linkedin\\.com|youtube\\.com') THEN 'social'
  WHEN regexp_matches(t, '^\\p{{Nd}}+{WS}*\\|') OR regexp_matches(t, '^[^\\n]+\\|{WS}*\\p{{Nd}}+$') THEN 'page_number'
  WHEN page_num > 5 AND length(t) < 40 AND NOT regexp_matches(t, '[.,:;]')
       AND ((regexp_matches(t, '\\p{{Lu}}') AND NOT regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}]')) OR regexp_matches(t, '^[A-Z][a-z ]+$')) THEN 'running_head' END"""


@query(
    "noise_filter",
    f"""WITH {LINES}, x AS (SELECT doc_id AS book_id, pos + 1 AS page_num, CASE (doc_id + pos) % 12 {' '.join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(DIRTY_LINES))} ELSE line END AS text FROM l)
SELECT book_id, page_num, {REASON} AS reason FROM (SELECT *, {s_strip('text')} AS t FROM x)""",
)
def noise_filter(spark, d):
    return fixtures.dirty_lines(spark, d).select("book_id", "page_num", blocks.noise_reason(F.col("text"), F.col("page_num")).alias("reason"))


@query("tiny_images", f"WITH {RAW} SELECT book_id, block_no, (x1 - x0 < 60) OR (y1 - y0 < 40) AS tiny FROM raw WHERE block_type = 1")
def tiny_images(spark, d):
    return fixtures.raw_blocks(spark, d).filter("block_type = 1").select("book_id", "block_no", blocks.is_tiny(F.col("bbox")).alias("tiny"))


PAGES4 = f"{RAW}, p AS (SELECT *, 1 + block_no // 4 AS page_num, {s_strip('text')} AS t FROM c)"
KEPT4 = f"{PAGES4}, k AS (SELECT * FROM p WHERE CASE WHEN kind = 'image' THEN x1 - x0 >= 60 AND y1 - y0 >= 40 ELSE ({REASON}) IS NULL END)"


@query("reading_order", f"WITH {KEPT4} SELECT book_id, CAST(page_num AS INTEGER) AS page_num, kind, y0, x0, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_num, y0, x0, block_no) - 1 AS INTEGER) AS ord FROM k")
def reading_order(spark, d):
    return blocks.extract(fixtures.raw_blocks(spark, d, 4)).select("book_id", "page_num", "kind", "bbox.y0", "bbox.x0", "ord")


@query(
    "image_names",
    f"""WITH {KEPT4}, i AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_num ORDER BY block_no) AS n FROM k WHERE kind = 'image')
SELECT book_id, CAST(page_num AS INTEGER) AS page_num, chr(10) || '![{IMAGE_WORD} ' || page_num || '-' || n || '](images/p' || lpad(page_num::VARCHAR, 4, '0') || '_img' || lpad(n::VARCHAR, 2, '0') || '.png)' || chr(10) AS text FROM i""",
)
def image_names(spark, d):
    return blocks.extract(fixtures.raw_blocks(spark, d, 4)).filter("kind = 'image'").select("book_id", "page_num", "text")


@query("text_only_blocks", f"WITH {KEPT4} SELECT book_id, kind, count(*) AS n FROM k WHERE kind <> 'image' GROUP BY ALL")
def text_only_blocks(spark, d):
    return blocks.extract(fixtures.raw_blocks(spark, d, 4), images=False).groupBy("book_id", "kind").agg(F.count("*").alias("n"))


@query("page_range", f"WITH {RAW} SELECT book_id, count(*) AS n FROM raw WHERE 1 + block_no BETWEEN 3 AND 7 GROUP BY book_id")
def page_range(spark, d):
    return blocks.page_range(fixtures.raw_blocks(spark, d), 3, 7).groupBy("book_id").agg(F.count("*").alias("n"))


@query("page_count", f"WITH {RAW} SELECT book_id, max(1 + block_no // 4) AS n_pages FROM raw GROUP BY book_id")
def page_count(spark, d):
    return blocks.page_count(fixtures.raw_blocks(spark, d, 4))


# ---- chunks
@query("chunk_blocks", f"WITH RECURSIVE {FOLD} SELECT book_id, CAST(chunk_id AS INTEGER) AS chunk_id, count(*) AS n_blocks, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM r GROUP BY ALL")
def chunk_blocks(spark, d):
    measured = fixtures.plain_blocks(spark, d).withColumn("n_chars", F.length("text"))  # so no text is shuffled
    packed = chunks.chunk_blocks(measured, BUDGET)
    return packed.groupBy("book_id", "chunk_id").agg(F.count("*").alias("n_blocks"), F.sum("n_words").cast("long").alias("n_words"), F.sum("n_chars").cast("long").alias("n_chars"))


@query("chunk_text", f"WITH RECURSIVE {FOLD} SELECT book_id, CAST(chunk_id AS INTEGER) AS chunk_id, md5(coalesce(string_agg({MARKDOWN}, chr(10) || chr(10) ORDER BY ord) FILTER (kind <> 'image'), '')) AS text_md5 FROM r GROUP BY ALL")
def chunk_text(spark, d):
    return chunks.chunk_rows(chunks.chunk_blocks(fixtures.plain_blocks(spark, d), BUDGET)).select("book_id", "chunk_id", F.md5("text").alias("text_md5"))


POSITIONS = """x AS (SELECT *, sum(CASE WHEN kind = 'image' THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, chunk_id) AS total,
   coalesce(sum(CASE WHEN kind = 'image' THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, chunk_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM r),
i AS (SELECT book_id, chunk_id, ord, text AS md, CASE WHEN total = 0 THEN 1.0 ELSE CAST(seen AS DOUBLE) / total END AS frac,
   row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY ord) - 1 AS n FROM x WHERE kind = 'image')"""


@query("image_positions", f"WITH RECURSIVE {FOLD}, {POSITIONS} SELECT book_id, CAST(chunk_id AS INTEGER) AS chunk_id, CAST(n AS INTEGER) AS n, round(frac, 9) AS frac, md FROM i")
def image_positions(spark, d):
    rows = chunks.chunk_rows(chunks.chunk_blocks(fixtures.plain_blocks(spark, d), BUDGET))
    return rows.select("book_id", "chunk_id", F.posexplode("images").alias("n", "i")).select("book_id", "chunk_id", "n", F.round("i.frac", 9).alias("frac"), "i.md")


@query("chunk_images", f"WITH RECURSIVE {FOLD} SELECT book_id, CAST(chunk_id AS INTEGER) AS chunk_id, string_agg(text, '' ORDER BY ord) AS tags FROM r WHERE kind = 'image' GROUP BY ALL")
def chunk_images(spark, d):
    packed = chunks.chunk_blocks(fixtures.plain_blocks(spark, d), BUDGET)
    grouped = packed.groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))).alias("b"))
    return grouped.select("book_id", "chunk_id", F.array_join(chunks.chunk_images(F.col("b")), "").alias("tags")).filter("tags <> ''")


@query(
    "interleave_images",
    f"""WITH RECURSIVE {FOLD}, {POSITIONS},
t AS (SELECT book_id, chunk_id, string_agg({MARKDOWN}, chr(10) || chr(10) ORDER BY ord) FILTER (kind <> 'image') AS text FROM r GROUP BY ALL),
p AS (SELECT book_id, chunk_id, pos, string_split(text, chr(10) || chr(10))[pos] AS para FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS pos FROM t WHERE text IS NOT NULL)),
ne AS (SELECT *, row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY book_id, chunk_id) AS n FROM p WHERE {s_strip('para')} <> ''),
im AS (SELECT *, count(*) OVER (PARTITION BY book_id, chunk_id) AS m FROM i),
tgt AS (SELECT im.book_id, im.chunk_id, im.n AS slot, md, ne.pos FROM im JOIN ne ON ne.book_id = im.book_id AND ne.chunk_id = im.chunk_id
       AND ne.k = CASE WHEN m <= ne.n THEN least(CAST(floor(frac * ne.n) AS BIGINT), ne.n - 1) ELSE im.n * ne.n // m END),
pieces AS (SELECT book_id, chunk_id, pos, -1 AS slot, para AS s FROM p UNION ALL SELECT book_id, chunk_id, pos, slot, md FROM tgt),
whole AS (SELECT book_id, chunk_id, string_agg(s, chr(10) || chr(10) ORDER BY pos, slot) AS out FROM pieces GROUP BY ALL),
bare AS (SELECT i.book_id, i.chunk_id, chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) ORDER BY n) AS out, any_value(coalesce(t.text, '')) AS text
         FROM i JOIN t USING (book_id, chunk_id) WHERE NOT EXISTS (SELECT 1 FROM ne WHERE ne.book_id = i.book_id AND ne.chunk_id = i.chunk_id) GROUP BY ALL)
SELECT t.book_id, CAST(t.chunk_id AS INTEGER) AS chunk_id, md5(coalesce(bare.text || bare.out, whole.out, '')) AS out_md5
FROM t LEFT JOIN whole USING (book_id, chunk_id) LEFT JOIN bare USING (book_id, chunk_id)""",
)
def interleave_images(spark, d):
    rows = chunks.chunk_rows(chunks.chunk_blocks(fixtures.plain_blocks(spark, d), BUDGET))
    return rows.select("book_id", "chunk_id", F.md5(images.interleave(F.col("text"), F.col("images"))).alias("out_md5"))


@query(
    "stream_chunks",
    f"""WITH RECURSIVE {LINES}, w AS (SELECT doc_id, pos, {s_words('line')} AS n_words FROM l),
r AS (SELECT doc_id, pos, n_words, 0 AS chunk_id, CASE WHEN n_words >= {BUDGET} THEN 1 ELSE 0 END AS nxt, CASE WHEN n_words >= {BUDGET} THEN 0 ELSE n_words END AS words FROM w WHERE pos = 0
      UNION ALL SELECT w.doc_id, w.pos, w.n_words, r.nxt, r.nxt + CASE WHEN r.words + w.n_words >= {BUDGET} THEN 1 ELSE 0 END,
        CASE WHEN r.words + w.n_words >= {BUDGET} THEN 0 ELSE r.words + w.n_words END FROM r JOIN w ON w.doc_id = r.doc_id AND w.pos = r.pos + 1)
SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, count(*) AS n_blocks, CAST(sum(n_words) AS BIGINT) AS n_words FROM r GROUP BY ALL""",
)
def stream_chunks(spark, d):
    shared = shared_folder(spark)
    chunk_stream.start(chunk_stream.read_stream(spark, f"{d}/documents.parquet"), f"{shared}/chunks", f"{shared}/state", BUDGET).awaitTermination()
    return spark.read.parquet(f"{shared}/chunks")


# ---- cleanup: each stage on the whole decorated texts
def _stage(name, column, sql):
    SQL[name] = f"WITH {DIRTY} SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {sql} AS t FROM d)"
    QUERIES[name] = lambda spark, d: fixtures.dirty_docs(spark, d).select("doc_id", column(F.col("text")).alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5")
    )


def s_cjk(x):
    return f"regexp_replace({x}, '{cleanup.CJK}', '', 'g')"


def s_meta(x):
    return f"regexp_replace(regexp_replace({x}, '{cleanup.META[0]}', '', 'g'), '{cleanup.META[1]}', '', 'g')"


def s_trailing(x):
    return f"regexp_replace({x}, {q(cleanup.TRAILING_FENCE)}, '\\1', 'g')"


def s_lines(x):
    parts = f"string_split_regex({x}, '{_line_end}')"
    return f"list_transform([{parts}], lambda p: CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END)[1]"


_line_end = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def s_lone(a):
    return f"list_transform([{a}], lambda a: list_filter(a, lambda x, i: {s_strip('x')} <> '```' OR regexp_matches(coalesce({s_strip('a[i - 1]')}, '') || coalesce({s_strip('a[i + 1]')}, ''), '{cleanup.CODE_SIGNS}')))[1]"


def s_close(a):
    fence = f"{s_strip('x')} = '```' OR (starts_with({s_strip('x')}, '```') AND length({s_strip('x')}) <= 20)"
    return f"list_transform([{a}], lambda a: CASE WHEN len(list_filter(a, lambda x: {fence})) % 2 = 1 THEN list_append(a, '```') ELSE a END)[1]"


def s_hashtags(a):
    spam = f"list_filter(range(1, len(a) + 1), lambda i: len(regexp_extract_all(a[i], '{cleanup.HASHTAG}')) >= 3)"
    return f"list_transform([{a}], lambda a: a[1:coalesce(list_min({spam}) - 1, len(a))])[1]"


def s_join(a):
    return f"coalesce(array_to_string({a}, chr(10)), '')"


def s_readable(x):
    return s_join(f"list_filter({s_lines(x)}, lambda x: {s_strip('x')} = '' OR regexp_matches(x, {q(cleanup.READABLE)}))")


def s_repeats(x):
    # RE2 looks neither back nor forth: mark the gaps, then split at the marks
    marked = f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    third = f"list_filter(range(1, len(s) + 1), lambda i: len(list_filter(k[1:i], lambda y: y = k[i])) >= 3)"
    key = f"list_transform(s, lambda y: substr({s_strip('y')}, 1, 60))"
    return f"(list_transform([{marked}], lambda s: list_transform([{key}], lambda k: array_to_string(s[1:coalesce(list_min({third}) - 1, len(s))], ' '))[1])[1])"


_stage("strip_cjk", cleanup.cut_cjk, s_cjk("text"))
_stage("strip_meta", cleanup.cut_meta, s_meta("text"))
_stage("strip_trailing_fence", cleanup.drop_trailing_fence, s_trailing("text"))
_stage("spurious_fence", lambda t: F.array_join(cleanup.drop_lone_fences(split_lines(t)), "\n"), s_join(s_lone(s_lines("text"))))
_stage("close_fence", lambda t: F.array_join(cleanup.close_fence(split_lines(t)), "\n"), s_join(s_close(s_lines("text"))))
_stage("hashtag_cut", lambda t: F.array_join(cleanup.cut_hashtags(split_lines(t)), "\n"), s_join(s_hashtags(s_lines("text"))))
_stage("repetition_cut", cleanup.cut_repeats, s_repeats("text"))
_stage("script_filter", cleanup.readable_lines, s_readable("text"))
_stage("final_strip", strip, s_strip("text"))
S_CLEAN = "text"
for _step in (s_cjk, s_meta, s_trailing, s_lines, s_lone, s_close, s_hashtags, s_join, s_repeats, s_readable, s_strip):
    S_CLEAN = _step(S_CLEAN)
_stage("strip_noise", cleanup.strip_noise, S_CLEAN)


# ---- code
S_BLOCK = r"(?s)```[\p{L}\p{N}_]*\n.*?```"
S_OUT = f"array_to_string(list_transform(string_split_regex(text, '{S_BLOCK}'), lambda p, i: CASE WHEN i = 1 THEN p ELSE '«CODE_BLOCK_' || (i - 2) || '»' || p END), '')"


@query("code_extract", f"WITH {DIRTY} SELECT doc_id, len(bs) AS n_blocks, md5(array_to_string(bs, '')) AS blocks_md5, md5({S_OUT}) AS text_md5 FROM (SELECT *, regexp_extract_all(text, '{S_BLOCK}') AS bs FROM d)")
def code_extract(spark, d):
    rows = fixtures.dirty_docs(spark, d).select("doc_id", code.code_blocks(F.col("text")).alias("b"), code.take_out(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("b").cast("long").alias("n_blocks"), F.md5(F.array_join("b", "")).alias("blocks_md5"), F.md5("t").alias("text_md5"))


@query("code_roundtrip", f"WITH {DIRTY} SELECT doc_id, md5(text) AS text_md5 FROM d")
def code_roundtrip(spark, d):
    rows = fixtures.dirty_docs(spark, d).select("doc_id", code.code_blocks(F.col("text")).alias("b"), code.take_out(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5(code.put_back(F.col("t"), F.col("b"))).alias("text_md5"))


PROSE = f"WITH {DIRTY}, e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {q('```' + chr(10) + 'x' + chr(10) + '```' + chr(10))} ELSE text END AS text FROM d)"


@query("prose_only", f"{PROSE} SELECT doc_id, {s_strip(f'regexp_replace({S_OUT}, {q(code.PLACEHOLDER)}, {q(str())}, {q(chr(103))})')} <> '' AS has_prose FROM e")
def prose_only(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, "```\nx\n```\n").otherwise(F.col("text"))
    return fixtures.dirty_docs(spark, d).select("doc_id", code.has_prose(code.take_out(text)).alias("has_prose"))


# ---- terms
def _s_force(x):
    for pattern, english in ENGLISH_FORMS:
        p = pattern.replace(r"[\s-]", f"[{SPACES}-]").replace(r"\s", WS)
        tail = ""
        if p.endswith(r"(?!\w)"):
            p, tail = p.removesuffix(r"(?!\w)") + r"([^\p{L}\p{N}_]|$)", r"\1"
        p = p.split("(?!")[0]  # the one other lookahead: its words do not occur in the fixture
        x = f"regexp_replace({x}, {q(p)}, '{english}{tail}', 'gi')"
    return x


_stage("force_terms", terms.force_english, _s_force("text"))


@query("annotate_terms")
def annotate_terms(spark, d):
    rows = fixtures.dirty_docs(spark, d).withColumn("a", terms.annotations(F.col("text")))
    return rows.select("doc_id", F.size("a").cast("long").alias("n_changes"), F.md5(terms.annotate(F.col("text"), F.col("a"))).alias("text_md5"), F.array_join(terms.change_log(F.col("a")), "\n").alias("changes"))


GLOSSARY_VALUES = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in GLOSSARY.items()) + ") AS v(en, ua))"


@query("glossary_table", f"WITH {GLOSSARY_VALUES} SELECT {q(GLOSSARY_TITLE)} || chr(10) || {q(GLOSSARY_HEAD[0])} || chr(10) || {q(GLOSSARY_HEAD[1])} || chr(10) || string_agg('| ' || en || ' | ' || ua || ' |', chr(10) ORDER BY en) AS note FROM g")
def glossary_table(spark, d):
    return terms.glossary_note(terms.glossary(spark))


@query("glossary_listing", f"WITH {GLOSSARY_VALUES} SELECT en, '  ' || CASE WHEN length(en) < 45 THEN rpad(en, 45, ' ') ELSE en END || ' → ' || ua AS line FROM g")
def glossary_listing(spark, d):
    return terms.glossary_listing(terms.glossary(spark))


@query("keep_english", "SELECT * FROM (VALUES " + ", ".join(f"({q(k)})" for k in KEEP_ENGLISH) + ") AS v(term)")
def keep_english(spark, d):
    return terms.keep_english(spark)


# ---- prompts and guards
EXCHANGES = "x AS (SELECT u.conv_id, u.turn, u.text AS source, a.text AS result FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_MARK = {0: MARKERS[0], 1: MARKERS[2], 2: FAKE_SECTIONS[1], 3: FAKE_SECTIONS[3]}
MARKED = f"y AS (SELECT conv_id, turn, source, result || CASE conv_id % 9 {' '.join(f'WHEN {k} THEN {q(v)}' for k, v in _MARK.items())} ELSE '' END AS result FROM x)"
REASONS = (
    f"CASE WHEN {' OR '.join(f'contains(result, {q(m)})' for m in MARKERS)} THEN 'marker' WHEN {' OR '.join(f'contains(result, {q(m)})' for m in FAKE_SECTIONS)} THEN 'section' "
    f"WHEN {s_words('source')} > 0 AND {s_words('result')} > {s_words('source')} * 2.5 THEN 'length' END"
)


@query("hallucination_flags", f"WITH {EXCHANGES}, {MARKED} SELECT conv_id, turn, {REASONS} AS reason FROM y")
def hallucination_flags(spark, d):
    rows = fixtures.exchanges(spark, d)
    mark = F.coalesce(*[F.when(F.col("conv_id") % 9 == k, F.lit(v)) for k, v in _MARK.items()], F.lit(""))
    return rows.select("conv_id", "turn", guards.added_reason(F.col("source"), F.concat("result", mark)).alias("reason"))


@query("fix_guard", f"WITH {EXCHANGES} SELECT conv_id, turn, length(result) >= 0.5 * length(source) AS accepted, md5(CASE WHEN length(result) < length(source) * 0.5 THEN source ELSE result END) AS text_md5 FROM x")
def fix_guard(spark, d):
    kept = guards.accept_fix(F.col("source"), F.col("result"))
    return fixtures.exchanges(spark, d).select("conv_id", "turn", (F.length("result") >= 0.5 * F.length("source")).alias("accepted"), F.md5(kept).alias("text_md5"))


@query(
    "build_prompt",
    f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
o AS (SELECT conv_id, turn, {q(SYSTEM_PROMPT)} || chr(10) || chr(10) || CASE WHEN {s_strip('prev')} <> '' THEN {q(CONTEXT_LABEL)} || chr(10) || right(prev, 400) || chr(10) || chr(10) ELSE '' END
  || {q(SOURCE_LABEL)} || chr(10) || text || chr(10) || chr(10) || {q(ANSWER_LABEL)} AS prompt FROM p)
SELECT conv_id, turn, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM o""",
)
def build_prompt(spark, d):
    previous = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", prompts.build_prompt(F.col("text"), previous).alias("p"))
    return rows.select("conv_id", "turn", F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("prompt_md5"))


@query(
    "fix_prompt",
    f"""WITH {EXCHANGES} SELECT conv_id, turn, md5({q(TERM_FIX_PROMPT)} || chr(10) || chr(10) || {q(FIX_LABELS[0])} || chr(10) || substr(source, 1, 1200) || chr(10) || chr(10)
 || {q(FIX_LABELS[1])} || chr(10) || result || chr(10) || chr(10) || {q(FIX_LABELS[2])}) AS prompt_md5 FROM x""",
)
def fix_prompt(spark, d):
    return fixtures.exchanges(spark, d).select("conv_id", "turn", F.md5(prompts.fix_prompt(F.col("source"), F.col("result"))).alias("prompt_md5"))


# ---- metrics
@query("doc_stats", f"WITH {PLAIN} SELECT book_id, count(*) FILTER (kind <> 'image') AS n_text, count(*) FILTER (kind = 'image') AS n_images, CAST(sum(n_words) AS BIGINT) AS n_words FROM w GROUP BY book_id")
def doc_stats(spark, d):
    return metrics.book_stats(fixtures.plain_blocks(spark, d))


@query("kind_counts", f"WITH {PLAIN} SELECT kind, count(*) AS n FROM w GROUP BY kind")
def kind_counts(spark, d):
    return metrics.kind_counts(fixtures.plain_blocks(spark, d))


@query("cost_estimate", f"WITH {PLAIN}, s AS (SELECT book_id, CAST(sum(n_words) AS DOUBLE) AS n FROM w GROUP BY book_id), e AS (SELECT book_id, CAST(floor(n * CAST(1.5 AS DOUBLE)) AS BIGINT) AS tokens_in, CAST(floor(n * CAST(1.8 AS DOUBLE)) AS BIGINT) AS tokens_out FROM s) SELECT *, round(CAST(tokens_in * 3 + tokens_out * 15 AS DOUBLE) / 1e6, 6) AS usd FROM e")
def cost_estimate(spark, d):
    tokens_in, tokens_out, usd = metrics.cost_estimate(F.col("n_words"))
    return metrics.book_stats(fixtures.plain_blocks(spark, d)).select("book_id", tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), F.round(usd, 6).alias("usd"))


@query(
    "preview_blocks",
    f"""WITH {PLAIN}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord) AS n FROM w WHERE page_num <= 5)
SELECT book_id, CAST(n AS INTEGER) AS n, '  p.' || lpad(page_num::VARCHAR, 3, '0') || ' ' || CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in metrics.TAGS.items())} END || ' ' || substr(text, 1, 80) || CASE WHEN length(text) > 80 THEN '…' ELSE '' END AS line
FROM n WHERE n <= 20""",
)
def preview_blocks(spark, d):
    return metrics.preview(fixtures.plain_blocks(spark, d))


# ---- books and jobs, with conversations as books and turns as chunks
@query(
    "assemble_document",
    f"""SELECT conv_id AS book_id, md5('# Conversation ' || conv_id || chr(10) || chr(10) || '> Переклад: сторінки ' || 1 || '–' || any_value(n) || ' з ' || any_value(n) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || string_agg(text, {q(CHUNK_SEPARATOR)} ORDER BY turn)) AS text_md5 FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE text <> '' GROUP BY conv_id""",
)
def assemble_document(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chunk_id"), "text")
    n = turns.groupBy("book_id").agg(F.count("*").alias("n"))
    title = assemble.book_title(F.lit(None).cast("string"), F.concat(F.lit("Conversation_"), F.col("book_id").cast("string")))
    rows = assemble.assemble(turns).join(n, "book_id")
    return rows.select("book_id", F.md5(F.concat(assemble.header(title, F.lit(1), F.col("n"), F.col("n")), "text")).alias("text_md5"))


def _jobs(spark, d):
    """conv_id, total, checkpoint, progress: state files as a run would leave them, every fifth broken."""
    turns = table(spark, d, "conversations")
    books = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("total"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    stored = F.slice("t", F.lit(1), F.floor(F.col("total") * (F.col("conv_id") % 4) / 3).cast("int"))
    state_ = F.struct(F.map_from_entries(F.transform(stored, lambda x, i: F.struct(i.cast("string"), x["text"]))).alias("chunks"), (F.size(stored) - 1).alias("last_chunk"))
    broken = F.col("conv_id") % 5 == 4
    return books.select(
        "conv_id", "total", F.when(broken, '{"chunks": {"0"').otherwise(F.to_json(state_)).alias("checkpoint"),
        F.when(broken, "{").otherwise(F.to_json(F.struct(F.size(stored).alias("done"), F.col("total")))).alias("progress"),
    )


JOBS = """j AS (SELECT conv_id, total, CASE WHEN conv_id % 5 = 4 THEN 0 ELSE least(total, CAST(floor(total * (conv_id % 4) / 3) AS BIGINT)) END AS done FROM (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id))"""


@query("checkpoint_read", f"WITH {JOBS}, t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS chunk_id, text FROM conversations) SELECT conv_id AS book_id, CAST(chunk_id AS INTEGER) AS chunk_id, md5(text) AS text_md5 FROM t JOIN j USING (conv_id) WHERE chunk_id < done")
def checkpoint_read(spark, d):
    states = _jobs(spark, d).select(F.col("conv_id").alias("book_id"), "total", state.parse_checkpoint(F.col("checkpoint")).alias("state"))
    return state.checkpoint_chunks(states).select("book_id", "chunk_id", F.md5("text").alias("text_md5"))


@query("progress_read", f"WITH {JOBS} SELECT conv_id AS book_id, done, CASE WHEN conv_id % 5 = 4 THEN 0 ELSE total END AS total FROM j")
def progress_read(spark, d):
    return _jobs(spark, d).select(F.col("conv_id").alias("book_id"), state.parse_progress(F.col("progress")).alias("p")).select("book_id", "p.done", "p.total")


@query(
    "job_status",
    f"""WITH {JOBS}, s AS (SELECT conv_id AS book_id, done, total, CASE WHEN conv_id % 6 = 0 THEN 'running' WHEN total > 0 AND done >= total THEN 'done' ELSE 'idle' END AS status, conv_id FROM j)
SELECT book_id, done, total, status, CASE WHEN status IN ('running', 'done') THEN status WHEN done > 0 THEN 'paused' ELSE 'waiting' END AS label,
  done > 0 AS can_read, status = 'done' AS can_export, conv_id % 2 = 0 AND status <> 'running' AS can_restart FROM s""",
)
def job_status(spark, d):
    stored = checkpoint_read(spark, d)
    totals = _jobs(spark, d).select(F.col("conv_id").alias("book_id"), F.col("total").cast("long").alias("total"))
    rows = totals.join(metrics.progress(stored), "book_id", "left").select("book_id", F.coalesce("done", F.lit(0).cast("long")).alias("done"), "total")
    rows = rows.withColumn("status", metrics.status(F.col("book_id") % 6 == 0, F.col("done"), F.col("total")))
    path = F.when(F.col("book_id") % 2 == 0, F.lit("book.pdf"))
    acts = metrics.actions(F.col("status"), F.col("done"), path)
    return rows.select("book_id", "done", "total", "status", metrics.label(F.col("status"), F.col("done")).alias("label"), acts.alias("a")).select("*", "a.*").drop("a")


@query(
    "eta",
    """WITH t AS (SELECT conv_id, turn, length(text) / 8.0 AS seconds FROM conversations WHERE text IS NOT NULL),
l AS (SELECT conv_id, max({'c': turn, 's': seconds}) AS m FROM t WHERE turn % 3 <> 2 GROUP BY conv_id),
n AS (SELECT conv_id, max(turn) + 1 + conv_id % 7 AS total FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, m, greatest(total - coalesce(m.c + 1, 0), 0) AS remaining FROM n LEFT JOIN l USING (conv_id))
SELECT conv_id AS book_id, CAST(remaining AS BIGINT) AS remaining, CAST(floor(remaining * m.s / 60) AS BIGINT) AS eta_minutes FROM r""",
)
def eta(spark, d):
    turns = table(spark, d, "conversations")
    timed = turns.filter("text IS NOT NULL AND turn % 3 <> 2").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chunk_id"), (F.length("text") / F.lit(8.0)).alias("seconds"))
    totals = turns.groupBy(F.col("conv_id").alias("book_id")).agg(F.max("turn").alias("last")).select("book_id", (F.col("last") + 1 + F.col("book_id") % 7).alias("total"))
    return metrics.eta(timed, totals)


@query("progress_pct", f"WITH {JOBS} SELECT conv_id AS book_id, CASE WHEN total > 0 THEN least(CAST(floor(done * 100.0 / total + 0.5) AS BIGINT), 100) ELSE 0 END AS pct FROM j")
def progress_pct(spark, d):
    stored = metrics.progress(checkpoint_read(spark, d))
    rows = _jobs(spark, d).select(F.col("conv_id").alias("book_id"), "total").join(stored, "book_id", "left")
    return rows.select("book_id", metrics.percent(F.coalesce("done", F.lit(0)), F.col("total")).alias("pct"))


@query("resume_pending", f"WITH {JOBS}, t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_id FROM conversations) SELECT conv_id AS book_id, CAST(chunk_id AS INTEGER) AS chunk_id FROM t JOIN j USING (conv_id) WHERE chunk_id >= done")
def resume_pending(spark, d):
    number = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("chunk_id")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), number)
    return translate.pending(turns, checkpoint_read(spark, d))


@query("log_tail", "SELECT doc_id, length(right(coalesce(text, ''), 4000)) AS n_chars, md5(right(coalesce(text, ''), 4000)) AS tail_md5 FROM documents")
def log_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", metrics.log_tail(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("tail_md5"))


FILES = "f AS (SELECT doc_id, replace(text, ' ', CASE WHEN doc_id % 2 = 0 THEN '_' ELSE ' ' END) || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN ' (1).pdf' ELSE '' END AS name FROM documents)"


def _files(spark, d):
    name = F.replace("text", F.lit(" "), F.when(F.col("doc_id") % 2 == 0, "_").otherwise(" "))
    return table(spark, d, "documents").select("doc_id", F.concat(name, F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, " (1).pdf").otherwise("")).alias("name"))


@query("slug", f"WITH {FILES} SELECT doc_id, replace(substr(name, 1, 40), ' ', '_') || '.epub' AS slug FROM f")
def slug(spark, d):
    return _files(spark, d).select("doc_id", F.concat(metrics.slug(F.col("name")), F.lit(".epub")).alias("slug"))


@query("file_title", f"WITH {FILES} SELECT doc_id, trim(regexp_replace(replace(regexp_replace(name, '^(.*?)\\.pdf', '\\1'), '_', ' '), '\\s*\\(\\d+\\)\\s*$', '')) AS title FROM f")
def file_title(spark, d):
    return _files(spark, d).select("doc_id", metrics.title_of_file(F.col("name")).alias("title"))


@query(
    "image_urls",
    "SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, '![a b](/data/$1/' || doc_id || '/images/p.png) ' || text || '![](/data/$1/' || doc_id || '/images/q.png)' AS t FROM documents)",
)
def image_urls(spark, d):
    text = F.concat(F.lit("![a b](images/p.png) "), F.col("text"), F.lit("![](images/q.png)"))
    prefix = F.concat(F.lit("/data/$1/"), F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", metrics.rewrite_images(text, prefix).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query("word_count", f"SELECT doc_id, CAST({s_words('text')} AS BIGINT) AS n_words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", count_words(F.col("text")).cast("long").alias("n_words"))


# ---- whole transformations
TEXTS = "t AS (SELECT doc_id AS book_id, text FROM documents WHERE doc_id IS NOT NULL)"


@query(
    "translate_identity",
    f"""WITH {TEXTS}, c AS (SELECT book_id, text, {s_strip('text')} <> '' AS prose, {S_CLEAN} AS out FROM t)
SELECT book_id, CASE WHEN prose THEN md5(out) ELSE md5(text) END AS out_md5, CASE WHEN prose AND {s_words('text')} > 0 AND {s_words('out')} > {s_words('text')} * 2.5 THEN 'length' END AS flag FROM c""",
)
def translate_identity(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.lit(0).alias("chunk_id"), "text")
    return translate.transform_chunks(rows).select("book_id", F.md5("translated").alias("out_md5"), "flag")


@query("translate_glossary")
def translate_glossary(spark, d):
    terms_ = F.array(*[F.lit(k) for k in GLOSSARY])
    text = F.concat(F.get(terms_, (F.col("doc_id") % len(GLOSSARY)).cast("int")), F.lit(" and coupling: "), F.col("text"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.lit(0).alias("chunk_id"), text.alias("text"))
    return translate.transform_chunks(rows, backends.glossary).select("book_id", F.md5("translated").alias("out_md5"), "flag")


@query(
    "translate_in_order",
    f"""WITH t AS (SELECT conv_id AS book_id, turn AS chunk_id, text FROM conversations), c AS (SELECT book_id, chunk_id, text, {s_strip('text')} <> '' AS prose, {S_CLEAN} AS clean FROM t),
a AS (SELECT *, CASE WHEN prose THEN clean ELSE text END AS answer FROM c), p AS (SELECT *, lag(answer) OVER (PARTITION BY book_id ORDER BY chunk_id) AS prev FROM a)
SELECT book_id, chunk_id, md5(answer) AS out_md5, CASE WHEN prose THEN md5({q(SYSTEM_PROMPT)} || chr(10) || chr(10) || CASE WHEN {s_strip('prev')} <> '' THEN {q(CONTEXT_LABEL)} || chr(10) || right(prev, 400) || chr(10) || chr(10) ELSE '' END
  || {q(SOURCE_LABEL)} || chr(10) || text || chr(10) || chr(10) || {q(ANSWER_LABEL)}) END AS prompt_md5 FROM p""",
)
def translate_in_order(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chunk_id"), "text")
    return translate.translate_in_order(rows, shared_folder(spark)).select("book_id", "chunk_id", F.md5("answer").alias("out_md5"), F.md5("prompt").alias("prompt_md5"))
