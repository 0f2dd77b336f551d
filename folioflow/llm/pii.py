"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

Base kinds (email, ip, card, phone) are kept whenever their validator passes, whatever their score.
Added kinds (iban, ssn, local_phone, secret) need a score of ``ACCEPT`` and must not overlap a base
span. Offsets count code points, ends are exclusive.

Native: one scan, one projection, no shuffle. Spark gives a pattern's matches but not their places,
so a place is the running length of the pieces between matches (``split``) and of the matches. The
patterns are rewritten so that a long run of letters or digits costs linear time and no recursion:
possessive loops, and a local part may only begin where a run begins or the last match ended.

Defined cases: a null or empty text has no spans; repeated rows give repeated results; matches that
a validator rejects are dropped and not searched again; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.pytext import scan
from folioflow.llm.common import let, table, text_or_empty

ACCEPT = 0.5
CONTEXT = 40  # code points before a span that are searched for context words
NEAR = 20  # matches before a span that may reach into them: none is shorter than two code points
BASE = ("email", "ip", "card", "phone")
_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: The length of an account number without spaces, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

#: kind: (guard that any text with a match fulfils, pattern, pattern as the contract has it, score without context, context words)
KINDS = {
    "email": (
        "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9, "mail|contact|write|reach"),
    "ip": (
        r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 0.6, "ip|host|server|address|login|from"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9]){13}",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9])+", 0.8, "card|visa|master|amex|credit|debit|pay"),
    "phone": (
        r"\+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "tel|phone|call|mobile|fax"),
    "iban": (
        r"[A-Z]{2}[0-9]{2}", _IBAN + r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", 0.6, "iban|account|bank|konto|cuenta|compte"),
    "ssn": (
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social|security|tax"),
    "local_phone": (
        r"[0-9]{3}[ .-][0-9]{4}", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
        r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", 0.3, "tel|phone|call|mobile|fax"),
    "secret": (
        r"[0-9a-f]{32}", r"[0-9a-f]{32,}",
        r"[0-9a-f]{32,}", 0.3, "token|key|secret|password"),
}
BOOST = 0.3
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string,score:double>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 when divided by 97 (letters count from 10)."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), rest * 10 + c.try_cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _valid(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind == "ip":
        return found.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[a-f]")
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind, with their scores, in order."""
    guard, pattern, _, score, words = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def confirmed(gaps: Column, found: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("n")))
        ends = scan(pairs, F.lit(0), lambda at, x: at + x["n"], lambda at: at, "int")
        placed = F.zip_with(F.transform(ends, lambda e, i: F.struct(e.alias("end"), i.alias("i"))), found, lambda x, m: F.struct((x["end"] - F.length(m)).alias("start"), x["end"].alias("end"), x["i"].alias("i"), m.alias("text")))
        return F.transform(F.filter(placed, lambda x: _valid(kind, x["text"])), lambda x: scored(gaps, found, x))

    def scored(gaps: Column, found: Column, x: Column) -> Column:
        # the last CONTEXT characters before a span, from the pieces before it: a piece of the text by its
        # place would have to be counted off from the text's beginning each time
        first = F.greatest(x["i"] - NEAR, F.lit(0))
        near = F.zip_with(F.slice(gaps, first + 1, x["i"] - first), F.slice(found, first + 1, x["i"] - first), lambda g, m: F.concat(g, m))
        before = F.lower(F.right(F.concat(F.array_join(near, ""), F.get(gaps, x["i"])), F.lit(CONTEXT)))
        total = F.lit(score) + F.when(before.rlike(words), BOOST).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"),
            x["text"].alias("text"), F.least(total, F.lit(1.0)).alias("score"),
        )

    spans = let(matches, lambda found: let(gaps, lambda g: confirmed(g, found)))
    return F.when(text.rlike(guard), spans).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pii_base and pii: arrays of (start, rank, end, kind, text, score) by start, then kind."""
    t = text_or_empty(text)
    nothing = F.expr(f"cast(array() as {_SPAN})")
    numeric = t.rlike("[0-9]")  # every kind but email has a digit
    base = F.array_sort(F.concat(_spans("email", t), F.when(numeric, F.concat(*[_spans(k, t) for k in BASE[1:]])).otherwise(nothing)))
    with_base = docs.withColumn("pii_base", base)
    added = F.concat(*[_spans(k, t) for k in KINDS if k not in BASE])
    clear = F.filter(
        added,
        lambda a: (a["score"] >= ACCEPT) & ~F.exists(F.col("pii_base"), lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])),
    )
    return with_base.withColumn("pii", F.when(numeric, F.array_sort(F.concat(F.col("pii_base"), clear))).otherwise(F.col("pii_base")))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``pii`` replaced by its kind in brackets (overlaps: the first span wins)."""
    t = text_or_empty(text)

    def fresh(spans: Column) -> Column:
        """The spans that begin where the last one taken has ended."""
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("new"))
        step = lambda state, x: F.struct(F.when(x["start"] >= state["at"], x["end"]).otherwise(state["at"]).alias("at"), (x["start"] >= state["at"]).alias("new"))
        marked = F.zip_with(spans, scan(spans, start, step, lambda state: state["new"], "boolean"), lambda x, new: F.when(new, F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
        return F.filter(marked, lambda x: x.isNotNull())

    def pieces(spans: Column) -> Column:
        before = lambda i: F.coalesce(F.get(spans, i - 1)["e"], F.lit(0))
        parts = F.transform(spans, lambda x, i: F.concat(F.substr(t, before(i) + 1, x["s"] - before(i)), F.lit("["), F.upper(x["k"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substr(t, F.coalesce(F.element_at(spans, -1)["e"], F.lit(0)) + 1))

    clean = let(fresh(F.col("pii")), lambda spans: F.when(F.size(spans) > 0, pieces(spans)).otherwise(t))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), clean))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, the digest of the base spans and all spans of every row of ``documents``."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_base", "pii")
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans")
    )


def _kind_sql(kind: str) -> str:
    _, _, plain, score, words = KINDS[kind]
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum([CASE WHEN k % 2 = 1 THEN CAST(reverse({digits})[k] AS INT) ELSE list_sum([CAST(z AS INT) FOR z IN string_split(CAST(2 * CAST(reverse({digits})[k] AS INT) AS VARCHAR), '')]) END FOR k IN range(1, length({digits}) + 1)]) % 10 = 0"
    account = "replace(m, ' ', '')"
    valid = {
        "ip": "list_bool_and([length(ltrim(x, '0')) <= 3 AND (ltrim(x, '0') = '' OR CAST(substr(ltrim(x, '0'), 1, 4) AS INT) <= 255) FOR x IN string_split(m, '.')])",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn_sql}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split(substr({account}, 5) || substr({account}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1",
        "ssn": "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
        "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-f]')",
    }.get(kind, "true")
    return f"""
  SELECT rid, '{kind}' AS kind, {list(KINDS).index(kind)} AS rank, s, s + length(m) AS e,
         least(1.0, {score} + CASE WHEN regexp_matches(lower(substr(t, greatest(s + 1 - {CONTEXT}, 1), least(s, {CONTEXT}))), '{words}') THEN {BOOST} ELSE 0 END) AS score
  FROM (SELECT rid, t, ms[i] AS m, CAST(list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS BIGINT) AS s
        FROM (SELECT rid, t, ms, string_split_regex(t, '{plain}') AS gaps, unnest(range(1, len(ms) + 1)) AS i
              FROM (SELECT rid, t, regexp_extract_all(t, '{plain}') AS ms FROM d) WHERE len(ms) > 0))
  WHERE {valid}"""


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(_kind_sql(k) for k in KINDS)}),
b AS (SELECT * FROM a WHERE rank < 4),
x AS (SELECT * FROM b UNION ALL
      SELECT * FROM a WHERE rank >= 4 AND score >= {ACCEPT} AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = a.rid AND a.s < b.e AND b.s < a.e)),
n AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
             count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS j FROM b GROUP BY rid),
y AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS j FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(n.j, '')) AS base_sha256, coalesce(y.j, '') AS spans
FROM d LEFT JOIN n USING (rid) LEFT JOIN y USING (rid)
"""
