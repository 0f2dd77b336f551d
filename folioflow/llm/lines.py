"""Line deduplication: an exact set-similarity join with prefix, positional and length filters.

A line's tokens are its distinct 5-word shingles (a shorter line is one shingle); lines match at a
Jaccard similarity of 0.8. The tokens of every line are ordered by rarity: first by the count of their
rarest word, counted over all texts in ``BUCKETS`` hash buckets, then by their hash. Two matching lines
share a token among the first n - ceil(0.8 n) + 1 of each, and at their first common token what is left
must still reach the needed overlap; lengths must agree within 0.8. Beside that each line has a parity
signature (bit k: whether an odd number of its tokens fall on k), whose differing bits cannot outnumber
the tokens that only one of the lines has. What passes is verified on the whole token sets. A line goes
if it matches an earlier one, in the order of doc_id, text hash and line number.

Only the existence of an earlier match is asked for, never all pairs. First every line meets the earliest
line of each of its tokens: one candidate a posting, whatever the size of the group. Lines that match
there are settled: they stay as witnesses but ask no more. Only what is left meets all earlier lines.

Scale: equal lines are one class throughout, kept by its first occurrence and counted map-side; a line
that is over 1 / COMMON of the repeated ones speaks only once, so a line of a third of all documents is
one row of the join. Only prefixes are shuffled, once, never all shingles, and tokens of one line only go
no further; frequent shingles stand behind the prefixes because their words' counts are high. Candidates
fetch their texts by a join on the document. Tables of line ids and of removed lines are broadcast if they
were measured to be small; beyond that the joins go by shuffle. The rarity table has BUCKETS rows and that
of common lines COMMON at most, at any size.

Native: DataFrame functions only. Tokens are 60-bit: 4 bits of rarity, 56 of hash. Lines are one class if
their 64-bit hashes agree and they share a token, or if 128 bits agree.

Defined cases: lines without a word are never removed; null texts stay null; rows that repeat doc_id and
text are one document listed again and keep the same lines; a null doc_id comes last; an empty table
gives no rows; extra columns are carried, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, broadcast_if_small, cut, let, pieces, scratch, table, words

SHINGLE = 5
NEED, OF = 4, 5  # the similarity as a fraction
BUCKETS = 65536
COMMON = 20000
_TOP = 0xF << 56
_LOW = (1 << 56) - 1
_LAST = (1 << 63) - 1  # stands for a null doc_id


def rarity(docs: DataFrame, text: str = "text") -> Column:
    """A constant array: a class for each bucket of word hashes, from 0 (rare) to 15: the count of the bucket's words
    in half octaves about the median of all buckets."""
    bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")
    counted = docs.select(F.explode_outer(pieces(F.col(text))).alias("w")).filter("w <> ''").groupBy(bucket).count().toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS)
    counts[counted["b"].to_numpy()] = counted["count"].to_numpy()
    octaves = np.log2(np.maximum(counts, 1) / max(1.0, float(np.median(counts))))
    classes = np.clip(np.floor(2 * octaves) + 4, 0, 15).astype(int)
    return F.from_json(F.lit(json.dumps(classes.tolist(), separators=(",", ":"))), "array<bigint>")


def _hashes(line: Column) -> Column:
    return F.transform(words(line), lambda x: F.xxhash64(x))


def tokens(line: Column, classes: Column) -> Column:
    """The distinct tokens of a line, the rarest first: the rarest class of the words of each shingle, and a hash of them."""

    def marked(h: Column) -> Column:
        own = F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(own, 56).bitwiseOR(h.bitwiseAND(F.lit(_LOW)))

    def token(five: list[Column]) -> Column:
        return F.least(*five).bitwiseAND(F.lit(_TOP)).bitwiseOR(F.xxhash64(*five).bitwiseAND(F.lit(_LOW)))

    return F.sort_array(F.array_distinct(let(F.transform(_hashes(line), marked), lambda m: _shingles(m, token))))


def plain_tokens(line: Column) -> Column:
    """The distinct shingles of a line as hashes, in the order of the line: all that a comparison of whole sets needs."""
    return F.array_distinct(let(_hashes(line), lambda m: _shingles(m, lambda five: F.xxhash64(*five))))


def _shingles(m: Column, token: Callable[[list[Column]], Column]) -> Column:
    """``token`` of each ``SHINGLE`` values in a row. Places past the end are null and count for nothing."""
    at = lambda x, i: F.coalesce(token([x, *[F.get(m, i + k) for k in range(1, SHINGLE)]]), F.lit(0).cast("long"))
    return F.transform(F.slice(m, F.lit(1), F.greatest(F.size(m) - (SHINGLE - 1), F.lit(1))), at)


def _bit(token: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), token.bitwiseAND(F.lit(63)).cast("int"))


def parity(t: Column) -> Column:
    """64 bits: whether an odd number of the tokens fall on each."""
    return F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(_bit(x)))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, hash, pos, line, id and id2 of every line with a word; docs: doc_id, hash, text."""
    rows = docs.select("doc_id", "hash", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter(F.col("line").rlike(WORD)).withColumns({"id": F.xxhash64("line"), "id2": F.xxhash64(F.lit("second"), "line")})


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("hash").alias("hash"), F.col("pos").alias("pos"))


def _repeated(docs: DataFrame) -> DataFrame:
    """id, id2, first and times of the lines that occur more than once."""
    return cut(_lines(docs).groupBy("id", "id2").agg(F.min(_order()).alias("first"), F.count("*").alias("times")).filter("times > 1"))


def _postings(docs: DataFrame, repeated: DataFrame, classes: Column) -> DataFrame:
    """token, id, doc, n, i, sig of the prefixes, of tokens that more than one line has, and head: the token's
    earliest line.

    Lines that make up over 1 / COMMON of the repeated ones, COMMON at most, speak through their first
    occurrence only, so no token is hot by copies; the rest of the copies meet in their token's partition.
    """
    total = repeated.agg(F.sum("times")).first()[0] or 0
    common = repeated.filter(F.col("times") > total / COMMON).select(F.col("id").alias("c"), F.col("id2").alias("c2"), "first")
    heard = _lines(docs).join(F.broadcast(common), (F.col("id") == F.col("c")) & (F.col("id2") == F.col("c2")), "left")
    heard = heard.filter(F.col("c").isNull() | (_order() == F.col("first")))
    tokened = heard.select("id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), tokens(F.col("line"), classes).alias("t"))
    size = F.size("t")
    prefix = F.slice("t", F.lit(1), size - F.floor((NEED * size + OF - 1) / OF).cast("int") + 1)
    signed = tokened.select("id", "doc", parity(F.col("t")).alias("sig"), size.alias("n"), prefix.alias("p"))
    dealt = signed.select("id", "doc", "sig", "n", F.posexplode_outer("p").alias("i", "token")).repartition("token")
    one = Window.partitionBy("token")
    shared = dealt.withColumns({"low": F.min("id").over(one), "high": F.max("id").over(one)}).filter("low <> high")
    classed = shared.groupBy("token", "id", "n", "i", "sig").agg(F.min("doc").alias("doc"))
    return cut(classed.withColumn("head", F.min(F.struct("doc", "id", "n", "i", "sig")).over(one)))


def _near(a: str, b: str) -> Column:
    """The length, positional and parity filters of two postings of one token."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.i"), m - F.col(f"{b}.i"))
    differ = F.bit_count(F.col(f"{a}.sig").bitwiseXOR(F.col(f"{b}.sig")))
    return (OF * F.least(n, m) >= NEED * F.greatest(n, m)) & ((NEED + OF) * rest >= NEED * (n + m)) & ((NEED + OF) * differ <= (OF - NEED) * (n + m))


def _with_heads(postings: DataFrame) -> DataFrame:
    """a, b, a_doc, b_doc: each line with the earliest line of each of its tokens."""
    pairs = postings.alias("b").filter((F.col("b.head.id") != F.col("b.id")) & _near("b.head", "b"))
    return pairs.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.doc").alias("a_doc"), F.col("doc").alias("b_doc")).distinct()


def _with_all(asking: DataFrame, postings: DataFrame, done: DataFrame, more: Column | None = None) -> DataFrame:
    """a, b, a_doc, b_doc: each posting of ``asking`` with all lines of its token that come before it, but the pairs in ``done``."""
    a, b = postings.alias("a"), asking.alias("b")
    fresh = (F.col("a.token") == F.col("b.token")) & (F.col("a.id") != F.col("b.id")) & (F.col("a.id") != F.col("b.head.id")) & (F.col("a.doc") <= F.col("b.doc"))
    if more is not None:
        fresh = fresh & more
    pairs = a.join(b, fresh & _near("a", "b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.doc").alias("a_doc"), F.col("b.doc").alias("b_doc"))
    return pairs.distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")


def _verified(docs: DataFrame, pairs: DataFrame, wide: int) -> DataFrame:
    """a, b, a_line, b_line (structs of order, id and id2) of the pairs (a written table) that match.

    The token sets of all lines asked for are written where they are found; what meets first are parity
    signatures of ``wide`` x 64 bits, and only pairs that these don't rule out meet with their token sets.
    """
    with scratch() as keep:
        end = lambda s: F.struct(F.col(s).alias("q"), F.col(f"{s}_doc").alias("doc"))
        asked = cut(pairs.select(F.explode(F.array(end("a"), end("b"))).alias("x")).select("x.*").distinct())
        asked = broadcast_if_small(asked, 64)
        doc = F.coalesce("doc_id", F.lit(_LAST))
        near = docs.join(asked.select(F.col("doc").alias("d")), doc == F.col("d"), "left_semi")
        found = _lines(near).withColumn("d", doc).join(asked, (F.col("id") == F.col("q")) & (F.col("d") == F.col("doc")))
        line = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "pos", "id", "id2").alias("line")
        found = cut(found.select(F.monotonically_increasing_id().alias("row"), "id", "doc", line, plain_tokens(F.col("line")).alias("t")))

        row = ["row", "id", "doc", "line"]
        word = F.pmod(F.shiftright("x", 6), F.lit(wide)).cast("int").alias("w")
        words_ = found.select(*row, F.size("t").alias("n"), F.explode("t").alias("x")).groupBy(*row, "n", word).agg(F.bit_xor(_bit(F.col("x"))).alias("bits"))
        once = words_.groupBy("id", "doc", "w").agg(F.min("bits").alias("bits"), F.min("line").alias("line"), F.min("n").alias("n"))  # alike in all rows of an id
        first = once.groupBy("id", "doc").agg(F.min("line").alias("line"), F.min("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
        sig = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long")))
        signed = cut(first.select("id", "doc", "line", "n", sig.alias("sig")))
        signed = broadcast_if_small(signed, 144 + 8 * wide)
        side = lambda s: signed.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("doc", "line", "n", "sig")])
        differ = F.aggregate(F.zip_with("a_sig", "b_sig", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        left = pairs.join(side("a"), ["a", "a_doc"]).join(side("b"), ["b", "b_doc"]).filter((NEED + OF) * differ <= (OF - NEED) * (F.col("a_n") + F.col("b_n")))
        left = cut(left.select("a", "b", "a_line", "b_line"))

        at = F.explode(F.array(F.struct(F.col("a").alias("q"), F.col("a_line").alias("l")), F.struct(F.col("b").alias("q"), F.col("b_line").alias("l"))))
        wanted = broadcast_if_small(left, 224).select(at.alias("x")).select("x.*")
        sets = cut(found.select("id", "line", "t").join(wanted, (F.col("id") == F.col("q")) & (F.col("line") == F.col("l")), "left_semi").groupBy("id", "line").agg(F.min("t").alias("t")))
        whole = lambda s: sets.select(F.col("id").alias(s), F.col("line").alias(f"{s}_line"), F.col("t").alias(f"{s}_t"))
        overlap = F.size(F.array_intersect("a_t", "b_t"))
        both = left.join(whole("a"), ["a", "a_line"]).join(whole("b"), ["b", "b_line"])
        return keep(cut(both.filter((NEED + OF) * overlap >= NEED * (F.size("a_t") + F.size("b_t"))).select("a", "b", "a_line", "b_line")))


def _started(docs: DataFrame, wide: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The repeated lines, the postings, the pairs with heads and those that match."""
    repeated = _repeated(docs)
    postings = _postings(docs, repeated, rarity(docs))
    pairs = cut(_with_heads(postings))
    return repeated, postings, pairs, _verified(docs, pairs, wide)


def links(docs: DataFrame, wide: int = 32) -> DataFrame:
    """a, b: matches among line ids that join all lines which a chain of matches joins; docs: doc_id, hash, text.
    ``wide``: the words of a line's signature.

    Lines that match the same earliest line hang together by it and are not compared again, so a group of
    copies costs a star of links; every match between lines that don't is found.
    """
    with scratch() as keep:
        _, postings, pairs, stars = _started(docs, wide)
        edges = stars.select("a", "b")
        roots = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))  # b was compared with the earliest line a
        named = postings.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        rest = cut(_with_all(named, named, pairs, F.col("a.root") != F.col("b.root")))
        return keep(cut(edges.unionByName(_verified(docs, rest, wide).select("a", "b"))))


def _late(matches: DataFrame) -> DataFrame:
    """id, id2 of the later line of each pair."""
    return matches.select(F.when(F.col("a_line") < F.col("b_line"), F.col("b_line")).otherwise(F.col("a_line")).alias("x")).select("x.id", "x.id2").distinct()


def removals(docs: DataFrame, wide: int = 4) -> DataFrame:
    """doc_id, hash and removed (line numbers) of the documents that lose lines, a written table; docs: doc_id, hash, text.
    ``wide``: the words of a line's signature."""
    with scratch() as keep:
        repeated, postings, pairs, stars = _started(docs, wide)
        settled = cut(_late(stars))
        asking = postings.join(broadcast_if_small(settled, 64).select("id"), "id", "left_anti")
        late = settled.unionByName(_late(_verified(docs, cut(_with_all(asking, postings, pairs)), wide)))

        none = F.lit(None).cast(repeated.schema["first"].dataType)
        both = repeated.select("id", "id2", "first", F.lit(False).alias("late")).unionByName(late.select("id", "id2", none.alias("first"), F.lit(True).alias("late")))
        judged = broadcast_if_small(cut(both.groupBy("id", "id2").agg(F.max("first").alias("first"), F.max("late").alias("late"))), 112)
        gone = _lines(docs).drop("line").join(judged, ["id", "id2"]).filter(F.col("late") | (_order() != F.col("first")))
        return keep(cut(gone.groupBy("doc_id", "hash").agg(F.collect_set("pos").alias("removed"))))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with the matching lines taken out of ``text``, and two int columns of the given names: how
    many lines the text had and lost. A column of ``docs`` that has one of these names gives way to it."""
    rest = [c for c in docs.columns if c not in (key, text, n_lines, n_removed)]
    slim = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"), F.struct(F.lit(0).alias("__pad"), *rest).alias("rest"))
    gone = broadcast_if_small(removals(slim.select("doc_id", "hash", "text")), 80 + 4 * F.size("removed")).select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "removed")
    joined = slim.join(gone, slim["doc_id"].eqNullSafe(gone["d"]) & (slim["hash"] == gone["h"]), "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    left = F.element_at(F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")), 1)
    now = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    columns = {key: F.col("doc_id"), text: now} | {c: F.col("rest").getField(c) for c in rest}
    return joined.select(
        *[columns[c].alias(c) for c in docs.columns if c in columns], F.coalesce(F.size(lines), F.lit(0)).alias(n_lines), F.coalesce(F.size("removed"), F.lit(0)).alias(n_removed)
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row of ``documents``."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP9_SQL = r"""
WITH l AS (SELECT doc_id, p - 1 AS pos, string_split(text, chr(10))[p] AS line
           FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
k AS (SELECT doc_id, pos, array_to_string(ws, ' ') AS k, ws FROM w WHERE len(ws) > 0),
c AS (SELECT k, any_value(ws) AS ws, min({'d': doc_id, 'p': pos}) AS f FROM k GROUP BY k),
s AS (SELECT DISTINCT k, CASE WHEN len(ws) < 5 THEN k ELSE array_to_string(ws[i:i + 4], ' ') END AS t
      FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM c)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
o AS (SELECT a.k AS a, b.k AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.k < b.k GROUP BY ALL),
late AS (SELECT DISTINCT CASE WHEN ca.f < cb.f THEN b ELSE a END AS k
         FROM o JOIN n na ON na.k = a JOIN n nb ON nb.k = b JOIN c ca ON ca.k = a JOIN c cb ON cb.k = b WHERE 9 * o >= 4 * (na.n + nb.n)),
gone AS (SELECT k.doc_id, k.pos FROM k JOIN c USING (k) WHERE c.f <> {'d': k.doc_id, 'p': k.pos} OR k.k IN (SELECT k FROM late)),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text
FROM documents d LEFT JOIN r USING (doc_id)
"""
