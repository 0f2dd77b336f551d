"""Quality rules: word statistics of every text, then a hashed n-gram log-likelihood ratio.

The method compares two multinomials over hashed word 1- and 2-grams (``BUCKETS`` buckets each): the
trusted target (documents labelled quality 1, not toxic) and the raw corpus (all documents). A
document's verdict is the mean over its n-grams of log((t + PRIOR) / (e + PRIOR)), t being the
target's count of the bucket and e the count the raw corpus would lead one to expect; it is kept
from ``THRESHOLD`` on. The pseudo-counts make unseen and rare buckets neutral, so a clean text of
rare words is not held against it.

Native and without Python. Pass one counts buckets with map-side sums (at most 2 * BUCKETS rows a
task); pass two scans the texts again and looks the n-grams up in the table of ratios (a broadcast of
2 * BUCKETS rows, whatever the corpus), summing per document before the one shuffle, which carries a
row a document. The trusted ids are a bounded sample of at most ``TRUSTED`` labelled rows, the lowest
by hash; all else covers every document.

Defined cases: a null text has no words and fails the base rules; with no trusted document every
ratio is 0 and the base rules decide; repeated rows are judged one by one; the words' order of ties
plays no part; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import GAP, WORD, cut, let, table, text_or_empty, words

BUCKETS = 65536
TRUSTED = 20000
PRIOR = 5.0
THRESHOLD = -0.25
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_P = "__rule_"


def _ngrams(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per word of ``docs`` (at least one a document) with the buckets of the 1-gram and of the 2-gram that begin there."""
    w = F.col(f"{_P}words")
    pairs = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"))
    rows = docs.select(*keep, F.explode_outer(pairs).alias("g")).select(*keep, F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    return rows.select(
        *keep,
        F.when(F.col("a").isNotNull(), F.pmod(F.xxhash64("a"), F.lit(BUCKETS))).alias("one"),
        F.when(F.col("b").isNotNull(), F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)) + BUCKETS).alias("two"),
    )


def trusted_ids(labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    good = good.filter("doc_id IS NOT NULL AND q = 1 AND x = 0").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def ratios(docs: DataFrame, labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """bucket and llr of every bucket that the corpus uses: at most 2 * BUCKETS rows."""
    trusted = cut(trusted_ids(labels, bound).withColumn("t", F.lit(1)))
    marked = docs.select("doc_id", words(text_or_empty()).alias(f"{_P}words")).join(F.broadcast(trusted), "doc_id", "left")
    both = _ngrams(marked, "t").select("t", F.explode(F.array("one", "two")).alias("bucket")).filter("bucket IS NOT NULL")
    counts = both.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("t").alias("target"))
    part = Window.partitionBy(F.col("bucket") >= BUCKETS)
    expected = F.sum("target").over(part) * (F.col("raw") / F.sum("raw").over(part))
    return counts.select("bucket", F.log((F.col("target") + PRIOR) / (expected + PRIOR)).alias("llr"))


def _windows(h: Column) -> Column:
    """A hash of each ``WINDOW`` = 8 hashes in a row, by doubling: of 2, of 4, of 8."""

    def double(x: Column, by: int) -> Column:
        n = F.size(x) - by
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))

    return let(double(h, 1), lambda two: let(double(two, 2), lambda four: double(four, 4)))


def _statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with words and the base columns."""
    t = text_or_empty()
    w = F.col(f"{_P}words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    first = docs.withColumns({
        f"{_P}words": words(t),
        "word_chars": F.length(F.regexp_replace(t, GAP, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        f"{_P}lines": lines,
    })
    hashed = first.withColumns({
        "n_words": F.size(w).cast("long"),
        "n_dup_lines": (F.size(f"{_P}lines") - F.size(F.array_distinct(f"{_P}lines"))).cast("long"),
        f"{_P}h": F.transform(w, lambda x: F.xxhash64(x)),
    })
    h = F.col(f"{_P}h")
    windows = hashed.withColumn(
        f"{_P}win",
        F.when(F.size(h) > WINDOW, _windows(h)),
    )
    win = F.col(f"{_P}win")
    ordered = windows.withColumn(
        f"{_P}sorted",
        F.when(F.size(F.array_distinct(win)) < F.size(win), F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    s = F.col(f"{_P}sorted")
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))

    def cover(state: Column, p: Column) -> Column:
        return F.struct((p + WINDOW).alias("upto"), (state["n"] + p + WINDOW - F.greatest(state["upto"], p)).alias("n"))

    covered = F.aggregate(places, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), cover)["n"]
    return ordered.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, table_of_ratios: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, llr (mean per n-gram) and kept of every row."""
    rows = _statistics(docs.select("doc_id", "text").withColumn(f"{_P}id", F.monotonically_increasing_id()))
    keys = [f"{_P}id", "doc_id", *BASE]
    # at most 2 * BUCKETS rows; in whole millionths, so that sums are exact in any order and cheap
    table_ = F.broadcast(table_of_ratios.select("bucket", F.round(F.col("llr") * 1_000_000).cast("long").alias("llr")))
    looked = (
        _ngrams(rows, *keys)
        .join(table_.select(F.col("bucket").alias("one"), F.col("llr").alias("llr1")), "one", "left")
        .join(table_.select(F.col("bucket").alias("two"), F.col("llr").alias("llr2")), "two", "left")
    )
    total = F.coalesce("llr1", F.lit(0).cast("long")) + F.coalesce("llr2", F.lit(0).cast("long"))
    scored = looked.groupBy(*keys).agg(F.sum(total).alias("sum"), (F.count("one") + F.count("two")).alias("n"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    llr = F.when(F.col("n") > 0, F.col("sum") / 1e6 / F.col("n")).otherwise(0.0)
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), llr.alias("llr")).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' columns, the ratio and the verdict of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, cut(ratios(docs, table(spark, sf_dir, "labels"))))
