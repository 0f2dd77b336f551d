"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled queue. Its virtual finish time is the number
of its source's words up to and including it, divided by the source's target; a source that must
give more words than it has is queued again (up to ``MAX_EPOCHS`` times). The mix is the global
order of virtual finish times, cut where the total budget is reached.

Scale: all sums are taken by two-level prefix sums. A queue is split into ``BUCKETS`` hash ranges, so
a source with a third of all rows is spread over thousands of groups; the per-bucket sums (at most
``BUCKETS`` rows a source) give each bucket its offset. The global order is cut through a histogram
of at most ``BINS`` virtual-time bins; only the one bin in which the budget runs out is ordered row
by row. No window ranges over more than one bucket, one bin or the table of sources.

Defined cases: a null text has size 0; null is a source of its own, last in order; repeated rows are
separate documents with places of their own; ties in the shuffle key are ordered by size; an empty
table gives no rows; documents of size 0 are never taken more than zero words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut, n_words, table, text_or_empty

MAX_EPOCHS = 3
BUCKETS = 4096  # three hex digits of the shuffle key
BINS = 16384
_P = "__mix_"  # prefix of every internal column
MADE = ("mix_copy", "mix_finish", "mix_row", "source_size", "target", "mix_taken")


def source_targets(sums: DataFrame) -> DataFrame:
    """Targets of the sources in ``sums`` (src_null, src, source_size): weights 1, 2, 3 repeating in
    code-point order share the total; a target stops at MAX_EPOCHS times its source's size and the
    excess is reshared by weight. That fixed point is ``min(cap, level * weight)`` where the level is
    the largest of the levels reached when the sources of least cap / weight are filled first."""
    by_name = Window.orderBy(f"{_P}null", f"{_P}src")
    fill = Window.orderBy("ratio", f"{_P}null", f"{_P}src")
    everything = Window.partitionBy()
    return (
        sums.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("cap", MAX_EPOCHS * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", F.max((F.col("total") - F.col("filled")).cast("double") / F.col("open")).over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select(f"{_P}null", f"{_P}src", "source_size", "target", "total")
    )


def _bin(v: Column) -> Column:
    fine = F.floor(v * 1024)
    coarse = F.least(F.lit(8192) + F.floor(F.log2(v) * 64), F.lit(BINS - 1))
    return F.when(v < 8, fine).otherwise(coarse).cast("int")


def mix(docs: DataFrame, size: str, source: str = "source", key: str = "doc_id", truncate: bool = True) -> DataFrame:
    """The mix of ``docs`` as one row per taken copy, in the global order of virtual finish times.

    Columns: those of ``docs`` (but for ones of the names that follow) and mix_copy int, mix_finish double, mix_row string (names the input
    row), source_size long, target double, mix_taken boolean. With ``truncate=False`` the copies
    beyond the budget stay, with mix_taken false. ``size`` is a non-null long column of ``docs``.
    """
    given = [c for c in docs.columns if c not in MADE]
    size, key, own = f"{_P}size", f"{_P}key", (size, key)
    base = cut(
        docs.select(F.col(own[0]).alias(size), F.col(own[1]).alias(key), F.col(source), F.struct(F.lit(0).alias(f"{_P}pad"), *given).alias(f"{_P}row")).withColumns({
            f"{_P}null": F.col(source).isNull(),
            f"{_P}src": F.coalesce(F.col(source), F.lit("")),
            f"{_P}h": F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))),
        }).drop(source).withColumn(f"{_P}bucket", F.conv(F.substring(f"{_P}h", 1, 3), 16, 10).cast("int"))
    )
    group = [f"{_P}null", f"{_P}src", f"{_P}bucket"]
    sums = base.groupBy(*group).agg(F.sum(size).alias("bucket_size"))
    queue = Window.partitionBy(f"{_P}null", f"{_P}src").orderBy(f"{_P}bucket")
    per_source = source_targets(sums.groupBy(*group[:2]).agg(F.sum("bucket_size").alias("source_size")))
    offsets = cut(
        sums.withColumn(f"{_P}before", F.sum("bucket_size").over(queue) - F.col("bucket_size"))
        .join(per_source, group[:2])
        .select(*group, f"{_P}before", "source_size", "target", "total")
    )  # at most BUCKETS rows a source

    within = Window.partitionBy(*group).orderBy(f"{_P}h", size, key)
    placed = (
        base.join(offsets, group)
        .withColumn(f"{_P}cum", F.col(f"{_P}before") + F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(f"{_P}n", F.row_number().over(within))
    )
    copies = placed.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)))).withColumn(
        "mix_finish",
        F.when(F.col("target") > 0, (F.col("mix_copy") * F.col("source_size") + F.col(f"{_P}cum")).cast("double") / F.col("target")).otherwise(F.lit(0.0)),
    )
    copies = copies.withColumn(f"{_P}bin", _bin(F.col("mix_finish")))

    so_far = Window.orderBy(f"{_P}bin")
    bins = cut(
        copies.groupBy(f"{_P}bin").agg(F.sum(size).alias("bin_size"), F.max("total").alias("budget"))
        .withColumn("upto", F.sum("bin_size").over(so_far))
        .select(f"{_P}bin", (F.col("upto") - F.col("bin_size")).alias(f"{_P}lead"), F.col("upto").alias(f"{_P}upto"), F.col("budget").alias(f"{_P}budget"))
    )  # at most BINS rows: safe to broadcast
    flagged = copies.join(F.broadcast(bins), f"{_P}bin")
    whole = F.col(f"{_P}upto") <= F.col(f"{_P}budget")
    crossing = ~whole & (F.col(f"{_P}lead") <= F.col(f"{_P}budget"))
    inside = Window.partitionBy(f"{_P}bin").orderBy("mix_finish", f"{_P}null", f"{_P}src", f"{_P}h", size, key, "mix_copy")
    last = flagged.filter(crossing).withColumn(
        "mix_taken", F.col(f"{_P}lead") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) <= F.col(f"{_P}budget")
    )
    out = flagged.filter(~crossing).withColumn("mix_taken", whole).unionByName(last)
    if truncate:
        out = out.filter("mix_taken")
    out = out.withColumn("mix_row", F.concat_ws(":", F.col(f"{_P}null").cast("string"), F.col(f"{_P}h"), F.col(f"{_P}n").cast("string"), F.col(f"{_P}src")))
    return out.orderBy("mix_finish", f"{_P}null", f"{_P}src", f"{_P}h", size, "mix_copy").select(
        *[F.col(f"{_P}row").getField(c).alias(c) for c in given], "mix_copy", "mix_finish", "mix_row", "source_size", "target", "mix_taken"
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(text_or_empty()).cast("long").alias("size"))
    copies = mix(docs, "size", truncate=False)
    return (
        copies.groupBy("mix_row", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.when(F.col("mix_taken"), F.col("size")).otherwise(0)).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, source IS NULL AS nosrc, coalesce(source, '') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h
  FROM documents),
s AS (SELECT nosrc, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, (row_number() OVER (ORDER BY nosrc, src) - 1) % 3 + 1 AS weight FROM s),
f AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
g AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY ratio, nosrc, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY ratio, nosrc, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total FROM f),
lv AS (SELECT *, max(CAST(total - filled AS DOUBLE) / open) OVER () AS level FROM g),
t AS (SELECT nosrc, src, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target, total FROM lv),
p AS (SELECT d.*, t.source_size, t.target, t.total,
         sum(size) OVER (PARTITION BY d.nosrc, d.src ORDER BY h, size, doc_id ROWS UNBOUNDED PRECEDING) AS cum,
         row_number() OVER (PARTITION BY d.nosrc, d.src ORDER BY h, size, doc_id) AS n
      FROM d JOIN t ON d.nosrc = t.nosrc AND d.src = t.src),
c AS (SELECT p.*, k, CASE WHEN target > 0 THEN CAST(k * source_size + cum AS DOUBLE) / target ELSE 0.0 END AS v
      FROM p, (SELECT unnest([0, 1, 2]) AS k)),
r AS (SELECT *, sum(size) OVER (ORDER BY v, nosrc, src, h, size, doc_id, k ROWS UNBOUNDED PRECEDING) <= total AS ok FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN ok THEN size ELSE 0 END) AS BIGINT) AS taken
FROM r GROUP BY nosrc, src, n, doc_id, size, source_size, target
"""
