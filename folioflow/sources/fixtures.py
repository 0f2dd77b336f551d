"""The driver's tables as books: deterministic decorations that exercise every rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FENCE = "```"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer tasks (one file of one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line of every line of ``documents``."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def raw_blocks(spark: SparkSession, sf_dir: str, lines_a_page: int = 1) -> DataFrame:
    """Every line as a laid-out block, every 17th an image."""
    m = F.col("pos") * 7 + F.col("doc_id") * 3
    size = (F.lit(10) + m % 9).cast("double")
    flags = (F.when(m % 5 == 0, 16).otherwise(0) + F.when(m % 4 == 0, 2).otherwise(0)).cast("int")
    span = lambda text, size, font, flags: F.struct(text.alias("text"), size.alias("size"), font.alias("font"), flags.alias("flags"))
    first = span(F.col("line"), size, F.when(m % 13 == 0, "Courier").otherwise("Serif"), flags)
    blank = span(F.lit(" \t"), F.lit(99.0), F.lit("Courier"), F.lit(0))
    more = span(F.lit("  and more "), size + 1, F.lit("Sans-BoldOblique"), F.lit(0))
    spans = F.when(F.col("pos") % 3 == 0, F.array(first, blank, more)).otherwise(F.array(first, blank))
    x0, y0 = ((m % 2) * 300).cast("double"), ((m * 37) % 700).cast("double")
    bbox = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 30 + (m * 11) % 200).alias("x1"), (y0 + 20 + (m * 13) % 200).alias("y1"))
    return doc_lines(spark, sf_dir).select(
        F.col("doc_id").alias("book_id"), (F.lit(1) + F.floor(F.col("pos") / lines_a_page)).cast("int").alias("page_num"), F.col("pos").alias("block_no"),
        F.when(m % 17 == 3, 1).otherwise(0).alias("block_type"), bbox.alias("bbox"), spans.alias("spans"),
    )


def plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a classified block (book_id, ord, page_num, kind, text) of the kind that its layout gives it."""
    m = F.col("pos") * 7 + F.col("doc_id") * 3
    size = F.lit(10) + m % 9
    kind = (
        F.when(m % 17 == 3, "image").when(m % 13 == 0, "code").when(size >= 18, "heading1").when((size >= 14) | ((m % 5 == 0) & (size >= 12)), "heading2")
        .when((m % 4 == 0) & (F.length("line") < 200), "caption").otherwise("paragraph")
    )
    return doc_lines(spark, sf_dir).select(
        F.col("doc_id").alias("book_id"), F.col("pos").alias("ord"), (F.col("pos") + 1).alias("page_num"), kind.alias("kind"),
        F.when(m % 17 == 3, F.format_string("\n![%d]\n", "pos")).otherwise(F.col("line")).alias("text"),
    )


DIRTY_LINES = ("", "4242", "12 34 56 78 90", "ISBN 978-0", "Twitter: @x", "12 | Chapter", "Chapter | 12", "OVERVIEW", "Introduction")
DIRTY_DOCS = (
    ("", "\nok 漢字 junk\ntail"),
    ("", "\n(Продовження тексту далі) x\n[Продовження] y"),
    (f"Приклад:\n{FENCE}\n", ""),
    ("", f"\n—\n{FENCE}\nplain\n—"),
    ("", "\n#a #b #c\ntail"),
    ("Rep. Rep. Rep. ", ""),
    ("", "\n★★\nend"),
    ("", f"\n{FENCE}py\nx = {{1}} $1 \\d\n{FENCE}\nend"),
    ("ДОКЕР та кубернетес, безперервна інтеграція. Докером. ", ""),
    (f"Сага і сага. {FENCE}сага{FENCE} зв'язаність. ", ""),
)


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, page_num, text: nine lines of twelve replaced by page furniture."""
    k = (F.col("doc_id") + F.col("pos")) % 12
    text = F.coalesce(*[F.when(k == i, F.lit(t)) for i, t in enumerate(DIRTY_LINES)], F.col("line"))
    return doc_lines(spark, sf_dir).select(F.col("doc_id").alias("book_id"), (F.col("pos") + 1).alias("page_num"), text.alias("text"))


def _decorated(text: Column, doc_id: Column) -> Column:
    return F.coalesce(*[F.when(doc_id % 10 == i, F.concat(F.lit(a), text, F.lit(b))) for i, (a, b) in enumerate(DIRTY_DOCS)])


def dirty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: whole texts with what the cleanup looks for."""
    return table(spark, sf_dir, "documents").select("doc_id", _decorated(F.col("text"), F.col("doc_id")).alias("text"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source, result: each user turn with the assistant's answer to it."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("result"))
    return users.join(answers, ["conv_id", "turn"])
