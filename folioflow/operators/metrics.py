"""Counts, estimates, previews and the small string rules of the job list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.chunks import block_words

TAGS = {"heading1": "[H1]", "heading2": "[H2]", "paragraph": "[  ]", "code": "[CODE]", "caption": "[CAP]", "image": "[IMG]"}
PREVIEW_CHARS, PREVIEW_BLOCKS, PREVIEW_PAGES = 80, 20, 5
LOG_CHARS = 4000


def book_stats(blocks: DataFrame) -> DataFrame:
    """book_id, n_text, n_images, n_words of each book."""
    image = F.col("kind") == "image"
    return blocks.groupBy("book_id").agg(
        F.count_if(~image).alias("n_text"), F.count_if(image).alias("n_images"), F.sum(block_words(F.col("kind"), F.col("text"))).cast("long").alias("n_words")
    )


def kind_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("kind").agg(F.count("*").alias("n"))


def cost_estimate(words: Column) -> tuple[Column, Column, Column]:
    """Tokens in, tokens out and US dollars for a number of words."""
    tokens_in = F.floor(words.cast("double") * F.lit(1.5).cast("double")).cast("long")
    tokens_out = F.floor(words.cast("double") * F.lit(1.8).cast("double")).cast("long")
    return tokens_in, tokens_out, (tokens_in * 3 + tokens_out * 15).cast("double") / F.lit(1e6)


def preview(blocks: DataFrame, pages: int = PREVIEW_PAGES, n: int = PREVIEW_BLOCKS) -> DataFrame:
    """The first blocks of each book's first pages as lines: the preview is the feature."""
    tag = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in TAGS.items()], F.lit("[?]"))
    shown = F.concat(F.substring("text", 1, PREVIEW_CHARS), F.when(F.length("text") > PREVIEW_CHARS, "…").otherwise(""))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    first = blocks.filter(F.col("page_num") <= pages).withColumn("n", rank).filter(F.col("n") <= n)
    return first.select("book_id", "n", F.concat(F.lit("  p."), F.lpad(F.col("page_num").cast("string"), 3, "0"), F.lit(" "), tag, F.lit(" "), shown).alias("line"))


def progress(checkpoint: DataFrame) -> DataFrame:
    """book_id, done: one more than the last chunk that is stored."""
    return checkpoint.groupBy("book_id").agg((F.max("chunk_id") + 1).cast("long").alias("done"))


def eta(timed: DataFrame, totals: DataFrame) -> DataFrame:
    """book_id, remaining, eta_minutes: what is left at the pace of the last stored chunk (timed: book_id, chunk_id,
    seconds; totals: book_id, total). Of a chunk stored twice the longer time counts; a book without one has no estimate."""
    last = timed.groupBy("book_id").agg(F.max(F.struct("chunk_id", "seconds")).alias("last"))
    remaining = F.greatest(F.col("total") - F.coalesce(F.col("last.chunk_id") + 1, F.lit(0)), F.lit(0)).cast("long")
    rows = totals.join(last, "book_id", "left").withColumn("remaining", remaining)
    return rows.select("book_id", "remaining", F.floor(F.col("remaining") * F.col("last.seconds") / 60).cast("long").alias("eta_minutes"))


def output_sizes(files: DataFrame) -> DataFrame:
    """book_id, size_kb of the Markdown files and n_png (files: book_id, path, length)."""
    png = F.lower("path").endswith(".png")
    size = F.round(F.sum(F.when(png, 0).otherwise(F.col("length"))) / 1024.0, 1).alias("size_kb")
    return files.groupBy("book_id").agg(size, F.count_if(png).alias("n_png"))


def status(alive: Column, done: Column, total: Column) -> Column:
    return F.when(alive, "running").when((total > 0) & (done >= total), "done").otherwise("idle")


def percent(done: Column, total: Column) -> Column:
    """Rounded half up, 100 at most, 0 of nothing."""
    return F.when(total > 0, F.least(F.floor(done * 100.0 / total + 0.5), F.lit(100))).otherwise(0).cast("long")


def label(status_: Column, done: Column) -> Column:
    return F.when(status_ == "running", "running").when(status_ == "done", "done").when(done > 0, "paused").otherwise("waiting")


def actions(status_: Column, done: Column, pdf_path: Column) -> Column:
    """struct(can_read, can_export, can_restart)."""
    return F.struct((done > 0).alias("can_read"), (status_ == "done").alias("can_export"), (pdf_path.isNotNull() & (status_ != "running")).alias("can_restart"))


def title_of_file(name: Column) -> Column:
    """A title from a file name: no extension, no underscores, no copy number."""
    plain = F.replace(F.regexp_replace(name, r"^(.*?)\.pdf", "$1"), F.lit("_"), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"\s*\(\d+\)\s*$", ""))


def slug(title: Column, chars: int = 40) -> Column:
    return F.replace(F.substring(title, 1, chars), F.lit(" "), F.lit("_"))


def rewrite_images(text: Column, prefix: Column) -> Column:
    """Image links under the book's URL; the prefix goes in literally."""
    literal = F.replace(F.replace(prefix, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(text, F.lit(r"!\[([^\]]*)\]\(images/"), F.concat(F.lit("![$1]("), literal, F.lit("/images/")))


def log_tail(text: Column) -> Column:
    return F.right(F.coalesce(text, F.lit("")), F.lit(LOG_CHARS))
