"""Word-budgeted chunks: an ordered fold with resets, over one book's blocks at a time.

A heading of the first level opens a chunk; a chunk closes once it has its words, unless the block that
filled it is a heading or an image. The reset depends on the running count, so no window frame can say
it; the fold is a higher-order ``aggregate`` on the book's array of (place, kind, words), without Python,
in time that follows the number of blocks. That array of one book is the memory bound: texts stay out of
it, and the numbers go back to the blocks by a join on book and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.pytext import count_words, let, scan

MAX_WORDS = 600
MAX_WORDS_SERVICE = 400


def chunk_ids(blocks: Column, max_words: int) -> Column:
    """The chunk number of each of an array of struct(kind, words)."""

    def step(s: Column, b: Column) -> Column:
        opens = (b["kind"] == "heading1") & (s["n"] > 0)
        chunk = s["next"] + opens.cast("int")
        words = F.when(opens, F.lit(0)).otherwise(s["words"]) + b["words"]
        full = (words >= max_words) & ~b["kind"].isin("heading1", "heading2", "image")
        return F.struct(
            chunk.alias("chunk"), (chunk + full.cast("int")).alias("next"), F.when(full, F.lit(0)).when(opens, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            F.when(full, F.lit(0)).otherwise(words).alias("words"),
        )

    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("next"), F.lit(0).alias("n"), F.lit(0).alias("words"))
    return scan(blocks, start, step, lambda s: s["chunk"], "int")


def block_words(kind: Column, text: Column) -> Column:
    return F.when(kind == "image", F.lit(0)).otherwise(count_words(text))


def chunk_blocks(blocks: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``blocks`` (book_id, ord, kind, text, ...) with n_words and chunk_id; blocks of one place share a chunk."""
    worded = blocks.withColumn("n_words", block_words(F.col("kind"), F.col("text")))
    light = worded.select("book_id", F.struct("ord", "kind", F.col("n_words").alias("words")).alias("b"))
    books = light.groupBy("book_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    numbered = books.select("book_id", "b", chunk_ids(F.col("b"), max_words).alias("ids"))
    placed = numbered.select("book_id", F.explode(F.zip_with("b", "ids", lambda b, i: F.struct(b["ord"].alias("ord"), i.alias("chunk_id")))).alias("x"))
    placed = placed.groupBy(F.col("book_id").alias("__book"), F.col("x.ord").alias("__ord")).agg(F.min("x.chunk_id").alias("chunk_id"))
    same = worded["book_id"].eqNullSafe(placed["__book"]) & (worded["ord"] == placed["__ord"])
    return worded.join(placed, same).drop("__book", "__ord")


def markdown(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(kind == "heading1", F.concat(F.lit("# "), text))
        .when(kind == "heading2", F.concat(F.lit("## "), text)).when(kind == "caption", F.concat(F.lit("*"), text, F.lit("*"))).otherwise(text)
    )


def image_positions(blocks: Column) -> Column:
    """array<struct<frac,md>> of a chunk's images: the share of its text blocks that stand before each."""
    texts = F.size(F.filter(blocks, lambda b: b["kind"] != "image"))

    def step(s: Column, b: Column) -> Column:
        image = b["kind"] == "image"
        frac = F.when(s["total"] > 0, s["seen"] / s["total"]).otherwise(F.lit(1.0))
        out = F.concat(s["out"], F.array(F.struct(frac.alias("frac"), b["text"].alias("md"))))
        return F.struct(s["total"].alias("total"), (s["seen"] + (~image).cast("int")).alias("seen"), F.when(image, out).otherwise(s["out"]).alias("out"))

    nothing = F.expr("cast(array() as array<struct<frac:double,md:string>>)")
    return let(texts, lambda n: F.aggregate(blocks, F.struct(n.alias("total"), F.lit(0).alias("seen"), nothing.alias("out")), step)["out"])


def chunk_rows(chunked: DataFrame) -> DataFrame:
    """book_id, chunk_id, n_blocks, n_words, text (Markdown without images), images of each chunk."""
    grouped = chunked.groupBy("book_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))).alias("b"), F.count("*").alias("n_blocks"), F.sum("n_words").cast("long").alias("n_words")
    )
    texts = F.transform(F.filter("b", lambda x: x["kind"] != "image"), lambda x: markdown(x["kind"], x["text"]))
    return grouped.select("book_id", "chunk_id", "n_blocks", "n_words", F.array_join(texts, "\n\n").alias("text"), image_positions(F.col("b")).alias("images"))


def chunk_images(blocks: Column) -> Column:
    """The image tags of a chunk's blocks."""
    return F.transform(F.filter(blocks, lambda b: b["kind"] == "image"), lambda b: b["text"])
