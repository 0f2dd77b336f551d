"""Books from their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import CHUNK_SEPARATOR, HEADER


def book_title(title: Column, stem: Column) -> Column:
    return F.coalesce(title, F.replace(stem, F.lit("_"), F.lit(" ")))


def header(title: Column, first: Column, last: Column, total: Column) -> Column:
    pattern = HEADER.format(title="%s", start="%d", end="%d", total="%d")
    return F.format_string(pattern, title, first, last, total)


def assemble(chunks: DataFrame) -> DataFrame:
    """book_id, text: the non-empty chunks (book_id, chunk_id, text) in order."""
    kept = chunks.filter(F.length("text") > 0).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("c"))
    return kept.select("book_id", F.array_join(F.transform("c", lambda c: c["text"]), CHUNK_SEPARATOR).alias("text"))
