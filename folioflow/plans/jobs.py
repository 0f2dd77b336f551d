"""Jobs: a book's run from raw blocks to the finished Markdown, its files, and the job list."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import CHUNK_SEPARATOR
from folioflow.operators import assemble, blocks, chunks, metrics, terms
from folioflow.plans.backends import Backend, identity
from folioflow.plans.translate import pending, transform_chunks
from folioflow.sources.shared import delete
from folioflow.sources.shared import exists as _exists
from folioflow.sources.state import book_files, write_books


def chunked_books(raw: DataFrame, max_words: int = chunks.MAX_WORDS, first: int | None = None, last: int | None = None) -> DataFrame:
    """The chunks of all books: raw blocks extracted, ordered, packed and rendered."""
    return chunks.chunk_rows(chunks.chunk_blocks(blocks.extract(raw, True, first, last), max_words))


def run(raw: DataFrame, store: str, backend: Backend = identity, max_words: int = chunks.MAX_WORDS, resume: bool = True) -> DataFrame:
    """Transform what is not stored yet and append it to the Parquet folder ``store``; then all of the
    store (book_id, chunk_id, translated, flag). Without ``resume`` the store is overwritten."""
    spark = raw.sparkSession
    todo = chunked_books(raw, max_words)
    if resume and _exists(spark, store):
        todo = pending(todo, spark.read.parquet(store))
    transform_chunks(todo, backend).select("book_id", "chunk_id", "translated", "flag").write.mode("append" if resume else "overwrite").parquet(store)
    return spark.read.parquet(store)


def books(store: DataFrame, raw: DataFrame, titles: DataFrame) -> DataFrame:
    """book_id, markdown, changes: header, chunks and annotations (titles: book_id, title)."""
    pages = raw.groupBy("book_id").agg(F.min("page_num").alias("a"), F.max("page_num").alias("b"))
    body = assemble.assemble(store.select("book_id", "chunk_id", F.col("translated").alias("text")))
    rows = body.join(pages, "book_id").join(titles, "book_id")
    text = rows.withColumn("text", F.concat(assemble.header(F.col("title"), F.col("a"), F.col("b"), F.col("b")), F.col("text")))
    found = text.withColumn("found", terms.annotations(F.col("text")))
    return found.select("book_id", terms.annotate(F.col("text"), F.col("found")).alias("markdown"), terms.change_log(F.col("found")).alias("changes"))


def finish(store: DataFrame, raw: DataFrame, titles: DataFrame, folder: str, glossary: bool = False) -> DataFrame:
    """Write every book to its file under ``folder`` and, if asked, the glossary beside it as ``folder``_glossary;
    book_id, size_kb and n_png of what is there."""
    spark = raw.sparkSession
    write_books(books(store, raw, titles), folder)
    if glossary:
        terms.glossary_note(terms.glossary(spark)).coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}_glossary")
    return metrics.output_sizes(book_files(spark, folder))


def status_table(registry: DataFrame, stored: DataFrame, totals: DataFrame, alive: DataFrame) -> DataFrame:
    """The job list: registry with done, total, percent, status (alive: pid of each live process)."""
    rows = registry.join(metrics.progress(stored), "book_id", "left").join(totals, "book_id", "left").join(alive.select("pid", F.lit(True).alias("live")), "pid", "left")
    done, total = F.coalesce("done", F.lit(0)), F.coalesce("total", F.lit(0))
    rows = rows.withColumns({"done": done, "total": total})
    state = metrics.status(F.coalesce("live", F.lit(False)), F.col("done"), F.col("total"))
    return rows.withColumns({"status": state, "percent": metrics.percent(F.col("done"), F.col("total"))}).drop("live")


def clear(spark: SparkSession, store: str) -> None:
    """Forget a run."""
    delete(spark, store)


def annotate_file(path: str, spark: SparkSession, preview: bool = False) -> list[str]:
    """Annotate a Markdown file in place, a backup beside it; the changes. A preview writes nothing."""
    file = Path(path)
    text = file.read_text(encoding="utf-8")
    rows = spark.createDataFrame([(text,)], "text string").withColumn("found", terms.annotations(F.col("text")))
    row = rows.select(terms.annotate(F.col("text"), F.col("found")).alias("text"), terms.change_log(F.col("found")).alias("changes")).first()
    if row.changes and not preview:
        file.with_suffix(".md.bak").write_text(text, encoding="utf-8")
        file.write_text(row.text, encoding="utf-8")
    return row.changes


def export(source: str, kind: str = "epub", out: str | None = None) -> str:
    """An EPUB or PDF of a Markdown file by pandoc, where it is installed."""
    if kind not in ("epub", "pdf"):
        raise ValueError("kind is epub or pdf")
    if not shutil.which("pandoc"):
        raise RuntimeError("pandoc is not installed")
    target = out or str(Path(source).with_suffix(f".{kind}"))
    extra = ["--epub-chapter-level=1", "-V", "lang=uk"] if kind == "epub" else ["--pdf-engine=xelatex", "-V", "mainfont=Arial", "-V", "lang=uk", "-V", "geometry:margin=2cm"]
    subprocess.run(["pandoc", source, "-o", target, "--resource-path", str(Path(source).parent), *extra], check=True, timeout=300)
    return target


__all__ = ["CHUNK_SEPARATOR", "annotate_file", "books", "chunked_books", "clear", "export", "finish", "run", "status_table"]
