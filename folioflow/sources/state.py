"""State files as tables: checkpoints, progress, the registry, uploads, logs, Markdown, books; and the optional PDF source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.metrics import title_of_file

STATE = "struct<chunks:map<string,string>,last_chunk:int>"
REGISTRY = "title string, from_page int, output_dir string, url_prefix string, pdf_path string, created_at string, pid int"


def parse_checkpoint(json: Column) -> Column:
    """The state of a checkpoint; of an absent or broken one the empty state."""
    state = F.from_json(json, STATE)
    whole = state.isNotNull() & state["last_chunk"].isNotNull() & state["chunks"].isNotNull()
    return F.when(whole, state).otherwise(F.from_json(F.lit('{"chunks": {}, "last_chunk": -1}'), STATE))


def checkpoint_chunks(states: DataFrame) -> DataFrame:
    """book_id, chunk_id, text of the stored chunks that the book has (states: book_id, state, total)."""
    rows = states.select("book_id", "total", F.explode("state.chunks").alias("key", "text"))
    return rows.select("book_id", F.col("key").cast("int").alias("chunk_id"), "text", "total").filter("chunk_id < total").drop("total")


def parse_progress(json: Column) -> Column:
    """struct(done, total); zeros if absent or broken."""
    p = F.from_json(json, "struct<done:long,total:long>")
    return F.struct(F.coalesce(p["done"], F.lit(0)).alias("done"), F.coalesce(p["total"], F.lit(0)).alias("total"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """book_id and the registry's columns, one row a book; a broken file raises."""
    text = spark.read.text(path, wholetext=True)
    books = F.from_json("value", f"map<string,struct<{', '.join(c.replace(' ', ':', 1) for c in REGISTRY.split(', '))}>>", {"mode": "FAILFAST"})
    return text.select(F.explode(books).alias("book_id", "b")).select("book_id", "b.*")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def book_id() -> Column:
    """A new book's id: ten hexadecimal digits."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10)


def landed_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A stream of the uploaded files of a landing folder: path, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)


def uploads(files: DataFrame, forms: DataFrame, books: str = "books") -> DataFrame:
    """Registry rows of landed files (path) with the fields sent beside them (forms: path, title, from_page).

    Without a title the file's name gives one, without a first page it is 1; a file without a form counts too.
    Files may be the stream of ``landed_files``: write the rows before they are used, each run draws new ids.
    """
    named = files.select("path").join(forms.select("path", "title", "from_page"), "path", "left").withColumn("book_id", book_id())
    title = F.coalesce(F.when(F.trim("title") != "", F.col("title")), title_of_file(F.element_at(F.split("path", "/"), -1)))
    folder = F.concat(F.lit(f"{books}/"), "book_id", F.lit("/output"))
    return named.select(
        "book_id", title.alias("title"), F.coalesce("from_page", F.lit(1)).cast("int").alias("from_page"), folder.alias("output_dir"),
        F.concat(F.lit("/data/"), folder).alias("url_prefix"), F.col("path").alias("pdf_path"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), F.lit(None).cast("int").alias("pid"),
    )


def write_books(books: DataFrame, folder: str) -> None:
    """Write book_id and markdown to one text file a book, ``folder``/book_id=.../; other books' files stay.

    The file sink ends each file with a newline of its own, which ``read_books`` takes off; null texts are empty.
    """
    rows = books.select(F.col("book_id").cast("string").alias("book_id"), F.coalesce("markdown", F.lit("")).alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").text(folder)


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, markdown: what ``write_books`` wrote."""
    rows = spark.read.schema("value string, book_id string").text(folder, wholetext=True)
    return rows.select("book_id", F.regexp_replace("value", r"\n\z", "").alias("markdown"))


def book_files(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, path, length of the files under ``folder``/book_id=.../, from the listing alone."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return rows.select(F.regexp_extract("path", r"/book_id=([^/]*)/", 1).alias("book_id"), "path", "length").filter("book_id <> ''")


def read_pdf(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Raw blocks of PDF files (the layout of ``operators.blocks``), a task a file. Needs PyMuPDF on the executors."""
    schema = (
        "book_id string, page_num int, block_no int, block_type int, bbox struct<x0:double,y0:double,x1:double,y1:double>,"
        " spans array<struct<text:string,size:double,font:string,flags:int>>"
    )

    def pages(batches):
        import fitz  # PyMuPDF, optional
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                document = fitz.open(stream=content, filetype="pdf")
                stop = min(last or len(document), len(document))
                for number in range(max(1, first), stop + 1):
                    kept = fitz.TEXT_PRESERVE_WHITESPACE | fitz.TEXT_PRESERVE_IMAGES
                    found = document[number - 1].get_text("dict", flags=kept)["blocks"]
                    yield pd.DataFrame([
                        {"book_id": name.rsplit("/", 1)[-1].removesuffix(".pdf"), "page_num": number, "block_no": k, "block_type": b.get("type", 0),
                         "bbox": dict(zip(("x0", "y0", "x1", "y1"), map(float, b.get("bbox", (0, 0, 0, 0))), strict=True)),
                         "spans": [{f: s.get(f, 0) for f in ("text", "size", "font", "flags")} for line in b.get("lines", []) for s in line.get("spans", [])]}
                        for k, b in enumerate(found)
                    ], columns=["book_id", "page_num", "block_no", "block_type", "bbox", "spans"])

    return spark.read.format("binaryFile").load(path).select("path", "content").repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(pages, schema)
