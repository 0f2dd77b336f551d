"""Incremental chunking: documents that arrive are packed once and appended, exactly once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.chunks import chunk_ids
from folioflow.functions.pytext import count_words, scan


def chunk_documents(docs: DataFrame, max_words: int) -> DataFrame:
    """doc_id, chunk_id, n_blocks, n_words of texts whose lines are paragraphs: a projection and one
    explode a document, so it runs on a stream as it runs on a table."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("paragraph").alias("kind"), count_words(x).alias("words")))
    packed = docs.select("doc_id", lines.alias("b")).select("doc_id", "b", chunk_ids(F.col("b"), max_words).alias("ids"))
    # numbers rise, so a chunk is a run: it ends where the next number differs, and its sum is a difference of running sums
    upto = scan(F.col("b"), F.lit(0).cast("long"), lambda n, x: n + x["words"], lambda n: n, "bigint")
    summed = packed.select("doc_id", "ids", upto.alias("upto"))
    ends = F.filter(F.sequence(F.lit(1), F.size("ids")), lambda k: F.coalesce(F.get("ids", k) != F.get("ids", k - 1), F.lit(True)))
    ended = summed.select("doc_id", "ids", "upto", ends.alias("ends"))
    each = F.transform(
        "ends",
        lambda e, k: F.struct(
            F.get("ids", e - 1).alias("chunk_id"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).cast("long").alias("n_blocks"),
            (F.get("upto", e - 1) - F.coalesce(F.get("upto", F.get("ends", k - 1) - 1), F.lit(0).cast("long"))).alias("n_words"),
        ),
    )
    return ended.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.*")


def start(stream: DataFrame, store: str, checkpoint: str, max_words: int) -> StreamingQuery:
    """Append the chunks of a stream of documents to the Parquet folder ``store``; a restart goes on from ``checkpoint``."""
    out = chunk_documents(stream, max_words).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return out.option("path", store).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at a path (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
