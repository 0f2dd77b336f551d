"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.pytext import let
from folioflow.sources.shared import delete, shared_folder

__all__ = ["GAP", "WORD", "broadcast_if_small", "cut", "let", "n_rows", "n_words", "pieces", "scratch", "shared_folder", "small_batches", "table", "text_or_empty", "words"]

#: A word: a run of anything but space, tab, newline, VT, FF and CR (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: The white space between words.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders of the tables written in the innermost ``scratch``, or None outside of any.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("_WRITTEN", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and the rows
    survive lost executors. ``scratch`` clears what is no longer needed; who sets the folder clears the rest
    after the session. The rows are counted on the way."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(folder)
    if (written := _WRITTEN.get()) is not None:
        written.append(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder, out._rows = folder, seen.get["rows"]
    return out


def n_rows(df: DataFrame) -> int:
    """The rows of a table that ``cut`` wrote, without a job."""
    return df._rows


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``cut`` writes inside is deleted at the end, but for the tables that went through the function given.
    Only for code whose result doesn't read the others: they are gone when it is used. Spark drops the files
    of their shuffles when the driver collects its garbage, so that is asked for."""
    outer, written, kept = _WRITTEN.get(), [], []
    token = _WRITTEN.set(written)
    spark = SparkSession.active()

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._folder)
        return df

    try:
        yield keep
    finally:
        _WRITTEN.reset(token)
        if outer is not None:
            outer += kept
        for folder in set(written) - set(kept):
            delete(spark, folder)
        spark._jvm.System.gc()


#: The most bytes of a table that is broadcast after its size was measured.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """``df`` (a written table) marked for broadcast if its measured size allows it; as it is, for a join
    by shuffle, if not. ``row_bytes``: what a row takes in memory."""
    total = row_bytes * n_rows(df) if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pieces(text: Column) -> Column:
    """The words of a text and empty strings, without a pattern: white space becomes spaces, and words stand between them."""
    ends = F.replace(text, F.lit("\n"), F.lit(" "))
    odd = F.contains(ends, F.lit("\t")) | F.contains(ends, F.lit("\x0b")) | F.contains(ends, F.lit("\x0c")) | F.contains(ends, F.lit("\r"))
    return F.split(F.when(odd, F.translate(ends, "\t\x0b\x0c\r", " " * 4)).otherwise(ends), " ", -1)


def words(text: Column) -> Column:
    """The words of a text."""
    return F.array_remove(pieces(text), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what an Arrow batch of whole texts may hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
