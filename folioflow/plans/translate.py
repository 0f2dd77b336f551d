"""The transformation of chunks: code out, prompt, backend, cleanup, guard, terms, code back, images.

Without context all chunks are answered at once (``transform_chunks``). With context (``translate_in_order``)
the next chunk of every book goes through the same steps in one round, with the book's previous answer in its
prompt; rounds are stored, so a run resumes where it ended. Texts without prose never reach the backend.
Deliberate differences from a literal reading of the steps: code stays out of both passes, English forms are
fixed before code comes back, and the context is the answer without its images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.pytext import strip
from folioflow.operators import code, guards, images, prompts, terms
from folioflow.operators.cleanup import strip_noise
from folioflow.plans.backends import Backend, identity, varies
from folioflow.sources.shared import delete, exists

_P = "__tr_"


def transform_chunks(chunks: DataFrame, backend: Backend = identity, fix: Backend | None = None, faithful: bool = False, context: str | None = None, keep: bool = False) -> DataFrame:
    """``chunks`` (..., text, images) with translated and flag (the guard's reason, of the answer that was taken).

    ``context`` names the column of the previous answer (null: none). An answer that the guard flags is asked
    for once more, without context, if the backend's answers vary, and the second is taken, whatever it is.
    A second pass (``fix``) that gives null leaves the first. ``faithful`` fixes English forms after the code
    came back, code included. ``keep`` adds prompt and answer (without images).
    """
    whole = [*chunks.columns]
    text, inner, out = F.col("text"), F.col(f"{_P}in"), F.col(f"{_P}out")
    rows = chunks.withColumns({f"{_P}code": code.code_blocks(text), f"{_P}in": code.take_out(text)})
    prose = F.coalesce((F.length(strip(text)) > 0) & code.has_prose(inner), F.lit(False))
    rows = rows.withColumn(f"{_P}prose", prose)
    previous = F.col(context) if context else F.lit(None).cast("string")
    ask = lambda p, when=F.col(f"{_P}prose"): F.when(when, p)
    asked = rows.withColumn(f"{_P}prompt", ask(prompts.build_prompt(inner, previous)))
    answered = backend(asked, f"{_P}prompt", f"{_P}in", f"{_P}raw").withColumn(f"{_P}out", strip_noise(F.col(f"{_P}raw")))
    flag = F.when(F.col(f"{_P}prose"), guards.added_reason(inner, out))
    answered = answered.withColumn("flag", flag)
    if varies(backend):
        again = answered.withColumn(f"{_P}prompt2", ask(prompts.build_prompt(inner, F.lit(None).cast("string")), F.col("flag").isNotNull()))
        second = backend(again, f"{_P}prompt2", f"{_P}in", f"{_P}raw2")
        answered = second.withColumn(f"{_P}out", F.when(F.col(f"{_P}raw2").isNotNull(), strip_noise(F.col(f"{_P}raw2"))).otherwise(out)).withColumn("flag", flag)
    if fix is not None:
        second = answered.withColumn(f"{_P}prompt3", ask(prompts.fix_prompt(inner, out)))
        fixed = fix(second, f"{_P}prompt3", f"{_P}out", f"{_P}raw3")
        answered = fixed.withColumn(f"{_P}out", F.when(F.col(f"{_P}raw3").isNotNull(), guards.accept_fix(out, strip_noise(F.col(f"{_P}raw3")))).otherwise(out))
    if faithful:
        finished = terms.force_english(code.put_back(out, F.col(f"{_P}code")))
    else:
        finished = code.put_back(terms.force_english(out), F.col(f"{_P}code"))
    done = answered.withColumn(f"{_P}answer", F.when(F.col(f"{_P}prose"), finished).otherwise(text))
    placed = images.interleave(F.col(f"{_P}answer"), F.col("images")) if "images" in whole else F.col(f"{_P}answer")
    more = [F.col(f"{_P}prompt").alias("prompt"), F.col(f"{_P}answer").alias("answer")] if keep else []
    return done.select(*[c for c in whole if c not in ("translated", "flag")], placed.alias("translated"), "flag", *more)


def pending(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """The chunks after the last one that is stored (book_id, chunk_id): what a resumed run has to do."""
    last = stored.groupBy("book_id").agg(F.max("chunk_id").alias(f"{_P}last"))
    return chunks.join(last, "book_id", "left").filter(F.col("chunk_id") > F.coalesce(f"{_P}last", F.lit(-1))).drop(f"{_P}last")


def transform_in_order(chunks: DataFrame, answer: Callable[[str, str], str], stored: DataFrame | None = None) -> DataFrame:
    """book_id, chunk_id, answer: each book's chunks one after another, ``answer(text, previous answer)``.

    Inherently serial within a book; books run in parallel. A resumed book goes on from its last stored answer.
    """
    import pandas as pd

    texts = chunks.select("book_id", "chunk_id", "text", F.lit(None).cast("string").alias("known"))
    if stored is not None:
        old = stored.select("book_id", "chunk_id", F.lit(None).cast("string").alias("text"), F.col("translated").alias("known"))
        texts = pending(texts, stored).unionByName(old)

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        previous, out = "", []
        for row in pdf.sort_values("chunk_id").itertuples():
            if row.known is None:
                previous = answer(row.text, previous)
                out.append((row.book_id, row.chunk_id, previous))
            else:
                previous = row.known
        return pd.DataFrame(out, columns=["book_id", "chunk_id", "answer"])

    kind = dict(chunks.dtypes)
    return texts.groupBy("book_id").applyInPandas(book, f"book_id {kind['book_id']}, chunk_id {kind['chunk_id']}, answer string")


def translate_in_order(chunks: DataFrame, store: str, backend: Backend = identity, fix: Backend | None = None) -> DataFrame:
    """The Parquet folder ``store`` (book_id, chunk_id, translated, flag, prompt, answer) after all chunks (book_id,
    chunk_id, text, ...) went through ``transform_chunks`` in order, each with the answer before it as context.

    Serial within a book by nature; books run in parallel. A round takes the next chunk of every book: as many
    rounds as the longest book has chunks. What has to be done is dealt into a table by round, so a round reads
    its own part only, and each round is stored before the next. A store that exists is gone on with.
    """
    spark = chunks.sparkSession
    known = spark.read.parquet(store) if exists(spark, store) else None
    todo = pending(chunks, known) if known is not None else chunks
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("chunk_id"))
    queue = f"{store.rstrip('/')}.queue"
    todo = todo.withColumn(f"{_P}round", place)
    todo.write.mode("overwrite").partitionBy(f"{_P}round").parquet(queue)
    dealt = spark.read.schema(todo.schema).parquet(queue)
    last, before = None, 0
    if known is not None:
        before = known.agg(F.max("round")).first()[0] or 0
        last = known.groupBy("book_id").agg(F.max_by("answer", "chunk_id").alias(f"{_P}previous"))
    for k in range(1, (dealt.agg(F.max(f"{_P}round")).first()[0] or 0) + 1):
        now = dealt.filter(F.col(f"{_P}round") == k).drop(f"{_P}round")
        now = now.join(last, "book_id", "left") if last is not None else now.withColumn(f"{_P}previous", F.lit(None).cast("string"))
        done = transform_chunks(now, backend, fix, context=f"{_P}previous", keep=True).select("book_id", "chunk_id", "translated", "flag", "prompt", "answer")
        done.withColumn("round", F.lit(before + k)).write.mode("append").parquet(store)
        last = spark.read.parquet(store).filter(F.col("round") == before + k).select("book_id", F.col("answer").alias(f"{_P}previous"))
    delete(spark, queue)
    return spark.read.parquet(store).drop("round") if exists(spark, store) else chunks.limit(0).selectExpr("book_id", "chunk_id", "text AS translated", "text AS flag", "text AS prompt", "text AS answer")
