"""The corpus pipeline: five stages from raw documents to piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as
Parquet to the shared folder and reads it back as the next stage's documents. All stages but the last
return the columns of ``documents``; n_chars follows the text.

Defined cases are those of the operators. Beyond them: a document without a doc_id is judged, deduplicated
and mixed like any other; a document all of whose worded lines are repeats of earlier ones is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import classifier, lines, mixing, pieces, simhash
from folioflow.llm.common import WORD, n_words, shared_folder, table, text_or_empty


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Labels are learned from the stage's own documents."""
    scored = classifier.classify(docs, classifier.fit(docs, table(spark, sf_dir, "labels")), out="__score")
    return scored.filter(F.col("__score") >= classifier.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match earlier ones."""
    left = lines.dedup_lines(docs, n_lines="__lines", n_removed="__removed")
    left = left.filter((F.col("__removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints within 2 bits as in op5, or a Jaccard
    similarity of 0.8 of the 5-word shingles."""
    return simhash.deduplicate(docs, similar=True).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order; documents of sources below their target come up to three times."""
    sized = docs.select("doc_id", "source", n_words(text_or_empty()).cast("long").alias("__words"), F.struct(*docs.columns).alias("__doc"))
    return mixing.mix(sized, "__words").select("__doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces and whether the ids decode to the text, a row a document of the mix."""
    vocabulary = pieces.Vocabulary()
    decoded = pieces.decode(pieces.encode(docs.select("doc_id", "text"), vocabulary), vocabulary)
    whole = F.replace(text_or_empty(), F.lit(pieces.SPACE), F.lit(" "))
    return decoded.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), (F.col("decoded") == whole).alias("round_trip"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: Hashes, a trained model and a tokenizer can't be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
