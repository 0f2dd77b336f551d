"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` bits share a point within half of it from both. So every distinct
fingerprint emits itself and its 64 one-bit variants, the variants are shuffled, and fingerprints that
meet at a variant collide. The fingerprints that can meet at a variant are its ball of radius 1, so a
group is kept as a 64-bit mask of flipped bits, built by a map-side ``bit_or``: it deduplicates, has a
fixed size and never holds rows. All members of a group are within RADIUS of each other, so a star
from the smallest member links them; each such link is verified by its bit count.

Scale: copies collapse to one fingerprint before anything is shuffled, 65 short rows leave each
distinct fingerprint, components are contracted in rounds (``graph``), and texts are never shuffled.
Fingerprints are counted by an Arrow UDF over whole texts, ``BLOCK`` shingles at a time.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle of the whole sequence; repeated rows are listed one by one; a group whose
doc_ids are all null has a null component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from folioflow.llm import lines
from folioflow.llm.common import cut, scratch, small_batches, table
from folioflow.llm.graph import components

SHINGLE = 3
RADIUS = 2  # the variants below are those of half of it
SEED = 42
BLOCK = 65536


def fingerprint_of(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, n, BLOCK):
        part = words[k : k + BLOCK + SHINGLE - 1]
        shingles = zip(*[part[j:] for j in range(SHINGLE)], strict=False) if len(words) >= SHINGLE else [words]
        raw = b"".join([digest(b" ".join(s), SEED) for s in shingles])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.arrow_udf(LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint_of(t) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def links(prints: DataFrame) -> DataFrame:
    """a, b: links among the distinct fingerprints ``fp`` that join all that are within RADIUS bits."""
    bit = F.expr("shiftleft(1L, i)")
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select(
        F.when(F.col("i") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(bit)).alias("variant"),
        F.when(F.col("i") == 64, F.lit(0).cast("long")).otherwise(bit).alias("flip"),
        (F.col("i") == 64).cast("int").alias("self"),
    )
    met = variants.groupBy("variant").agg(F.expr("bit_or(flip)").alias("flips"), F.max("self").alias("self"))
    members = F.expr(
        "transform(filter(sequence(0, 64), i -> (i < 64 AND (flips & shiftleft(1L, i)) <> 0) OR (i = 64 AND self = 1)),"
        " i -> CASE WHEN i = 64 THEN variant ELSE variant ^ shiftleft(1L, i) END)"
    )
    groups = met.filter("bit_count(flips) + self > 1").select(F.array_sort(members).alias("m"))
    stars = groups.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 64)).alias("b"))
    return stars.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def _flat(text: Column) -> Column:
    """A text as one line, without ASCII capitals, as for its fingerprint."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals + "\n", capitals.lower() + " ")


def similar_links(docs: DataFrame, rows: DataFrame, text: str, key: str) -> DataFrame:
    """a, b: links among fingerprints that join all texts whose 5-word shingles have a Jaccard similarity of 0.8.

    Exact, by the join of ``lines`` over texts as lines; ``rows`` (flat, fp) has the fingerprint of each.
    """
    flat = docs.select(F.col(key).cast("string").alias("doc_id"), F.xxhash64(text).alias("hash"), _flat(F.col(text)).alias("text")).filter("text IS NOT NULL")
    ids = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))  # a place to look in; which row of a group is the earliest plays no part
    linked = lines.links(flat.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), ids)))
    prints = rows.groupBy("flat").agg(F.first("fp").alias("fp"))
    side = lambda s: prints.select(F.col("flat").alias(s), F.col("fp").alias(f"{s}_fp"))
    return linked.join(side("a"), "a").join(side("b"), "b").filter("a_fp <> b_fp").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): key, hash (of the text), flat (of the text as one line) and fp of every row of ``docs``;
    fp, root and component (the smallest key of the group) of every distinct fingerprint. ``similar`` also
    links texts by their 5-word shingles."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.xxhash64(_flat(F.col(text))).alias("flat"), fingerprint(F.col(text)).alias("fp"))
    rows = cut(known)
    prints = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    linked = links(prints)
    if similar:
        linked = linked.unionByName(similar_links(docs, rows, text, key))
    linked = components(linked)
    placed = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    return rows, placed.join(smallest, "root").select("fp", "root", "component")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: bool = False) -> DataFrame:
    """``docs`` with one row of each group, linked by fingerprints, or by 5-word shingles too if ``similar``:
    the one of the smallest key (null last), then of the smallest fingerprint, then of the smallest text hash; of rows that are equal
    in key and text the one whose other columns come first."""
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "fp", "hash")).alias("w")
    at = [F.coalesce(F.col("w.key").cast("string"), F.lit("")).alias("at"), F.col("w.none").alias("none"), F.col("w.hash").alias("hash")]
    with scratch() as keep:
        rows, groups = near_duplicates(docs, text, key, similar)
        winners = keep(cut(rows.join(groups.select("fp", "root"), "fp").groupBy("root").agg(best).select(*at)))
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("at"), F.col(key).isNull().alias("none"), F.xxhash64(text).alias("hash"), F.struct(*docs.columns).alias("row"))
    won = own.join(winners, ["at", "none", "hash"], "left_semi")
    return won.groupBy("at", "none", "hash").agg(F.min("row").alias("row")).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``documents``."""
    rows, groups = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.join(groups, "fp").select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
