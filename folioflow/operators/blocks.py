"""Blocks of a laid-out page: spans folded to a kind and a text, noise and tiny images dropped, reading order.

Raw rows: book_id, page_num, block_no, block_type (0 text, 1 image), bbox struct(x0, y0, x1, y1), spans
array of struct(text, size, font, flags). All but the order is a projection; the order and the image
numbers are windows within a page, on one shuffle by book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import IMAGE_WORD
from folioflow.functions.pytext import WS, collapse, is_upper, let, strip

MONO = ("mono", "courier", "consola", "inconsolata", "sourcecodepro", "code")
KINDS = ("heading1", "heading2", "paragraph", "code", "caption", "image")


def text_spans(spans: Column) -> Column:
    """Spans with something to read."""
    return F.filter(spans, lambda s: F.length(strip(s["text"])) > 0)


def fold_spans(spans: Column) -> Column:
    """struct(max_size, bold, italic, mono, text) of a run of spans."""
    return let(spans, _fold)


def _fold(spans: Column) -> Column:
    font = lambda s: F.lower(s["font"])
    flag = lambda s, bit: s["flags"].bitwiseAND(bit) != 0
    return F.struct(
        F.array_max(F.transform(spans, lambda s: s["size"])).alias("max_size"),
        F.exists(spans, lambda s: flag(s, 16) | font(s).contains("bold")).alias("bold"),
        F.forall(spans, lambda s: flag(s, 2) | font(s).contains("italic") | font(s).contains("oblique")).alias("italic"),
        F.exists(spans, lambda s: font(s).rlike("|".join(MONO))).alias("mono"),
        collapse(F.array_join(F.transform(spans, lambda s: s["text"]), " ")).alias("text"),
    )


def kind_of(fold: Column) -> Column:
    return let(fold, _kind)


def _kind(f: Column) -> Column:
    return (
        F.when(f["mono"], "code").when(f["max_size"] >= 18, "heading1")
        .when((f["max_size"] >= 14) | (f["bold"] & (f["max_size"] >= 12)), "heading2")
        .when(f["italic"] & (F.length(f["text"]) < 200), "caption").otherwise("paragraph")
    )


#: reason: condition on the stripped text in both engines' pattern language
NOISE = {
    "digits": r"\A\p{Nd}+\z",
    "number_row": rf"\A[\p{{Nd}}{WS[1:-1]}]{{10,}}\z",
    "imprint": r"ISBN|US \$|CAN \$",
    "social": r"Twitter:|linkedin\.com|youtube\.com",
    "page_number": rf"\A\p{{Nd}}+{WS}*\||\A[^\n]+\|{WS}*\p{{Nd}}+\z",
}


def noise_reason(text: Column, page_num: Column) -> Column:
    """Why a text is page furniture; null if it isn't."""

    def judge(t: Column) -> Column:
        header = (page_num > 5) & (F.length(t) < 40) & ~t.rlike(r"[.,:;]") & (is_upper(t) | t.rlike(r"\A[A-Z][a-z ]+\z"))
        return (
            F.when(F.length(t) < 3, "short").when(t.rlike(NOISE["digits"]), "digits").when(t.rlike(NOISE["number_row"]), "number_row")
            .when(t.rlike(NOISE["imprint"]) & (F.length(t) < 80), "imprint").when(t.rlike(NOISE["social"]), "social")
            .when(t.rlike(NOISE["page_number"]), "page_number").when(header, "running_head")
        )

    return let(strip(text), judge)


def is_tiny(bbox: Column) -> Column:
    return (bbox["x1"] - bbox["x0"] < 60) | (bbox["y1"] - bbox["y0"] < 40)


def page_range(rows: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Pages first to last, both included; nothing or 0 means from the start, to the end."""
    rows = rows.filter(F.col("page_num") >= max(1, first or 1))
    return rows.filter(F.col("page_num") <= last) if last else rows


def page_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book_id").agg(F.max("page_num").cast("long").alias("n_pages"))


def classify(raw: DataFrame) -> DataFrame:
    """book_id, page_num, block_no, kind, text, bbox: text blocks classified, images as such, empty runs gone."""
    readable = F.exists("spans", lambda s: F.length(strip(s["text"])) > 0)
    image = F.col("block_type") == 1
    judged = let(fold_spans(text_spans(F.col("spans"))), lambda f: F.struct(_kind(f).alias("kind"), f["text"].alias("text")))
    rows = raw.filter(image | readable).withColumn("f", F.when(~image, judged))
    return rows.select("book_id", "page_num", "block_no", F.when(image, "image").otherwise(F.col("f.kind")).alias("kind"), F.col("f.text").alias("text"), "bbox")


def extract(raw: DataFrame, images: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """book_id, ord, page_num, kind, text, bbox of the blocks that stay, in reading order; an image's text is its tag."""
    rows = classify(page_range(raw, first, last))
    image = F.col("kind") == "image"
    keep = F.when(image, F.lit(images) & ~is_tiny(F.col("bbox"))).otherwise(noise_reason(F.col("text"), F.col("page_num")).isNull())
    kept = rows.filter(keep).repartition("book_id")
    page = Window.partitionBy("book_id", "page_num")
    number = F.sum(image.cast("int")).over(page.orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0))
    tag = F.format_string(f"\n![{IMAGE_WORD} %d-%d](images/p%04d_img%02d.png)\n", "page_num", number, "page_num", number)
    top, left = F.coalesce(F.col("bbox.y0"), F.lit(0.0)), F.coalesce(F.col("bbox.x0"), F.lit(0.0))
    order = Window.partitionBy("book_id").orderBy("page_num", top, left, "block_no")
    tagged = kept.withColumn("text", F.when(image, tag).otherwise(F.col("text")))
    return tagged.withColumn("ord", F.row_number().over(order) - 1).select("book_id", "ord", "page_num", "kind", "text", "bbox")

