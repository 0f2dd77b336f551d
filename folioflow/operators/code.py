"""Code blocks leave a text as placeholders and come back word for word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.pytext import NAME, let, strip

BLOCK = rf"(?s)```{NAME}*\n.*?```"
PLACEHOLDER = r"«CODE_BLOCK_\p{Nd}+»"


def code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))


def take_out(text: Column) -> Column:
    """The text with its blocks as numbered placeholders."""
    parts = F.split(text, BLOCK, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("«CODE_BLOCK_"), (i - 1).cast("string"), F.lit("»"), p))), "")


def put_back(text: Column, blocks: Column) -> Column:
    """Each placeholder, quoted, in backticks or without its marks, becomes its block: wrappings go first,
    then all blocks go in at once and word for word."""

    def mark(t: Column, i: Column) -> Column:
        n = i.cast("string")
        return F.regexp_replace(t, F.concat(F.lit("`*(?<!«)CODE_BLOCK_"), n, F.lit(r"(?!\p{Nd})`*")), F.concat(F.lit("«CODE_BLOCK_"), n, F.lit("»")))

    def marked(bare: Column) -> Column:
        return F.when(bare.rlike("(?<!«)CODE_BLOCK_"), F.aggregate(F.sequence(F.lit(0), F.size(blocks) - 1), bare, mark)).otherwise(bare)

    def insert(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0))
        block = lambda m: F.coalesce(F.get(blocks, F.regexp_extract(m, r"\p{Nd}+", 0).try_cast("int")), m, F.lit(""))
        return F.array_join(F.zip_with(F.split(t, PLACEHOLDER, -1), found, lambda gap, m: F.concat(gap, block(m))), "")

    def whole(t: Column) -> Column:
        bare = F.regexp_replace(t, rf"`*[\"']?({PLACEHOLDER})[\"']?`*", "$1")
        return F.when(F.size(blocks) > 0, let(let(bare, marked), insert)).otherwise(t)

    return let(text, whole)


def has_prose(sanitized: Column) -> Column:
    """Whether anything but placeholders is left to transform."""
    return F.length(strip(F.regexp_replace(sanitized, PLACEHOLDER, ""))) > 0
