"""Text functions with code-point, line and white-space rules that do not depend on the engine's dialect.

The character classes are spelled out, so that the same pattern means the same in Java and in RE2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACES}]"
WORD = f"[^{SPACES}]+"
NAME = r"[\p{L}\p{N}_]"
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def count_words(text: Column) -> Column:
    """How many runs of anything but ``SPACE_CHARS`` there are, without a pattern: Java tries a class of so many ranges one by
    one at every character."""
    spaced = F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.array_size(F.array_remove(F.split(spaced, " ", -1), ""))


def split_lines(text: Column) -> Column:
    """The lines without their ends; no empty line after a last line end, none at all of an empty text."""
    parts = F.split(text, LINE_END, -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


SLICE = 512


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column], Column], kind: str) -> Column:
    """``emit(state)`` (of the SQL type ``kind``) after each item, the state going from item to item by ``step``.

    An array that grows item by item is copied each time; here only ``SLICE`` results grow so, and the
    slices' arrays are put together at the end: the time follows the number of items.
    """
    none, nones = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")
    at = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SLICE).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    def one(state: Column, item: Column) -> Column:
        return let(step(state["s"], item), lambda n: F.struct(n.alias("s"), F.concat(state["out"], F.array(emit(n))).alias("out")))

    def many(state: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k * SLICE + 1, F.lit(SLICE)), F.struct(state["s"].alias("s"), none.alias("out")), one)
        return let(part, lambda p: F.struct(p["s"].alias("s"), F.concat(state["out"], F.array(p["out"])).alias("out")))

    return F.flatten(F.aggregate(at, F.struct(start.alias("s"), nones.alias("out")), many)["out"])


def places(text: Column, pattern: Column) -> Column:
    """array<struct<s,e,t>>: where the pattern's matches stand (code points, end exclusive)."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def found(m: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.struct(g.alias("g"), F.length(x).alias("m")))
        ends = scan(pairs, F.lit(0), lambda at, x: at + x["g"] + x["m"], lambda at: at, "int")
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("s"), e.alias("e"), x.alias("t")))

    return let(matches, found)
