"""Terminology: forms that go back to English, and the English original at a term's first occurrence."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import ANNOTATIONS, ENGLISH_FORMS, GLOSSARY, GLOSSARY_HEAD, GLOSSARY_TITLE, KEEP_ENGLISH
from folioflow.functions.pytext import NAME, SPACES, WS, let, places

CYRILLIC = r"[\x{400}-\x{4ff}]"
CODE = r"(?s)```.*?```"
#: Letter variants that the patterns' case folding takes for these letters and lower case doesn't (all code points were tried).
VARIANTS = ("\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86", "вдосттъ")


def java(pattern: str) -> str:
    """A fixed pattern with Unicode case folding and this library's classes."""
    return "(?iu)" + pattern.replace(r"[\s-]", f"[{SPACES}-]").replace(r"\s", WS).replace(r"\w", NAME)


def needed(pattern: str) -> str:
    """The longest run of Cyrillic letters that every match of one of the fixed patterns has."""
    fixed = re.sub(r"\[[^\]]*\]|\([^)]*\)", ".", pattern)  # no class, no group
    return max(re.findall(r"[а-яіїєґ]+(?![а-яіїєґ]|[?*{])", fixed), key=len)


def force_english(text: Column) -> Column:
    """All forms in order. Every pattern needs a Cyrillic letter, so other texts skip the fold, and a run of them
    (``needed``), so only texts that have it go through the pattern. What is put in is Latin, so no run comes about on the way."""

    def forced(low: Column) -> Column:
        one = lambda t, f: let(t, lambda x: F.when(F.contains(low, F.lit(needed(f[0]))), F.regexp_replace(x, java(f[0]), f[1])).otherwise(x))
        return functools.reduce(one, ENGLISH_FORMS, text)

    def folded(low: Column) -> Column:
        return F.when(low.rlike(f"[{VARIANTS[0]}]"), F.translate(low, *VARIANTS)).otherwise(low)

    return F.when(text.rlike(CYRILLIC), let(let(F.lower(text), folded), forced)).otherwise(text)


def term_pattern(term: str) -> str:
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", term)
    return rf"(?iu)(?<!{NAME}){quoted}(?!{NAME})(?!{WS}*\([^)]*\))"


def by_length(terms: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(terms.items(), key=lambda t: -len(t[0]))


def annotations(text: Column, terms: dict[str, str] = ANNOTATIONS, idempotent: bool = False) -> Column:
    """array<struct<s,e,t,en>>: each term's occurrence that gets its original, longer terms first.

    A candidate goes if a longer term's annotation would follow it directly or split it: one that ends
    where it ends or inside it. With ``idempotent`` a term that has an annotated occurrence gets none.
    """
    table = F.array(*[
        F.struct(F.lit(term_pattern(ua)).alias("p"), F.lit(ua.lower()).alias("low"), F.lit(en).alias("en"), F.lit(rf"(?iu)(?<!{NAME}){re.escape(ua)} \({re.escape(en)}\)").alias("done"))
        for ua, en in by_length(terms)
    ])

    nowhere = F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)")

    def choose(code: Column, low: Column) -> Column:
        def step(chosen: Column, term: Column) -> Column:
            def free(x: Column) -> Column:
                in_code = F.exists(code, lambda c: (c["s"] <= x["s"]) & (x["s"] < c["e"]))
                split = F.exists(chosen, lambda y: (y["e"] > x["s"]) & (y["e"] <= x["e"]))
                return ~in_code & ~split

            found = F.when(F.contains(low, term["low"]), places(text, term["p"])).otherwise(nowhere)
            first = F.slice(F.filter(found, free), 1, 1)
            if idempotent:
                first = F.when(F.regexp_like(text, term["done"]), F.slice(first, 1, 0)).otherwise(first)
            return F.concat(chosen, F.transform(first, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), term["en"].alias("en"))))

        return F.aggregate(table, F.expr("cast(array() as array<struct<s:int,e:int,t:string,en:string>>)"), step)

    none = F.expr("cast(array() as array<struct<s:int,e:int,t:string,en:string>>)")
    return F.when(text.rlike(CYRILLIC), let(F.lower(text), lambda low: let(places(text, F.lit(CODE)), lambda c: choose(c, low)))).otherwise(none)


def annotate(text: Column, found: Column) -> Column:
    """The text with `` (English)`` after each found occurrence."""

    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["e"].alias("e"), x["en"].alias("en"))))

    def pieces(all_: Column) -> Column:
        before = lambda i: F.coalesce(F.get(all_, i - 1)["e"], F.lit(0))
        parts = F.transform(all_, lambda x, i: F.concat(F.substr(text, before(i) + 1, x["e"] - before(i)), F.lit(" ("), x["en"], F.lit(")")))
        return F.concat(F.array_join(parts, ""), F.substr(text, F.coalesce(F.element_at(all_, -1)["e"], F.lit(0)) + 1))

    return let(ordered, lambda all_: F.when(F.size(all_) > 0, pieces(all_)).otherwise(text))


def change_log(found: Column) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit("  «"), x["t"], F.lit("» → «"), x["t"], F.lit(" ("), x["en"], F.lit(")»")))


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GLOSSARY.items()), "en string, ua string")


def keep_english(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in KEEP_ENGLISH], "term string")


def glossary_note(terms: DataFrame) -> DataFrame:
    """note: the glossary as a Markdown table, by English term. A constant table: one group is its size."""
    rows = F.array_sort(F.collect_list(F.struct("en", F.concat(F.lit("| "), "en", F.lit(" | "), "ua", F.lit(" |")).alias("row"))))
    return terms.agg(F.concat_ws("\n", F.lit(GLOSSARY_TITLE), *[F.lit(h) for h in GLOSSARY_HEAD], F.array_join(F.transform(rows, lambda r: r["row"]), "\n")).alias("note"))


def glossary_listing(terms: DataFrame) -> DataFrame:
    padded = F.when(F.length("en") < 45, F.rpad("en", 45, " ")).otherwise(F.col("en"))
    return terms.select("en", F.concat(F.lit("  "), padded, F.lit(" → "), "ua").alias("line")).orderBy("en")
