"""Cleanup of model output: nine stages whose order is part of the result. All are expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.pytext import NAME, WS, let, split_lines, strip

# What the stages look for.
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]+[^\n]*"
META = (r"\(Продовження тексту[^)]*\)[^\n]*", r"\[Продовження[^\]]*\][^\n]*")
TRAILING_FENCE = rf"([а-яіїєґА-ЯІЇЄҐA-Za-z0-9.,!?:;)\"']){WS}*`{{3}}"
CODE_SIGNS = r"[{};=>()]"
HASHTAG = f"#{NAME}+"
SENTENCE_GAP = rf"(?<=[.!?]){WS}+"
READABLE = rf"[а-яіїєґА-ЯІЇЄҐA-Za-z0-9{WS[1:-1]}\-#*`_.,!?:()\[\]\"]"
FENCE = "```"
HASHTAGS, SIGHTINGS, FINGERPRINT, SHORT_FENCE = 3, 3, 60, 20


def cut_cjk(text: Column) -> Column:
    return F.regexp_replace(text, CJK, "")


def cut_meta(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, META[0], ""), META[1], "")


def drop_trailing_fence(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(FENCE)), F.regexp_replace(text, TRAILING_FENCE, "$1")).otherwise(text)


def drop_lone_fences(lines: Column) -> Column:
    """Without fence lines that no sign of code stands next to."""

    def code_beside(a: Column, i: Column) -> Column:
        return F.concat(F.coalesce(strip(F.get(a, i - 1)), F.lit("")), F.coalesce(strip(F.get(a, i + 1)), F.lit(""))).rlike(CODE_SIGNS)

    return let(lines, lambda a: F.filter(a, lambda x, i: (strip(x) != FENCE) | code_beside(a, i)))


def close_fence(lines: Column) -> Column:
    fence = lambda x: (strip(x) == FENCE) | (strip(x).startswith(FENCE) & (F.length(strip(x)) <= SHORT_FENCE))
    return let(lines, lambda a: F.when(F.size(F.filter(a, fence)) % 2 == 1, F.concat(a, F.array(F.lit(FENCE)))).otherwise(a))


def cut_hashtags(lines: Column) -> Column:
    def cut(a: Column) -> Column:
        spam = F.filter(F.transform(a, lambda x, i: F.when(F.regexp_count(x, F.lit(HASHTAG)) >= HASHTAGS, i)), lambda i: i.isNotNull())
        return F.slice(a, F.lit(1), F.coalesce(F.array_min(spam), F.size(a)))

    return let(lines, cut)


def cut_repeats(text: Column) -> Column:
    """Everything from the third sighting of a sentence's first 60 characters on is dropped."""

    def cut(s: Column) -> Column:
        marked = F.array_sort(F.transform(s, lambda x, i: F.struct(F.substring(strip(x), 1, FINGERPRINT).alias("k"), i.alias("i"))))
        third = let(marked, lambda m: F.array_min(F.transform(F.filter(m, lambda x, j: F.coalesce(F.get(m, j - (SIGHTINGS - 1))["k"] == x["k"], F.lit(False))), lambda x: x["i"])))
        return F.array_join(F.slice(s, F.lit(1), F.coalesce(third, F.size(s))), " ")

    return let(F.split(text, SENTENCE_GAP, -1), cut)


def readable_lines(text: Column) -> Column:
    return F.array_join(F.filter(split_lines(text), lambda x: (strip(x) == "") | x.rlike(READABLE)), "\n")


def fix_fences(text: Column) -> Column:
    """The three stages on lines: lone fences, the unclosed fence, hashtag spam."""
    return F.array_join(cut_hashtags(close_fence(drop_lone_fences(split_lines(text)))), "\n")


def strip_noise(text: Column) -> Column:
    return strip(readable_lines(cut_repeats(fix_fences(drop_trailing_fence(cut_meta(cut_cjk(text)))))))
